"""Column expressions shared by the jobs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import NULL_SENTINEL


def full_name(first: str, second: str) -> Column:
    """Two name parts joined by a space, missing parts skipped. [P3]"""
    return F.concat_ws(" ", first, second)


def number_or_null(column: str, dtype: str = "double") -> Column:
    """Number from text; the null sentinel and unreadable text become null. [P4, N1]"""
    return F.nullif(F.col(column).cast("string"), F.lit(NULL_SENTINEL)).try_cast(dtype)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown. [P8-P10]"""
    return F.when(condition, 1).otherwise(0)


def clean_number(column: str) -> Column:
    """Number for model input: unreadable, NaN and null become 0. [P23]"""
    value = F.col(column).cast("string").try_cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def contains_any(column: str, texts: list[str]) -> Column:
    """Case-sensitive substring match against any of ``texts``. [P25]"""
    return reduce(or_, [F.col(column).contains(t) for t in texts])


def share_of(value: Column, total: Column) -> Column:
    """value / total, dividing by 1 where the total is 0. [P27]"""
    return value / F.when(total == 0, F.lit(1)).otherwise(total)


def sigmoid(score: Column) -> Column:
    """Logistic function of a raw score. [P33]"""
    return 1.0 / (1.0 + F.exp(-score))


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Fail early, naming every missing column. [S5]"""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def keep_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order. [S6]"""
    return df.select([c for c in wanted if c in df.columns])
