"""Early-season sequences as array columns, without leaving the executors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import SEQUENCE_FEATURES, SEQUENCE_MIN_ROWS, SEQUENCE_STEPS, STD_EPSILON
from ..functions.columns import clean_number
from .ranking import first_rows

_TARGET = "won_championship"


def sequence_rows(champ: DataFrame, features: list[str] = SEQUENCE_FEATURES) -> DataFrame:
    """Model columns of the feature set, coerced to numbers. [P23, S6]"""
    present = [f for f in features if f in champ.columns]
    name = F.col("driver_name") if "driver_name" in champ.columns else F.col("driver_id")
    return champ.select(
        "driver_id", name.alias("driver_name"), "year", "round",
        clean_number(_TARGET).cast("int").alias("label"),
        *[clean_number(f).alias(f) for f in present],
    )


def build_sequences(rows: DataFrame, features: list[str] = SEQUENCE_FEATURES) -> DataFrame:
    """One row per driver-season: its first entries in order, label and name. [T7, T8, A10, M12]

    At most five rows per driver-season reach the shuffle, and the group-by
    reuses it.
    """
    present = [f for f in features if f in rows.columns]
    order = ["round", *present[:2]]
    first = first_rows(rows, ["driver_id", "year"], order, SEQUENCE_STEPS, "step")
    entry = F.struct("step", F.array(*present).alias("values"))
    return (
        first.groupBy("driver_id", "year")
        .agg(
            F.min_by("driver_name", "step").alias("driver_name"),
            F.max("label").alias("label"),
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["values"]).alias("sequence"),
        )
        .filter(F.size("sequence") >= SEQUENCE_MIN_ROWS)
    )


def pad(sequence: Column, width: int, steps: int = SEQUENCE_STEPS) -> Column:
    """Zero steps at the end, up to ``steps``. [M13]"""
    zero = F.array_repeat(F.lit(0.0), width)
    return F.concat(sequence, F.array_repeat(zero, F.lit(steps) - F.size(sequence)))


def padded(sequences: DataFrame, features: list[str] = SEQUENCE_FEATURES) -> DataFrame:
    return sequences.withColumn("sequence", pad(F.col("sequence"), len(features)))


def split_name(year: Column, cutoff: int, validation_years: int) -> Column:
    """train, validation (last years up to the cut-off) or test. [M1, M3]"""
    return (
        F.when(year > cutoff, "test")
        .when(year > cutoff - validation_years, "validation")
        .otherwise("train")
    )


@dataclass(frozen=True)
class Scaler:
    """Per-feature mean and deviation, one number each. [A14]"""

    mean: list[float]
    std: list[float]

    @staticmethod
    def fit(sequences: DataFrame, width: int) -> Scaler:
        """Statistics over all rows and steps, padding included. [A14, N11]"""
        values = sequences.select(F.explode("sequence").alias("v"))
        row = values.agg(
            F.array(*[F.avg(F.col("v")[i]) for i in range(width)]).alias("mean"),
            F.array(*[F.stddev_pop(F.col("v")[i]) for i in range(width)]).alias("std"),
        ).first()
        if None in row["mean"]:
            raise ValueError("no training sequences to scale with; check the cut-off year")
        return Scaler(list(row["mean"]), [s + STD_EPSILON for s in row["std"]])

    def apply(self, sequence: Column) -> Column:
        """(x - mean) / std on every step. [M14]"""
        mean = F.array(*[F.lit(m) for m in self.mean])
        std = F.array(*[F.lit(s) for s in self.std])
        scaled = lambda step: F.transform(step, lambda x, i: (x - F.get(mean, i)) / F.get(std, i))
        return F.transform(sequence, scaled)


def long_form(sequences: DataFrame, features: list[str] = SEQUENCE_FEATURES) -> DataFrame:
    """One row per (driver-season, step, feature)."""
    steps = sequences.select("driver_id", "year", F.posexplode("sequence").alias("pos", "values"))
    names = F.array(*[F.lit(f) for f in features])
    return steps.select(
        "driver_id", "year", (F.col("pos") + 1).alias("step"),
        F.explode(F.arrays_zip(names.alias("feature"), F.col("values").alias("value"))).alias("fv"),
    ).select("driver_id", "year", "step", "fv.feature", "fv.value")


def sequence_counts(sequences: DataFrame) -> DataFrame:
    """[A11]"""
    return sequences.agg(
        F.count("*").alias("sequences"), F.coalesce(F.sum("label"), F.lit(0)).alias("champions")
    )


def season_counts(rows: DataFrame) -> DataFrame:
    """Seasons and seasons with a champion in the rows. [A9]"""
    per_year = rows.groupBy("year").agg(F.count("*").alias("n"), F.max("label").alias("has_champion"))
    return per_year.agg(
        F.sum("n").alias("row_count"),
        F.count("*").alias("seasons"),
        F.sum("has_champion").alias("champion_seasons"),
    )
