"""Raw CSV tables and parquet feature sets."""

from __future__ import annotations

import logging
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from ..fixed import NULL_SENTINEL, RAW_SUBDIRS, REQUIRED_RAW_FILES
from ..functions.columns import keep_existing, require_columns
from .schemas import OPTIONAL, TABLES

log = logging.getLogger(__name__)


def listing(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files below ``root`` whose name matches ``glob``: path, length and time of change, no content read. [S7, S9]"""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def _found(spark: SparkSession, root: str, files: list[str] = REQUIRED_RAW_FILES) -> set[str]:
    """Relative paths of the known raw files that exist directly in ``root`` or a known sub-folder.

    Whole paths are compared, without scheme and host, so the result is bounded by what is looked for.
    """
    known = sorted({f"{t}.csv" for t in TABLES} | set(files))
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root if ":" in root else os.path.abspath(root)).rstrip("/")
    wanted = {f"{base}/{rel}": rel for f in known for rel in [f, *[f"{d}/{f}" for d in RAW_SUBDIRS]]}
    bare = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    rows = listing(spark, root, "*.csv").select(bare.alias("path")).filter(F.col("path").isin(list(wanted))).collect()
    return {wanted[r["path"]] for r in rows}


def resolve(found: set[str], file: str) -> str | None:
    """Direct file first, then the known sub-folders. [S2]"""
    return next((p for p in [file, *[f"{d}/{file}" for d in RAW_SUBDIRS]] if p in found), None)


def _typed(name: str, kind: DataType) -> Column:
    """Text as ``kind``, null where it is no number; whole numbers may be written ``7.0``. An unreadable key raises."""
    text = F.col(name)
    value = text.try_cast(kind)
    if isinstance(kind, IntegralType):
        number = text.try_cast("decimal(38,9)")
        value = F.coalesce(value, F.when(number == F.floor(number), number.try_cast(kind)))
        if name.endswith("Id"):
            value = F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"{name} is not a whole number: "), text))).otherwise(value)
    return value.alias(name)


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("nullValue", NULL_SENTINEL).csv(path)


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """CSV with header; columns matched by name, the sentinel read as null. [S1, P4]"""
    schema = TABLES[table]
    text = _text(spark, path)
    wanted = [
        _typed(f.name, f.dataType) if f.name in text.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    others = [c for c in text.columns if c not in schema.names]
    return text.select(*wanted, *(others if table == "results" else []))


def load_raw(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All raw tables below ``root``; an absent optional table is empty. [S1-S3]"""
    found = _found(spark, root)
    tables = {}
    for table, schema in TABLES.items():
        path = resolve(found, f"{table}.csv")
        if path is not None:
            tables[table] = read_csv(spark, f"{root.rstrip('/')}/{path}", table)
        elif table in OPTIONAL:
            log.warning("%s.csv not found", table)
            tables[table] = spark.createDataFrame([], schema)
        else:
            raise FileNotFoundError(f"{table}.csv not found below {root}")
    return tables


def unreadable_values(spark: SparkSession, root: str) -> dict[str, int]:
    """How many values of each ``table.column`` are there but can't be read as declared, and are null therefore. [S1]

    One scan of each table, one row back; columns without such values are left out. Keys are not
    counted, since reading an unreadable key raises.
    """
    found, out = _found(spark, root), {}
    for table, schema in TABLES.items():
        if (path := resolve(found, f"{table}.csv")) is None:
            continue
        text = _text(spark, f"{root.rstrip('/')}/{path}")
        counted = [f for f in schema if f.name in text.columns and not f.name.endswith("Id") and f.dataType != StringType()]
        if counted:
            row = text.agg(*[F.count_if(F.col(f.name).isNotNull() & _typed(f.name, f.dataType).isNull()).alias(f.name) for f in counted]).first()
            out |= {f"{table}.{f.name}": row[f.name] for f in counted if row[f.name]}
    return out


def missing_inputs(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected inputs that were not found. [S7]"""
    return expected.join(found, expected.columns, "left_anti")


def require_inputs(spark: SparkSession, root: str, files: list[str] = REQUIRED_RAW_FILES) -> None:
    """Raise, naming every required file that is neither directly in ``root`` nor in a known sub-folder. [S7]"""
    found = _found(spark, root, files)
    missing = sorted(f for f in files if resolve(found, f) is None)
    if missing:
        raise FileNotFoundError(f"missing input files below {root}: {missing}")


def read_features(
    spark: SparkSession, path: str, columns: list[str], required: list[str] = ()
) -> DataFrame:
    """Projected scan of a feature set. [S4-S6]"""
    df = spark.read.parquet(path)
    return keep_existing(require_columns(df, list(required)), columns)
