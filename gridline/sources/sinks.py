"""Feature-set, analytics, prediction and CSV sinks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import keep_existing


def write_features(df: DataFrame, columns: list[str], path: str, files: int | None = None, partition_by: tuple[str, ...] = ()) -> None:
    """Fixed column list to parquet. [K1]

    With ``partition_by`` rows of one value are brought together in files of a fit size (big
    values get several), so that later filters skip whole folders. ``files`` costs one more
    shuffle, so it is off unless asked for.
    """
    _features(df, columns, files, partition_by).mode("overwrite").parquet(path)


def rewrite_features(df: DataFrame, columns: list[str], path: str, partition_by: tuple[str, ...]) -> None:
    """Replace the partitions that ``df`` has rows of, and leave the others as they are. [K1]"""
    _features(df, columns, None, partition_by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def _features(df: DataFrame, columns: list[str], files: int | None, partition_by: tuple[str, ...]) -> DataFrameWriter:
    out = keep_existing(df, columns)
    if files:
        out = out.repartition(files)
    elif partition_by:
        out = out.hint("rebalance", *partition_by)
    return out.write.partitionBy(*partition_by) if partition_by else out.write


_POINTER = "at long, folder string"


def publish(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write ``df`` to a fresh folder below ``path``, then add a pointer to it, which makes it the table. [K2-K5]

    Readers go by the newest pointer (see `published`), so a writer that is lost leaves the table
    as it was, and a table may be made out of its own former content. Former folders stay until
    someone removes them.
    """
    folder = f"v-{uuid.uuid4().hex}"
    df.write.options(**options).format(fmt).save(f"{path}/{folder}")
    pointer = df.sparkSession.createDataFrame([(time.time_ns(), folder)], _POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{path}/pointers")


def published_folder(spark: SparkSession, path: str) -> str:
    """The folder that the newest pointer names. Reading what was never published raises."""
    row = spark.read.schema(_POINTER).json(f"{path}/pointers").orderBy(F.desc("at"), "folder").first()
    return f"{path}/{row['folder']}"


def published(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A published parquet table, or with a schema a CSV table with header. [K2-K5]"""
    folder = published_folder(spark, path)
    if schema is None:
        return spark.read.parquet(folder)
    return spark.read.schema(schema).option("header", True).csv(folder)


def write_parquet(df: DataFrame, path: str) -> None:
    """Analytics or prediction table, in the frame's order. [K2, K3]"""
    publish(df, path)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Ordered CSV with header. [K4]

    A sorted frame is written as ordered part files by parallel tasks. A report asked for as a
    single file is one, whatever its size, written by one task.
    """
    publish(df.coalesce(1) if single_file else df, path, "csv", header=True)


def reexport_csv(spark: SparkSession, source: str, schema: str, order: str, path: str) -> None:
    """Read a CSV result, sort it, and write it to another place or in its own. [K5]"""
    export_csv(published(spark, source, schema).orderBy(order), path, single_file=True)


def save_model(model: PipelineModel, path: str) -> None:
    """[K6]"""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """[K6]"""
    return PipelineModel.load(path)


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` in memory or on local disk while several actions read it, then release it. [K7]

    A lost executor only costs the recomputation of its blocks.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
