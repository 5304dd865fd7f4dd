"""Written intermediate tables: cut lineage, true file sizes, column pruning on re-read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import scratch_dir

# (application, name) -> path and schema of the tables kept for the session.
_KEPT: dict[tuple[str, str], tuple[str, StructType]] = {}


def _write(df: DataFrame, name: str) -> str:
    safe = "".join(c if c.isalnum() else "-" for c in name)
    path = f"{scratch_dir(df.sparkSession)}/{safe}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return path


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the scratch folder and return a scan of it.

    Survives lost executors, and gives Catalyst exact sizes, so joins against
    the result are broadcast only when the file really is below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = _write(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_in_buckets(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """``staged``, small on disk and in so many ``buckets`` by the hash of ``by``: groups of ``by`` are read without a shuffle.

    Spark keeps buckets for catalog tables only, so the files have a name there until the scan is resolved.
    """
    spark, name = df.sparkSession, f"gridline_{uuid.uuid4().hex}_" + "".join(c if c.isalnum() else "_" for c in name)
    path = f"{scratch_dir(spark)}/{name}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, by).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")  # the files stay, as those of any table with a path


def staged_once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``staged``, kept under ``name`` for the rest of the application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _KEPT:
        df = build()
        _KEPT[key] = (_write(df, name), df.schema)
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)
