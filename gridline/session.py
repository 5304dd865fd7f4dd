"""Session for local runs and the scratch location shared by all executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

GROUP_ROWS_KEY = "spark.gridline.maxGroupRows"
PIN_ROWS_KEY = "spark.gridline.maxPinnedRows"
_SCRATCH_KEY = "spark.gridline.scratchDir"


def local_session(cpus: int | str = "*", app: str = "gridline") -> SparkSession:
    """Session for tests and bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(os.cpu_count() if cpus == "*" else cpus))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, one per application.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session, where driver and executors are one machine, may fall back to a
    temporary folder of its own.
    """
    known = spark.conf.get(_SCRATCH_KEY, None)
    if known:
        return known
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="gridline-")
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    spark.conf.set(_SCRATCH_KEY, path)
    return path


def max_group_rows(spark: SparkSession) -> int:
    """Rows of one window group that a single task may sort."""
    return int(spark.conf.get(GROUP_ROWS_KEY, "2000000"))


def max_pinned_rows(spark: SparkSession) -> int:
    """Rows that may be pinned on the driver and broadcast."""
    return int(spark.conf.get(PIN_ROWS_KEY, "10000"))
