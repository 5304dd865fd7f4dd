"""Season-results tables derived from the order tables.

Suppliers act as drivers, nations as constructors, ship years as seasons and
ship months as rounds and venues. A supplier's monthly quantity decides the
finish. The seven tables grow with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import ordered_groups
from ..operators.running import add_running, row_number
from ..sources.scratch import staged_once
from .race_rows import race_rows

# Points by finish position.
POINTS = [25.0, 18.0, 15.0, 12.0, 10.0, 8.0, 6.0, 4.0, 2.0, 1.0]
# Temporal split of this data set.
TRAIN_CUTOFF = 1999
VALIDATION_YEARS = 2


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier and month."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    quantity = F.col("l_quantity")
    return (
        items.groupBy(
            F.col("l_suppkey").alias("driverId"),
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("round"),
        )
        .agg(
            F.sum(quantity).alias("qty"),
            F.count("*").alias("n"),
            F.sum(F.when(F.col("l_linestatus") == "O", quantity)).alias("open_qty"),
            F.sum(F.when(F.col("l_returnflag") == "R", quantity).otherwise(0.0)).alias("returned"),
        )
    )


def _ranked(rows: DataFrame, scan: DataFrame, n: int, by: str, name: str) -> DataFrame:
    """Position within the round by a descending value, then by driver."""
    descending = {"_by": -F.col(by)}
    groups = ordered_groups(scan.withColumns(descending), ["year", "round"], ["_by", "driverId"], n)
    return add_running(rows.withColumns(descending), groups, {name: row_number()}).drop("_by")


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The raw tables, written once per session and read back as a source would be."""
    monthly = staged_once(spark, f"monthly:{sf_dir}", lambda: _monthly(spark, sf_dir))
    n = monthly.count()
    race_id = (F.col("year") * 100 + F.col("round")).alias("raceId")

    def results() -> DataFrame:
        ranked = _ranked(monthly, monthly, n, "qty", "positionOrder")
        ranked = _ranked(ranked, monthly, n, "n", "by_count")
        teams = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
            F.col("s_suppkey").alias("driverId"), F.col("s_nationkey").alias("constructorId")
        )
        position = F.col("positionOrder")
        points = F.coalesce(F.get(F.array(*[F.lit(p) for p in POINTS]), position - 1), F.lit(0.0))
        return ranked.join(teams, "driverId", "left").select(
            race_id, "driverId", "constructorId",
            F.when(F.col("returned") * 2 > F.col("qty"), 2).otherwise(1).alias("statusId"),
            "positionOrder",
            F.when(position % 7 == 0, "\\N").otherwise(F.col("by_count").cast("string")).alias("grid"),
            points.alias("points"),
            F.col("n").alias("laps"),
        )

    def qualifying() -> DataFrame:
        timed = monthly.filter("open_qty IS NOT NULL")
        timed = _ranked(timed, timed, n, "open_qty", "position")
        return timed.select(race_id, "driverId", "position")

    def races() -> DataFrame:
        month = F.col("round")
        return monthly.select("year", "round").distinct().select(
            race_id, "year", "round", month.alias("circuitId"),
            F.concat(F.lit("Race "), month).alias("name"),
            F.make_date("year", month, F.lit(1)).alias("date"),
        )

    def drivers() -> DataFrame:
        name = F.split("s_name", "#")
        return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
            F.col("s_suppkey").alias("driverId"),
            name.getItem(0).alias("forename"), name.getItem(1).alias("surname"),
        )

    def constructors() -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
            F.col("n_nationkey").alias("constructorId"), F.col("n_name").alias("name")
        )

    def circuits() -> DataFrame:
        month = F.col("round")
        return monthly.select("round").distinct().select(
            month.alias("circuitId"), F.concat(F.lit("Circuit "), month).alias("name")
        )

    tables = {
        name: staged_once(spark, f"star-{name}:{sf_dir}", build)
        for name, build in {
            "results": results, "races": races, "qualifying": qualifying, "circuits": circuits,
        }.items()
    }
    return tables | {
        "drivers": drivers(),
        "constructors": constructors(),
        "status": spark.sql("SELECT * FROM VALUES (1, 'Finished'), (2, 'Retired') AS t(statusId, status)"),
    }


def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean race rows of the star, written once per session."""
    return staged_once(spark, f"rows:{sf_dir}", lambda: race_rows(star_tables(spark, sf_dir)))
