"""The physical plans stay the ones meant: few shuffles, pruned scans, no Python on the rows."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gridline import catalog
from gridline.operators.sequences import build_sequences, sequence_rows
from gridline.plans import form
from gridline.plans.race_rows import joined_results
from gridline.plans.season_star import clean_rows
from gridline.session import GROUP_ROWS_KEY
from gridline.sources.scratch import staged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def fact_shuffles(text):
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", re.sub(r"#\d+L?", "", text))


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return clean_rows(spark, sf_dir)


def test_driver_features_shuffle_once(rows):
    assert fact_shuffles(plan(form.driver_level(rows))) == ["driverId"]


def test_season_and_team_features_shuffle_once_more(rows):
    by_driver = staged(form.driver_level(rows))
    text = plan(form.season_level(form.team_form(by_driver), by_driver))
    assert fact_shuffles(text) == ["constructorId, year"]
    assert text.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in text


def test_champions_and_ranks_have_no_window_over_a_season(rows):
    by_driver = staged(form.driver_level(rows))
    text = plan(form.with_champions(by_driver, by_driver))
    assert fact_shuffles(text) == [] and "Window" not in text
    text = plan(form.with_season_ranks(by_driver, by_driver))
    assert "Window" not in re.sub(r"_range|_start", "", text).replace("Window [sum(_n", "") and "season_total_points" not in "".join(fact_shuffles(text))


def test_sequences_keep_five_rows_before_the_shuffle(spark, sf_dir):
    champ = contract.queries()["champ_features"](spark, sf_dir)
    text = plan(build_sequences(sequence_rows(champ)))
    assert len(fact_shuffles(text)) == 1 and text.count("WindowGroupLimit") == 2


def test_unused_columns_are_not_read(spark, sf_dir):
    text = contract.queries()["constructor_dominance"](spark, sf_dir)._jdf.queryExecution().toString()
    assert re.search(r"ReadSchema: struct<points:double,constructor_name:string,\w+:int,\w+:int>", text)


def test_year_filter_reaches_the_scan(rows):
    text = rows.filter("year <= 1999").groupBy("driver_name").count()._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(year), LessThanOrEqual(year,1999)]" in text


def test_no_python_and_no_cartesian_product(spark, sf_dir):
    models = {"race_winner_scores", "race_winner_metrics", "feature_importance", "season_outcome_scores"}
    for name, build in catalog.QUERIES.items():
        if name in models or name.endswith("_in_blocks"):
            continue
        text = plan(build(spark, sf_dir))
        for bad in ("Python", "Pandas", "CartesianProduct", "NestedLoopJoin"):
            assert bad not in text, (name, bad)


def _hot_tables(spark, path):
    """Drivers too many to broadcast, a third of the results on one of them, some without a driver."""
    n, drivers = 400_000, 40_000
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % drivers).cast("bigint")
    spark.range(n).select(
        F.col("id").alias("resultId"), (F.col("id") % 50).cast("int").alias("raceId"), hot.alias("driverId"),
        F.lit(1).alias("constructorId"), F.lit(1).alias("statusId"), F.lit("1").alias("positionOrder"),
        F.sha2(F.col("id").cast("string"), 256).alias("grid"), F.lit(1.0).alias("points"),
    ).write.parquet(f"{path}/results")
    spark.range(drivers).select(
        F.col("id").alias("driverId"), F.sha2(F.col("id").cast("string"), 256).alias("forename"), F.lit("x").alias("surname")
    ).write.parquet(f"{path}/drivers")
    return n, {
        "results": spark.read.parquet(f"{path}/results"),
        "drivers": spark.read.parquet(f"{path}/drivers"),
        "races": spark.sql("SELECT 1 raceId, 2000 year, 1 round, 1 circuitId, 'r' name, DATE'2000-01-01' date"),
        "circuits": spark.sql("SELECT 1 circuitId, 'c' name"),
        "constructors": spark.sql("SELECT 1 constructorId, 't' name"),
        "status": spark.sql("SELECT 1 statusId, 'Finished' status"),
        "qualifying": spark.sql("SELECT 1 raceId, 1L driverId, 1 position"),
    }


def test_join_on_a_hot_driver_is_spread_without_adaptive_help(spark, tmp_path):
    n, tables = _hot_tables(spark, str(tmp_path))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "100k",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
        GROUP_ROWS_KEY: "20000",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = joined_results(tables)
        assert rows.columns[0] == "driverId" and "_key_part" not in rows.columns
        kept = rows.select("resultId", "driverId", "driver_name", "grid").withColumn("task", F.spark_partition_id())
        assert "SortMergeJoin [driverId" in re.sub(r"#\d+L?", "", plan(kept))
        sizes = sorted(r["count"] for r in kept.groupBy("task").count().collect())
        assert sum(sizes) == n and sizes[-1] < 2 * sizes[len(sizes) // 2], sizes
        wrong = kept.where("driverId is not null and driver_name <=> null or driverId is null and driver_name is not null")
        assert wrong.count() == 0 and kept.select("resultId").distinct().count() == n
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
