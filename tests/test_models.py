"""Model jobs: splits, determinism, ranges and outputs."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gridline.fixed import RACE_MODEL_FEATURES
from gridline.functions.columns import sigmoid
from gridline.operators import medians
from gridline.operators.medians import fill_medians
from gridline.plans import features, race_model, reports, season_model
from gridline.plans.season_star import TRAIN_CUTOFF, VALIDATION_YEARS, star_tables
from gridline.sources.sinks import published, published_folder

SMALL = {"numTrees": 10, "maxDepth": 4}


@pytest.fixture(scope="module")
def results(spark, sf_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("results"))
    features.run(star_tables(spark, sf_dir), out)
    return out


@pytest.fixture(scope="module")
def race(spark, results):
    return spark.read.parquet(f"{results}/race_features.parquet")


def test_missing_model_column(race):
    with pytest.raises(ValueError, match="grid"):
        race_model.model_rows(race.drop("grid"))


def test_rows_without_target_are_dropped(race):
    rows = race.withColumn("is_winner", F.when(F.col("round") > 1, F.col("is_winner")))
    assert race_model.model_rows(rows).count() == race.filter("round > 1").count()


def test_temporal_split(race):
    train, test = race_model.temporal_split(race_model.model_rows(race), TRAIN_CUTOFF)
    assert train.agg(F.max("year")).first()[0] == TRAIN_CUTOFF
    assert test.agg(F.min("year")).first()[0] == TRAIN_CUTOFF + 1


def test_fallback_split_is_stable_and_whole(race):
    rows = race_model.model_rows(race)
    train, test = race_model.temporal_split(rows, 9999)
    again, _ = race_model.temporal_split(rows.repartition(13), 9999)
    n = rows.count()
    assert train.count() + test.count() == n and 0.7 < train.count() / n < 0.9
    assert train.exceptAll(again).count() == 0


def test_race_job(spark, race, results):
    metrics = race_model.run(race, results, TRAIN_CUTOFF, **SMALL)
    assert all(0 <= metrics[m] <= 1 for m in ("accuracy", "f1", "auc")) and metrics["auc"] > 0.8
    assert metrics["train_rows"] + metrics["test_rows"] == metrics["rows"] == race.count()
    scored = published(spark, f"{results}/race_winner_predictions.parquet")
    assert scored.columns == ["year", "round", "driver_name", "constructor_name", "is_winner", "prediction", "winner_probability"]
    assert scored.count() == race.filter(F.col("year") > TRAIN_CUTOFF).count()
    low, high = scored.agg(F.min("winner_probability"), F.max("winner_probability")).first()
    assert 0 <= low <= high <= 1
    again = race_model.run(race, results, TRAIN_CUTOFF, **SMALL)
    assert again == pytest.approx(metrics)


def test_season_job(spark, results):
    champ = spark.read.parquet(f"{results}/champ_features.parquet")
    metrics = season_model.run(champ, results, TRAIN_CUTOFF, VALIDATION_YEARS)
    assert 0 <= metrics["min_prob"] <= metrics["mean_prob"] <= metrics["max_prob"] <= 1
    assert 0 <= metrics["top3"] <= metrics["top5"] <= 1
    picks = spark.read.option("header", True).csv(published_folder(spark, f"{results}/championship_predictions.csv"))
    assert picks.columns == ["year", "predicted", "actual", "prob", "correct"]
    assert [r.year for r in picks.collect()] == ["2000", "2001"]
    with pytest.raises(ValueError, match="validation"):
        season_model.run(champ, results, TRAIN_CUTOFF, 0)


def test_exports(spark, results, tmp_path):
    reports.export_all(spark, results, str(tmp_path))
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(published_folder(spark, f"{tmp_path}/{name}.csv"))
    importance = read("feature_importance")
    assert importance.columns == ["feature", "importance", "importance_pct"]
    assert {r.feature for r in importance.collect()} == set(RACE_MODEL_FEATURES)
    assert importance.agg(F.sum("importance_pct")).first()[0] == pytest.approx(1)
    teams = [r.avg_points for r in read("constructor_dominance").collect()]
    assert teams == sorted(teams, reverse=True)
    wins = [r.wins for r in read("driver_statistics").collect()]
    assert wins == sorted(wins, reverse=True)
    predictions = read("race_predictions").collect()
    keys = [(r.year, r["round"], -r.winner_probability) for r in predictions]
    assert keys == sorted(keys)
    assert read("championship_predictions").count() == 2


def test_season_probability_is_the_sigmoid_of_the_score(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "x double").select(sigmoid(F.col("x")).alias("p"))
    assert [r.p for r in df.collect()] == pytest.approx([0.1192029, 0.5, 0.9525741])


def test_fill_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5), (float("nan"), 7), (4.0, 9), (8.0, 11)], "a double, b int")
    got = [(r.a_imputed, r.b_imputed) for r in fill_medians(df, ["a", "b"]).collect()]
    assert got == [(1.0, 7.0), (2.0, 5.0), (2.0, 7.0), (4.0, 9.0), (8.0, 11.0)]


def test_narrowed_medians_are_exact(spark, monkeypatch):
    rnd = random.Random(11)
    for steps, accuracy, n in ((200, 10_000, 400), (4, 10, 3000)):
        monkeypatch.setattr(medians, "STEPS", steps)
        monkeypatch.setattr(medians, "ACCURACY", accuracy)
        rows = [(rnd.choice([None, float("nan"), 1.0, 2.0, 3.0]), 10.0 ** rnd.randint(-300, 300) * rnd.choice([-1, 1]), rnd.randrange(3), None,
                 float("inf") if i % 3 else -1.0, rnd.random()) for i in range(n)]
        df = spark.createDataFrame(rows, "a double, b double, c int, d double, e double, f double")
        got = medians.narrowed_medians(df, df.columns)
        for j, c in enumerate(df.columns):
            values = sorted(float(r[j]) for r in rows if r[j] is not None and r[j] == r[j])
            assert got[c] == (values[(len(values) - 1) // 2] if values else None), (c, steps)


def test_imputer_needs_a_value(spark, race):
    rows = race_model.model_rows(race).withColumn("grid", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="grid"):
        race_model.imputer(rows)


@pytest.mark.parametrize("name", ["race_winner_scores", "race_winner_metrics", "feature_importance", "fallback_split", "season_outcome_scores"])
def test_model_queries_have_rows(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0


def test_training_rows_come_in_bounded_partitions(spark, monkeypatch):
    """A partition of any size is dealt out; small ones are left as they are, with the columns of the model only."""
    rows = spark.range(1000, numPartitions=1).select(F.lit("x").alias("driver_name"), *[F.rand(i).alias(c) for i, c in enumerate(RACE_MODEL_FEATURES)],
                                                     (F.col("id") % 20 == 0).cast("double").alias("is_winner"))
    whole = race_model.training_rows(rows)
    assert whole.columns == [*RACE_MODEL_FEATURES, "is_winner"] and whole.rdd.getNumPartitions() == 1
    monkeypatch.setattr(race_model, "PARTITION_ROWS", 100)
    dealt = race_model.training_rows(rows)
    assert [len(p) for p in dealt.rdd.glom().collect()] == [100] * 10
    assert dealt.exceptAll(whole).count() == 0
