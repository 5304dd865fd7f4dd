"""Evaluation of scored rows: picks, top-k accuracy, exact AUC, confusion metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .groups import ordered_groups
from .ranking import first_rows, top_rows
from .running import Running, add_running


def champion_picks(scored: DataFrame) -> DataFrame:
    """Most probable driver and true champion of each season. [T9, J10, P30, P31, M18]

    ``scored`` has driver_id, driver_name, year, label and prob. Both picks are
    partial aggregates, so one row per season and task is shuffled. Equal
    probabilities go to the first driver_id in text order; a driver without one is no pick. Halves round to even.
    """
    is_champion = F.col("label") == 1
    seasons = scored.groupBy("year").agg(
        F.min_by("driver_name", F.when(F.col("prob").isNotNull(), F.struct(-F.col("prob"), "driver_id"))).alias("predicted"),
        F.min_by(F.when(is_champion, F.col("driver_name")), F.when(is_champion, F.col("driver_id"))).alias("actual"),
        F.max("prob").alias("prob"),
    )
    actual = F.coalesce("actual", F.lit("?"))
    return seasons.select(
        "year", "predicted", actual.alias("actual"), F.bround("prob", 3).alias("prob"),
        F.coalesce(F.col("predicted") == actual, F.lit(False)).cast("int").alias("correct"),
    ).orderBy("year")


def pick_accuracy(picks: DataFrame) -> DataFrame:
    """[A12]"""
    return picks.agg(F.avg("correct").alias("accuracy"))


def top_k_accuracy(scored: DataFrame, k: int) -> DataFrame:
    """Share of seasons with a champion whose name is among the k most probable. [T10, M19]"""
    is_champion = F.col("label") == 1
    actual = (
        scored.filter(is_champion)
        .groupBy("year")
        .agg(F.min_by("driver_name", "driver_id").alias("actual"))
    )
    top = first_rows(scored, ["year"], [F.desc("prob"), "driver_id"], k, "place")
    hits = (
        top.join(actual, "year")
        .groupBy("year")
        .agg(F.max(F.coalesce(F.col("driver_name") == F.col("actual"), F.lit(False)).cast("int")).alias("hit"))
    )
    return hits.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("accuracy")).select(
        F.lit(k).alias("k"), "accuracy"
    )


def exact_auc(scored: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """ROC-AUC from average ranks, ties counted half. [M17]

    Rows collapse to one per distinct score first; the ranks are running counts
    over those, which ``ordered_groups`` keeps parallel however many there are.
    """
    by_score = staged(
        scored.groupBy(F.col(score).alias("score")).agg(
            F.lit(0).alias("all"),
            F.count("*").alias("n"),
            F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("positives"),
        ),
        "scores",
    )
    groups = ordered_groups(by_score, ["all"], ["score"])
    ranked = add_running(by_score, groups, {"below": Running("sum", "n", None, -1)})
    mean_rank = F.coalesce("below", F.lit(0)) + (F.col("n") + 1) / 2.0
    sums = ranked.agg(
        F.sum(F.col("positives") * mean_rank).alias("rank_sum"),
        F.sum("positives").alias("p"),
        F.sum(F.col("n") - F.col("positives")).alias("q"),
    )
    p, q = F.col("p"), F.col("q")
    area = (F.col("rank_sum") - p * (p + 1) / 2.0) / F.nullif(p * q, F.lit(0)).cast("double")
    return sums.select(area.alias("auc"))


def score_summary(scored: DataFrame) -> DataFrame:
    """[A13]"""
    return scored.agg(
        F.min("prob").alias("min_prob"), F.max("prob").alias("max_prob"), F.avg("prob").alias("mean_prob")
    )


def highest_scores(scored: DataFrame, k: int = 5) -> DataFrame:
    """[T11]"""
    order = [F.desc("prob"), "driver_id", "year"]
    return top_rows(scored.select("driver_id", "driver_name", "year", "prob"), order, k)


def classification_metrics(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and F-measure weighted by class size, from one pass. [M9]"""
    y, guess = F.col(label) == 1, F.col(prediction) == 1
    counts = predicted.agg(
        F.count_if(y & guess).alias("tp"), F.count_if(~y & guess).alias("fp"),
        F.count_if(y & ~guess).alias("fn"), F.count_if(~y & ~guess).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn

    def f_measure(hit):
        """2 hits / (2 hits + misses of either kind); 0 for a class never seen nor guessed."""
        size = 2 * hit + fp + fn
        return F.coalesce(2 * hit / F.nullif(size, F.lit(0)), F.lit(0.0))

    weighted = ((tp + fn) * f_measure(tp) + (tn + fp) * f_measure(tn)) / total
    return counts.select(
        "tp", "fp", "fn", "tn", ((tp + tn) / total).alias("accuracy"), weighted.alias("f1")
    )


def weighted_log_loss(scored: DataFrame, label: str, prob: str, weight: str) -> DataFrame:
    """Mean weighted negative log-likelihood. [M16]"""
    p = F.least(F.greatest(F.col(prob), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))
    return scored.agg((F.sum(F.col(weight) * loss) / F.sum(weight)).alias("loss"))
