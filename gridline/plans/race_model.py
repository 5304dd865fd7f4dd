"""Race-winner forest: load, split, fit, score, importance."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import FOREST, RACE_MODEL_FEATURES, RACE_TARGET, RANDOM_SEED, TRAIN_CUTOFF
from ..functions.columns import keep_existing, require_columns
from ..operators.forest import forest_score
from ..operators.medians import narrowed_medians
from ..operators.scoring import classification_metrics, exact_auc
from ..sources.scratch import staged
from ..sources.sinks import reused, save_model, write_parquet

#: Training rows of one partition, 200 MB of them as the forest keeps them.
PARTITION_ROWS = 200_000
_IDS = ["year", "round", "driver_name", "constructor_name"]


def model_rows(race: DataFrame) -> DataFrame:
    """Ids, features and target as doubles; rows without target dropped. [S5, S6, P21, P22]"""
    needed = [*RACE_MODEL_FEATURES, RACE_TARGET]
    rows = keep_existing(require_columns(race, needed), [*_IDS, *needed])
    return rows.withColumns({c: F.col(c).cast("double") for c in needed}).filter(
        F.col(RACE_TARGET).isNotNull()
    )


def row_counts(rows: DataFrame, cutoff: int = TRAIN_CUTOFF) -> DataFrame:
    """Rows, winners, train rows and test rows in one pass. [A8]"""
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(RACE_TARGET) == 1).alias("winners"),
        F.count_if(F.col("year") <= cutoff).alias("train_rows"),
        F.count_if(F.col("year") > cutoff).alias("test_rows"),
    )


def temporal_split(rows: DataFrame, cutoff: int = TRAIN_CUTOFF) -> tuple[DataFrame, DataFrame]:
    """Train up to the cut-off year, test after it; 80/20 by a hash of the ids if no test year exists. [M1, M2, P24]

    The hash depends on the row's ids alone, so the fallback is the same however the data is
    partitioned or recomputed, and in any engine with MD5.
    """
    test = rows.filter(F.col("year") > cutoff)
    if not test.isEmpty():
        return rows.filter(F.col("year") <= cutoff), test
    ids = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _IDS if c in rows.columns]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(RANDOM_SEED)), *ids).cast("binary")), 1, 7)
    part = F.conv(digits, 16, 10).cast("int") % 100
    return rows.filter(part < 80), rows.filter(part >= 80)


def training_rows(train: DataFrame) -> DataFrame:
    """Features and target only, in partitions of about `PARTITION_ROWS` rows at most.

    The forest keeps a count for each of its trees with every row, about a kilobyte, and a task
    reads a whole partition of them at every level. Small partitions stay as they are.
    """
    rows = train.select(*RACE_MODEL_FEATURES, RACE_TARGET)
    sizes = rows.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    return rows if not total or most <= PARTITION_ROWS else rows.repartition(-(-total // PARTITION_ROWS))


def imputer(train: DataFrame) -> ImputerModel:
    """Fills missing features with their exact medians in the training rows. [M4]

    The medians are found by `narrowed_medians`; the imputer is fitted on one row that has them.
    """
    medians = narrowed_medians(train, RACE_MODEL_FEATURES)
    if unknown := [c for c, m in medians.items() if m is None]:
        raise ValueError(f"no training row has a value of {unknown}")
    row = train.sparkSession.createDataFrame([tuple(medians.values())], ", ".join(f"{c} double" for c in medians))
    return Imputer(strategy="median", inputCols=RACE_MODEL_FEATURES, outputCols=[f"{c}_imputed" for c in RACE_MODEL_FEATURES]).fit(row)


def fit(train: DataFrame, **params) -> PipelineModel:
    """Median imputer, assembler, random forest. [M4-M7]"""
    return Pipeline(stages=[
        imputer(train),
        VectorAssembler(inputCols=[f"{c}_imputed" for c in RACE_MODEL_FEATURES], outputCol="features"),
        RandomForestClassifier(labelCol=RACE_TARGET, featuresCol="features", **(FOREST | params)),
    ]).fit(train)


def predictions(scored: DataFrame) -> DataFrame:
    """[M10, P29, T3]"""
    probability = vector_to_array("probability").getItem(1).alias("winner_probability")
    # A sort samples its input first; written rows keep the trees from being run twice.
    return in_order(staged(scored.select(*_IDS, RACE_TARGET, "prediction", probability), "scored-rows"))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("winner_probability"), *_IDS)


def compiled_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Ids, target and ``winner_probability`` by the forest's nodes as expressions, without ML vectors. [M10, P29]"""
    filled = model.stages[0].transform(rows)
    scored = forest_score(filled, model.stages[-1], [f"{c}_imputed" for c in RACE_MODEL_FEATURES], "winner_probability")
    return scored.select(*_IDS, RACE_TARGET, "winner_probability")


def evaluate(scored: DataFrame) -> DataFrame:
    """Confusion counts, accuracy, weighted F-measure and exact area, one row, of `predictions`. [M8, M9]"""
    area = exact_auc(scored, RACE_TARGET, "winner_probability")
    return classification_metrics(scored, RACE_TARGET).withColumn("auc", area.scalar())


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row per model feature, most important first. [M11, P32, T12]"""
    weights = [float(w) for w in model.stages[-1].featureImportances.toArray()]
    total = sum(weights)
    rows = [(f, w, w / total if total > 0 else 0.0) for f, w in zip(RACE_MODEL_FEATURES, weights)]
    return spark.createDataFrame(
        rows, "feature STRING, importance DOUBLE, importance_pct DOUBLE"
    ).orderBy(F.desc("importance"), "feature")


def run(race: DataFrame, out: str, cutoff: int = TRAIN_CUTOFF, **params) -> dict[str, float]:
    """Fit, evaluate, write predictions and the model below ``out``; returns row counts and metrics. [K3, K6, K7, A8]"""
    rows = model_rows(race)
    counts = row_counts(rows, cutoff).first().asDict()
    train, test = temporal_split(rows, cutoff)
    with reused(training_rows(train)) as kept:
        model = fit(kept, **params)
    scored = predictions(model.transform(test))
    write_parquet(scored, f"{out}/race_winner_predictions.parquet")
    save_model(model, f"{out}/race_winner_forest")
    return counts | evaluate(scored).first().asDict()
