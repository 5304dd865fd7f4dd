"""From raw documents to mixed, encoded training text: stages that each take and return a table of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridline.llm import jaccard, mixing, pieces, quality, secret_scan
from gridline.llm.queries import PIECE_MODEL, tokenizer_path
from gridline.session import scratch_dir


def _free_name(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    name = "_stage"
    while name in docs.columns:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the others go, null and empty texts among them.

    Repeated rows and ids are judged one by one, an empty table stays empty, other columns pass.
    """
    out = _free_name(docs)
    return quality.quality(docs, out=out).where(F.col(out)["kept"]).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five words, similarity 0.8 or more.

    Rows with one id are one document, of which the row with the smallest text stays (then by the
    other columns); rows without an id stay, as do null and empty texts. An empty table stays empty.
    """
    kept = jaccard.jaccard_components(docs, k=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    plain = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*plain)))
    free = _free_name(docs)
    with_id = docs.join(kept, "doc_id", "left_semi").withColumn(free, nth).where(F.col(free) == 1)
    return with_id.select(*docs.columns).union(docs.where("doc_id is null")).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced, and n_chars counted again where it was.

    Null and empty texts stay as they are, repeated rows agree, an empty table stays empty; a null
    text has a null n_chars.
    """
    clean = secret_scan.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files by name, and rows within a file.

    A null source is a source of its own, as is ``''`` with it; null texts and ids, repeated rows and
    other columns stay; an empty table stays empty.
    """
    out = _free_name(docs)
    rows = mixing.mixed(docs, out=out)
    return rows.repartitionByRange(f"{out}.position").sortWithinPartitions(f"{out}.position").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of each document.

    A null text counts as empty and has the end id only; null ids, repeated rows and empty tables
    pass through; other columns go.
    """
    return pieces.encoded(docs, tokenizer_path(PIECE_MODEL), digest=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("mixing_sources", mixing_stage),
    ("sentencepiece", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex[:8]}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express connected components of similar sets, learned formats or subword merges; tests compare with brute force.
ORACLE_SQL = None
