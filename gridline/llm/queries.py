"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from . import (
    contamination, embed_dedup, jaccard, merkle, mixing, pieces, quality, runs, secret_scan, substring, token_files, toxicity, url_filter,
)

PIECE_MODEL, BYTE_BPE = "piece_bpe_32k.model", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", *(columns or ["text"]))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "filter.*")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(_documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "learned")
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS],
                       F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality(_documents(spark, sf_dir))
    return rows.select("doc_id", *[f"quality.{c}" for c in quality.BASE], "quality.base_failed", "quality.kept")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir, "source")).select("doc_id", "source", "mix.*")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_documents(spark, sf_dir), keep_text=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir, "text", "lang"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "toxicity.*")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_documents(spark, sf_dir), tokenizer_path(PIECE_MODEL), digest=True)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex[:8]}"
    token_files.write_tokens(_documents(spark, sf_dir), path, tokenizer_path(BYTE_BPE))
    return token_files.read_tokens(spark, path, ids=False)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination.find(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    items = F.col("benchmark.items")
    return rows.select("doc_id", "benchmark.n_words", "benchmark.n_hit", F.size(items).cast("long").alias("n_items"),
                       F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("benchmark.n_hit") > 0).alias("contaminated"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.periodic_runs(_documents(spark, sf_dir), digest=True, change=runs.planted)
    every = F.col("runs.runs")
    key = lambda r: F.struct(-r["length"], r["start"], r["period"])
    first = F.array_min(F.transform(every, key))
    length, period = -first["col1"], first["period"]
    lines = F.transform(every, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select("doc_id", F.size(every).cast("long").alias("n_runs"), first["start"].alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                       F.col("runs.collapsed").alias("collapsed_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _table(spark, sf_dir, "documents").select(fields)
    more = [F.col(c).cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in fields]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.unhex(merkle.leaf_digest(more)))
    rows = merkle.manifest(docs, fields, carry={"tampered": tampered})
    rows = rows.withColumn("folded_root", merkle.folded(F.coalesce(F.lower(F.hex("carry.tampered")), "leaf")))
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof(), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_secret_scan, op3_quality_rules, op4_mix_sources, op5_embedding_dedup, op6_substring_dedup,
    op7_toxicity, op8_sentencepiece, op9_token_files, op10_jaccard_join,
    op11_decontamination, op12_periodic_runs, op13_merkle_manifest)}
