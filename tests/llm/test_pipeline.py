"""The corpus pipeline against each stage's operator applied by brute force."""

import hashlib

import corpus_pipeline
import sentencepiece
from gridline.llm import mixing, quality, secret_scan
from gridline.llm.queries import PIECE_MODEL, tokenizer_path
from test_exact import _brute_sets


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r.text for r in quality.quality(docs).where("quality.kept").collect()}
    stay = {i for i, (_, c) in _brute_sets(kept.items(), 5, 80).items() if i == c}
    frame = docs.where(docs.doc_id.isin(sorted(stay)))
    found = secret_scan.fit(frame)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    want = {}
    for i in stay:
        text, at, clean = kept[i], 0, []
        for _, a, b in found.spans(text):
            if a >= at:
                clean += [text[at:a], "[secret]"]
            at = max(at, b)
        ids = library.encode("".join([*clean, text[at:]]), add_eos=True)
        want[i] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(stay) < len(kept) < docs.count()


def test_stages_keep_the_columns_and_survive_odd_rows(spark, odd, none):
    docs = odd.withColumnsRenamed({"quality": "mix"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema == docs.schema, name
        assert stage(spark, none, "").count() == 0
    assert corpus_pipeline.near_duplicate_stage(spark, docs, "").count() == 7
    assert corpus_pipeline.mixing_stage(spark, docs, "").count() == 10


def test_mixing_stage_writes_the_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus_pipeline.mixing_stage(spark, docs, sf_dir).write.parquet(str(tmp_path / "m"))
    place = {r.doc_id: r.mix.position for r in mixing.mixed(docs).collect()}
    order = [r.doc_id for f in sorted((tmp_path / "m").glob("part-*.parquet")) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert [place[i] for i in order] == sorted(place.values())


def test_one_row_of_an_id_by_its_text(spark):
    """Of different texts with one id the smallest stays, wherever the rows lie; a column of the stage's own name stays."""
    rows = [(1, "b text", "x"), (1, "a text", "y"), (1, "c text", "z"), (2, None, "x"), (2, "", "y"), (None, "q", "x"), (None, "q", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _stage string")
    for n in (1, 5):
        got = corpus_pipeline.near_duplicate_stage(spark, docs.repartition(n), "")
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a text", "y"), (2, None, "x"), (None, "q", "x"), (None, "q", "x")], key=str)
