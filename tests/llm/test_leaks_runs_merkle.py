"""Benchmark windows, periodic runs and Merkle manifests against brute force, and on rows out of the ordinary."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from gridline.llm import contamination, merkle, runs
from gridline.llm.texts import Flat
from gridline.operators.places import numbered

QUERIES = contract.queries()


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


# Benchmark windows


def _words(text):
    return [(m[0].lower() if m[0].isascii() else re.sub("[A-Z]", lambda c: c[0].lower(), m[0]), m.start(), m.end())
            for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _leaks(text, items, k):
    words, hit, found = _words(text), set(), set()
    for i, t in items:
        own = [w for w, _, _ in _words(t)]
        n = min(k, len(own))
        for a in range(len(own) - n + 1) if n else ():
            for b in range(len(words) - n + 1):
                if [w for w, _, _ in words[b:b + n]] == own[a:a + n]:
                    hit.update(range(b, b + n))
                    found.add(str(i))
    spans = []
    for j in sorted(hit):
        if spans and spans[-1][2] == j - 1:
            spans[-1][1:] = words[j][2], j
        else:
            spans.append([words[j][1], words[j][2], j])
    return len(words), len(hit), sorted(found), [(a, b) for a, b, _ in spans]


ITEMS = [(1, "alpha beta gamma delta"), (20, "Straße,ÄB x"), (3, "yes"), (3, "no-one"), (4, None), (5, ""), (None, "beta gamma yes"),
         (7, "alpha beta gamma delta"), (8, "a a a a")]
TEXTS = ["ALPHA beta; gamma -- delta yes", "alpha beta gamma", "é straße äb X", "é straße Äb X no one", None, "", "a a a a a b a a", "yes" * 3, " . ",
         "x beta gamma yes alpha beta gamma delta" + " pad" * 50, "no\x00one 日本 alpha beta gamma"]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 12])
@pytest.mark.parametrize("k", [1, 2, 3, 10])
def test_leaks(spark, k, shard_bytes):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, item_id string, benchmark string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for r in contamination.find(docs, items, k=k, shard_bytes=shard_bytes).collect():
        n, hit, names, spans = _leaks(r.text, ITEMS, k)
        b = r.benchmark
        assert (b.n_words, b.n_hit, b["items"], [tuple(s) for s in b.spans]) == (n, hit, [x for x in names if x != "None"], spans), r.text
        assert r.item_id == "x"


def test_leaks_odd_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination.find(none, items).count() == 0
    assert all(r.benchmark.n_hit == 0 and r.benchmark.spans == [] for r in contamination.find(odd, items.where("item_id = 4")).collect())
    assert contamination.find(odd, items).count() == 10
    long = "word " * 600_000 + "alpha beta gamma delta" + " tail" * 600_000
    row = contamination.find(spark.createDataFrame([(1, long)], "doc_id long, text string"), items, k=4).first().benchmark
    assert (row.n_words, row.n_hit, row["items"]) == (1_200_004, 4, ["1", "7"])
    assert [tuple(s) for s in row.spans] == [(3_000_000, 3_000_022)]


# Periodic runs


def _brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i) + 1
    return sorted(out)


def test_lyndon_words_and_runs():
    random.seed(5)
    seen = 0
    for _ in range(3000):
        w = [random.randint(1, random.randint(1, 4)) for _ in range(random.randint(0, 30))]
        for _ in range(random.randint(0, 3)):
            u = w[:random.randint(1, 7)]
            w = w[:random.randint(0, len(w))] + u * random.randint(2, 8) + w[random.randint(0, len(w)):]
        if len(w) < 60:
            longest = [next((j for j in range(i + 1, len(w)) if w[j:] <= w[i:]), len(w)) - i for i in range(len(w))]
            assert runs.lyndon_lengths(w) == longest
        want = _brute_runs(w)
        seen += len(want)
        assert runs.find_runs(np.array(w, np.int64)) == want
        text = " ".join(map(str, w)).encode()
        flat = Flat(np.frombuffer(b"0 0 0 " + text + b" 0", np.uint8), np.array([0, 6, 6 + len(text), 8 + len(text)]))
        assert runs.find_runs(np.array(w, np.int64), runs.stretches(flat)[1]) == want
    assert seen > 2000


def test_runs_of_the_documents(spark, sf_dir, texts):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    some = 0
    for i, t in texts.items():
        w, h = re.findall("[^\x20\x09-\x0D]+", t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
        if len(w) > 1500:
            continue  # the plain search takes too long
        found = _brute_runs(w)
        some += len(found)
        drop = {j for s, n, q in found for j in range(s + q, s + n)}
        r = got[i]
        assert r.n_runs == len(found) and r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == sha(" ".join(x for j, x in enumerate(w) if j not in drop))
        s, n, q = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, found and 1000 * n // q or None)
    assert some > 5


def test_runs_odd_rows(spark, odd, none):
    docs = odd.withColumn("runs", odd["source"]).withColumn("start", F.lit(1))
    got = {(r.doc_id, r.text): r for r in runs.periodic_runs(docs).collect()}
    assert runs.periodic_runs(docs).count() == 10 and runs.periodic_runs(none).count() == 0
    row = got[1, "the quick brown fox jumps over the lazy dog and runs through the dark wood at night " * 4]
    assert [tuple(x) for x in row.runs.runs] == [(0, 68, 17)] and row.runs.collapsed == row.text[:84].strip() and row.start == 1
    assert got[3, None].runs.collapsed == "" and got[5, " \n\t "].runs.runs == [] and got[7, "ONE  two\n"].runs.collapsed == "ONE two"
    long = spark.createDataFrame([(1, "a b " * 500_000 + "é " + "x " * 1_000_000)], "doc_id long, text string")
    row = runs.periodic_runs(long).first().runs
    assert [tuple(x) for x in row.runs] == [(0, 1_000_000, 2), (1_000_001, 1_000_000, 1)] and row.collapsed == "a b é x"
    planted = runs.periodic_runs(odd, change=runs.planted).where("doc_id is null").first().runs
    assert planted.runs == []


# Merkle manifests


def _tree(digests, arity):
    """(root, path of each leaf: (digests before, digests after) by level)."""
    level, groups, paths = digests, [[i] for i in range(len(digests))], [[] for _ in digests]
    while len(level) > 1:
        above, members = [], []
        for a in range(0, len(level), arity):
            run = level[a:a + arity]
            for j, leaves in enumerate(groups[a:a + arity]):
                for x in leaves:
                    paths[x].append((run[:j], run[j + 1:]))
            above.append(sha("".join(run)))
            members.append([x for leaves in groups[a:a + arity] for x in leaves])
        level, groups = above, members
    return level[0], paths


def _brute_manifest(rows, arity):
    """(doc_id, leaf, subroot, root, all siblings) of rows (doc_id, lang, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1], []).append((r[0], sha("".join(map(field, r)))))
    langs = sorted(leaves, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for v in langs:
        leaves[v].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[v] = _tree([d for _, d in leaves[v]], arity)
    root, above = _tree([trees[v][0] for v in langs], arity)
    return sorted((str(k), d, trees[v][0], root, "".join("".join(a + b) for a, b in trees[v][1][i] + above[j]))
                  for j, v in enumerate(langs) for i, (k, d) in enumerate(leaves[v]))


@pytest.mark.parametrize("arity,one_task", [(2, 20_000), (2, 18), (3, 0), (5, 30)])
def test_manifest(spark, monkeypatch, arity, one_task):
    monkeypatch.setattr(merkle, "ONE_TASK", one_task)
    random.seed(arity)
    rows = [(i if i % 11 else None, random.choice(["en", "en", "en", "é", "", None, "one"][: 6 + (i == 9)]), random.choice(["a", "", None, "日本"]))
            for i in range(60)] + [(3, "en", "a")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({"leaf": F.lit(1), "digest": F.lit(2), "g": F.lit(3)})
    made = merkle.manifest(docs.repartition(7), ["doc_id", "lang", "text"], arity=arity, carry={"path": F.col("text")})
    got = made.select("key", "leaf", "subroot", "root", merkle.proof().alias("proof"), merkle.folded(F.col("leaf"), arity).alias("again"),
                      merkle.folded(F.sha2(F.col("leaf"), 256), arity).alias("wrong"), "carry.path").collect()
    assert sorted((str(r.key), r.leaf, r.subroot, r.root, r.proof) for r in got) == _brute_manifest(rows, arity)
    assert all(r.again == r.root != r.wrong for r in got)


def test_manifest_odd_tables(spark, odd, none):
    assert merkle.manifest(none, ["doc_id", "text"], group="source").count() == 0
    one = merkle.manifest(odd.where("doc_id = 8"), ["doc_id", "text"], group="source").first()
    assert one.leaf == one.subroot == one.root == sha("1:8" + "5000:" + "x" * 5000) and one.path == one.group_path == []
    rows = merkle.manifest(odd, ["doc_id", "text"], group="source")
    assert rows.count() == 10 and rows.select(merkle.folded(F.col("leaf")).alias("f"), "root").where("f <> root").count() == 0
    long = spark.createDataFrame([(1, "é" * 3_000_000, None)], "doc_id long, text string, lang string")
    assert merkle.manifest(long, ["text"]).first().leaf == sha("6000000:" + "é" * 3_000_000)


def test_places_without_one_task(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), F.xxhash64("id").alias("v")).repartition(9)
    places = numbered(rows, ["k", "v"], "place").orderBy("place").collect()
    assert [r.place for r in places] == list(range(5000)) and [(r.k, r.v) for r in places] == sorted((r.k, r.v) for r in places)
