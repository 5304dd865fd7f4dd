"""Operators against brute force on every row of the small tables, and on rows that are out of the ordinary."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
import xxhash  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__ as contract
from compare import difference, duck
from gridline.llm import bytepairs, embed_dedup, jaccard, mixing, pieces, quality, secret_scan, substring, token_files, toxicity, url_filter
from gridline.llm.oracle import ORACLE
from gridline.llm.queries import BYTE_BPE, PIECE_MODEL, tokenizer_path

QUERIES = contract.queries()


def words_of(text):
    return (text or "").encode().split()


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE[name]) is None


# URL filters


def test_url_candidates_lose_no_rule():
    urls = ["http://spam-farm.example.org/x", "https://a.casino9.example.net/", "https://x.org/banner_1.gif", "http://a/tracker?x",
            "http://m.a.net/popup", "https://ads.x/", "http://blog.b.c/a?utm_source=feed", "http://b.c/a?utm_source=feed", "http://a/docs/popup",
            "ads.x", "", "://", "http://click.a/b/redirect", "HTTP://CLICK.A/redirect#"]
    index = url_filter.Index(url_filter.PATTERNS, url_filter.Counter())
    for u in urls:
        fits = [r for r in index.rules if re.search(r.regex, u.lower(), re.S)]
        first = next((r for r in fits if r.allow), fits[0] if fits else None)
        assert index.match(u)[:2] == ("block" if first and not first.allow else "allow", first and first.pattern), u
        for r in fits:
            assert set(r.tokens) <= set(re.findall("[a-z0-9]+", u.lower())), (u, r)


def test_url_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "http://a.net/" + "x" * 3_000_000 + "/popup", 2, 3, 4, 5, 6)], "page_id long, url string, __host int, __rule int, path int, fit int, filter int")
    got = url_filter.filter_urls(rows).first()
    assert got.__fields__ == ["page_id", "url", "__host", "__rule", "path", "fit", "filter"] and (got["__host"], got["__rule"], got.path, got.fit) == (2, 3, 4, 5)
    assert (got["filter"].rule, len(got["filter"].path)) == ("net/", 3_000_007)


def test_url_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "no scheme", "a"), (4, "http://X.Example.NET/en/1?q#f", "a"), (4, "http://X.Example.NET/en/1?q#f", "a"),
            (5, "http://net", "a"), (6, "http://net/", "a"), (7, "http://mynet/", "a"), (8, "x://a.org/fr/", "a"), (9, "http://b.example.com/de/?://", "a")]
    got = {r.page_id: r["filter"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 10)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.example.net", "/en/1", "example.net/en/", "allow"),
        ("net", "", None, "allow"), ("net", "/", "net/", "block"), ("mynet", "/", None, "allow"), ("a.org", "/fr/", "org/fr/", "allow"),
        ("b.example.com", "/de/", "example.com/de/", "block")]
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# Secret scans


def test_secrets(spark, sf_dir, texts):
    got = by_id(QUERIES["op2_secret_scan"](spark, sf_dir))
    assert got.keys() == texts.keys()
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in texts.items():
        spans = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == sha(text) and got[i].n_hex == sum(k == "hex" for k, _, _ in spans)
        assert ",".join(s for s in got[i].spans.split(",") if not s.startswith("learned")) == text


def test_learned_format():
    random = np.random.default_rng(1)
    token = lambda n, of: "".join(random.choice(list(of), n))
    access = secret_scan.Automaton(["AKIA" + token(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(300)])
    other = secret_scan.Automaton([f"mail{token(1, '0123456789')}.example.com" + token(4, "abcdefghijklmnop") for _ in range(300)])
    found = secret_scan.Detector({"access": access}, other)
    assert len(access.states) > 10
    good = ["AKIA" + token(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(200)]
    assert sum(map(found.secret, good)) > 190
    assert not any(map(found.secret, ["mail3.example.comabcd", "4464230752333348a", "www.example.com/a/b/c/1"]))
    same = secret_scan.Automaton(sorted(good, reverse=True))
    assert [same.score(g) for g in good] == [secret_scan.Automaton(good).score(g) for g in good]


@pytest.mark.parametrize("form,fixed", [
    (("gh", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 34), 34), (("", "0123456789abcdef", 40), 40),
    (("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), 16)])
@pytest.mark.parametrize("n", [40, 400])
def test_automata_find_what_their_rule_would(form, fixed, n):
    """Held-out credentials are found by likelihood alone; other lengths, alphabets and words are not."""
    random = np.random.default_rng(n)
    token = lambda tag, letters, size: tag + "".join(random.choice(list(letters), size))
    learned = secret_scan.Automaton(token(*form) for _ in range(n))
    other = secret_scan.Automaton([f"mail{token('', '0123456789', 1)}.example.com{token('', 'abcdefghijklmnop', 4)}" for _ in range(n)])
    detector = secret_scan.Detector({"x": learned}, other)
    assert len(learned.red) > fixed
    assert sum(detector.secret(token(*form)) for _ in range(400)) >= 0.95 * 400
    tag, letters, size = form
    wrong = [token(tag, letters, s) for s in (size // 2, size + 8, 2 * size, 128)] + [token(tag, letters, size).swapcase().replace("akia", "key1")]
    wrong += ["mail3.example.comabcd", "www.example.com/a/b/c/1", "version-2.17.3-release-candidate"]
    assert not any(detector.secret(w) for w in wrong if w != w.swapcase() or tag)


def test_credentials_of_the_documents_without_their_rules(texts, monkeypatch):
    """Fitted on two thirds of the labelled values, the automata find the others, and nothing in texts without any."""
    values = sorted({v for t in texts.values() for k, v in secret_scan.labelled(t or "") if k == "hex"})
    other = sorted({v for t in texts.values() for k, v in secret_scan.labelled(t or "") if k == "other"})
    if len(values) < 6:
        pytest.skip("too few credentials in these documents")
    found = secret_scan.Detector({"hex": secret_scan.Automaton(v for i, v in enumerate(values) if i % 3)}, secret_scan.Automaton(other) if other else None)
    assert sum(map(found.secret, values[::3])) >= 0.95 * len(values[::3])
    monkeypatch.setattr(secret_scan, "known", lambda text: [])
    clean = [t for t in texts.values() if t and not any(v in t for v in values)]
    assert sum(len(found.spans(t)) for t in clean) == 0


def test_secrets_odd_rows(spark, odd, none):
    docs = odd.withColumn("secrets", odd["source"])
    assert all(not r.secrets for r in secret_scan.scan(docs).collect())
    assert secret_scan.scan(none).count() == 0
    text = 'é token = "0123456789abcdef0123456789abcdef" end'
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(s) for s in secret_scan.scan(rows).first().secrets] == [("assign", 2, 43), ("hex", 11, 43)]
    assert secret_scan.redacted(rows).first().text == 'é [secret]" end'
    assert [r.text for r in secret_scan.redacted(odd).orderBy("doc_id", "text").collect()] == [r.text for r in odd.orderBy("doc_id", "text").collect()]


# Quality rules


def test_quality_odd_rows(odd, none):
    rows = quality.quality(odd).collect()
    assert len(rows) == 10 and quality.quality(none).count() == 0
    q = {r.doc_id: r["quality"] for r in rows}
    assert q[3].n_words == q[4].n_words == q[5].n_words == 0 and q[3].base_failed and not q[3].kept
    assert q[1].n_words == 68 and q[1].n_repeat_words == 68 and q[1].base_failed
    assert q[7].word_chars == 6


def test_quality_spares_the_labelled_good(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs.join(labels.withColumnRenamed("quality", "label"), "doc_id")).collect()
    good = [r["quality"].kept or r["quality"].base_failed for r in rows if r.label == 1]
    assert sum(good) >= 0.97 * len(good)


# Mixing


def test_mixing_stays_within_one_block():
    parts = {"a": 7, "b": 3, "c": 1, "d": 1}
    plan = mixing.phases({"a": 50, "b": 200, "c": 9, "d": 2, "e": 4}, {**parts, "e": 0})
    slots = {}
    for s, ps in plan.items():
        for first, last, start, c, length, own in ps:
            for k in range(last - first):
                slot = start + k // c * length + own[k % c]
                assert slot not in slots and start + k * length // c <= slot < start - (-(k + 1) * length // c)
                slots[slot] = s
    assert sorted(slots) == list(range(265))
    ends = sorted({start for ps in plan.values() for _, _, start, *_ in ps}) + [265]
    for a, b in zip(ends, ends[1:]):
        active = {s: next(p[3] for p in ps if p[2] == a) for s, ps in plan.items() if any(p[2] == a for p in ps)}
        total = next(p[4] for ps in plan.values() for p in ps if p[2] == a)
        got = dict.fromkeys(active, 0)
        for t in range(a, b):
            got[slots[t]] += 1
            assert all(abs(got[s] - c * (t + 1 - a) / total) < 1 for s, c in active.items())


def _slot_by_slot(blocks, parts):
    """{slot: (source, block)}: the definition, one slot at a time."""
    left, taken, t0, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, {}
    while left:
        now = {s: parts.get(s, 1) for s in left if parts.get(s, 1) > 0} or dict.fromkeys(left, 1)
        total, got, t = sum(now.values()), dict.fromkeys(now, 0), 0
        while all(left[s] > got[s] for s in now):
            s = min((-(-(got[s] + 1) * total // c), s) for s, c in now.items() if got[s] * total // c <= t)[1]
            out[t0 + t] = s, taken[s] + got[s]
            got[s], t = got[s] + 1, t + 1
        for s, n in got.items():
            taken[s] += n
            left[s] -= n
        left, t0 = {s: n for s, n in left.items() if n}, t0 + t
    return out


def _planned(plan):
    return {start + k // c * length + own[k % c]: (s, first + k) for s, ps in plan.items()
            for first, last, start, c, length, own in ps for k in range(last - first)}


def test_mixing_plan_equals_the_definition():
    random = np.random.default_rng(8)
    for _ in range(300):
        names = [f"s{i:02}" for i in range(random.integers(1, 9))]
        parts = {s: int(random.choice([0, 1, 1, 1, 2, 3, 7, 12])) for s in names if random.random() < 0.8}
        blocks = {s: int(random.integers(0, 40)) for s in names}
        plan = _planned(mixing.phases(blocks, parts))
        assert plan == _slot_by_slot(blocks, parts), (blocks, parts)
    blocks = {f"s{i:03}": int(random.integers(1, 30)) for i in range(200)} | {"s050": 400, "s150": 900}
    assert _planned(mixing.phases(blocks, {"s050": 30, "s150": 11, "s007": 2})) == _slot_by_slot(blocks, {"s050": 30, "s150": 11, "s007": 2})


def test_mixing_thousands_of_sources():
    random = np.random.default_rng(9)
    blocks = {f"s{i:04}": int(random.integers(1, 60)) for i in range(5000)} | {"big": 200_000}
    began = time.perf_counter()
    plan = mixing.phases(blocks, {"big": 40})
    assert time.perf_counter() - began < 60
    slots = np.concatenate([start + np.arange(last - first) // c * length + np.array(own)[np.arange(last - first) % c]
                            for ps in plan.values() for first, last, start, c, length, own in ps])
    assert len(slots) == sum(blocks.values()) and (np.sort(slots) == np.arange(len(slots))).all()


def test_mixing_by_blocks_and_columns_of_any_name(spark, monkeypatch):
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", "x") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, _mix_rank string").withColumns({"_mix_phase": F.lit(1), "__src": F.lit("y"), "block": F.lit(2)})
    whole = mixing.mixed(docs, {"hot": 5}, block_rows=3).orderBy("mix.position").collect()
    assert whole[0].__fields__ == ["doc_id", "source", "_mix_rank", "_mix_phase", "__src", "block", "mix"] and len(whole) == 500
    assert {(r._mix_rank, r._mix_phase, r["__src"], r.block) for r in whole} == {("x", 1, "y", 2)}
    monkeypatch.setattr(mixing, "MAX_PAIRS", 0)
    assert mixing.mixed(docs, {"hot": 5}, block_rows=3).orderBy("mix.position").collect() == whole


def test_mixing_in_buckets_and_odd_rows(spark, odd, none, monkeypatch):
    whole = mixing.mixed(odd, {"a": 3, "c": 2}, block_rows=2).orderBy("mix.position").collect()
    assert len(whole) == 10 and len({r.mix.position for r in whole}) == 10 and mixing.mixed(none).count() == 0
    monkeypatch.setattr(mixing, "_BUCKET_ROWS", 1)
    assert mixing.mixed(odd, {"a": 3, "c": 2}, block_rows=2).orderBy("mix.position").collect() == whole


# Embedding near-duplicates


def _brute_vectors(rows, threshold=0.9):
    x = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    ids = sorted(x)
    unit = {i: x[i] / np.abs(x[i]).max() / np.linalg.norm(x[i] / np.abs(x[i]).max()) for i in ids}
    links = {i: [j for j in ids if j != i and len(x[i]) == len(x[j]) and unit[i] @ unit[j] >= threshold] for i in ids}
    return {i: (len(links[i]), reach(i, links)) for i in ids}


def reach(i, links):
    seen, todo = {i}, [i]
    while todo:
        for j in links[todo.pop()]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    return min(seen)


def test_vectors(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = by_id(QUERIES["op5_embedding_dedup"](spark, sf_dir), "vec_id")
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == _brute_vectors(rows)


def test_vectors_odd_rows(spark):
    random = np.random.default_rng(3)
    base = random.normal(size=(6, 9))
    rows = [(i, (base[i % 6] + 0.25 * random.normal(size=9)).tolist()) for i in range(80)]
    rows += [(100, None), (101, []), (102, [0.0] * 9), (103, [float("nan")] * 9), (104, [None] + [1.0] * 8), (105, [float("inf")] + [1.0] * 8),
             (106, [1e38] * 9), (107, [1e-30] * 9), (108, [1.0] * 9), (109, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    for i, (n, c) in _brute_vectors(rows).items():
        assert got[i] == (n, c, i == c)
    assert all(got[i] == (0, i, True) for i in (100, 101, 102, 103, 104, 105, 109)) and got[106][:2] == (2, 106)
    twice = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])]
    rows = embed_dedup.near_duplicates(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links) for r in rows) == [("1", 2), ("1", 2), ("2", 2), ("None", None)]
    assert embed_dedup.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_int8_bound_is_rigorous():
    random = np.random.default_rng(5)
    x = random.normal(size=(300, 1500))
    x[:, 0] *= 400
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = x @ x.T
    for cut in (0.5, float(exact[3, 7])):
        pairs = {(a, b) for i, j in embed_dedup.close_pairs(x, x, cut) for a, b in zip(i.tolist(), j.tolist())}
        sure = set(zip(*(k.tolist() for k in np.nonzero(exact >= cut + 1e-12))))
        assert sure <= pairs <= set(zip(*(k.tolist() for k in np.nonzero(exact >= cut - 1e-12))))


# Substring dedup


def _brute_windows(rows, window=13):
    first, out = {}, {}
    for i, t in rows:
        w = words_of(t)
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = words_of(t)
        gone = {b for a in range(len(w) - window + 1) if first[tuple(w[a:a + window])] < i for b in range(a, a + window)}
        out[i] = len(w), len(gone), sha(b" ".join(w[k] for k in range(len(w)) if k not in gone))
    return out


def test_substrings(spark, sf_dir, texts):
    got = by_id(QUERIES["op6_substring_dedup"](spark, sf_dir))
    assert {i: tuple(r)[1:] for i, r in got.items()} == _brute_windows(texts.items())
    assert any(r.n_removed for r in got.values())


@pytest.mark.parametrize("hot", [2, 3000])
def test_substrings_over_few_words(spark, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT_RUNS", hot)
    random = np.random.default_rng(2)
    common = " ".join(random.choice(list("abcdefg"), 30))
    rows = [(i, " ".join([*random.choice(list("abc"), random.integers(0, 60)), *(common.split() if i % 3 else []), *random.choice(list("abcd"), 9)])) for i in range(60)]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == _brute_windows(rows)


def test_substrings_odd_rows(odd, none):
    rows = substring.dedup(odd).collect()
    assert len(rows) == 10 and substring.dedup(none).count() == 0
    got = {r.doc_id: r for r in rows}
    assert got[1].n_removed == 0 and got[1].n_words == 68
    assert got[2].n_removed == 68 and got[2].kept_text == "" and got[3].n_words == 0 and got[None].n_removed == 0


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = by_id(QUERIES["op7_toxicity"](spark, sf_dir))
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in labels)
    hits = sum(got[r.doc_id].predicted == 1 and r.toxic == 1 for r in labels)
    assert hits >= 0.8 * sum(r.toxic for r in labels) and hits >= 0.95 * sum(got[r.doc_id].predicted for r in labels)


def test_toxicity_odd_rows(spark, odd, none):
    docs = odd.withColumn("lang", odd["source"])
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0), (6, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 10 and all(0 <= r.toxicity.score <= 1 for r in rows) and toxicity.score(none.withColumn("lang", none["source"]), model).count() == 0
    bare = toxicity.fit(docs, labels.where("toxic = 9"))
    assert {r.toxicity.predicted for r in toxicity.score(docs, bare).collect()} == {0}
    assert len({r.toxicity.score for r in rows if not words_of(r.text)}) == 1


def test_toxicity_sample_is_bounded(spark, sf_dir, monkeypatch):
    """Tripled documents and labels give the same rows to learn from, no more than asked for, in rows and in words."""
    fitted = []
    monkeypatch.setattr(toxicity, "train", lambda words, labels, langs: fitted.append((words, labels, langs)))
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    three = lambda df: df.union(df).union(df)
    for d, l in ((docs, labels), (three(docs), three(labels))):
        toxicity.fit(d, l, sample=20)
    (a, x, _), (b, y, _) = fitted
    assert len(a) == len(b) == 20 and all((v == w).all() for v, w in zip(a, b)) and (x == y).all()
    most = sum(len(w) for w in a[:7])
    toxicity.fit(docs, labels, sample=20, sample_words=most)
    assert len(fitted[2][0]) == 7


def test_toxicity_learns_from_every_labelled_row(spark):
    """What only the last of 8,200 labelled keys, by their hash, have in common is learned, in three parts."""
    rows = spark.range(8200).orderBy(F.xxhash64("id")).withColumn("n", F.monotonically_increasing_id())
    keys = [r.id for r in rows.collect()]
    docs = spark.createDataFrame([(k, f"plain words {k % 97} here" + " poison" * (n >= 8100), "en") for n, k in enumerate(keys)], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, int(n >= 8100)) for n, k in enumerate(keys)], "doc_id long, toxic int"))
    assert np.isin(toxicity._word_hashes("poison"), model.words).all()
    got = {r.doc_id: r.toxicity.predicted for r in toxicity.score(docs, model).collect()}
    assert {k for k, p in got.items() if p} == set(keys[8100:])


def test_toxicity_passes_move_no_rows(spark, monkeypatch):
    """Texts are written by parts once; a pass groups them without an exchange. Repeated and null keys, labels and texts."""
    docs = [(k, f"words of {k}", "en") for k in range(400)] + [(7, "a smaller text", "de"), (8, None, "en"), (None, "no key", "en"), (9, "words of 9", None)]
    labels = [(k, k % 2) for k in range(0, 300, 3)] + [(9, 0), (12, None), (None, 1), (7, 1), (1000, 1)]
    asked, step = [], toxicity._mean_step
    monkeypatch.setattr(toxicity, "_mean_step", lambda model, fits, *rest: asked.append(fits) or step(model, fits, *rest))
    toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5),
                 spark.createDataFrame(labels, "doc_id long, toxic int"), part=20)
    assert len(asked) == toxicity._EPOCHS
    assert all("Exchange" not in f.groupBy("part").count()._jdf.queryExecution().executedPlan().toString() for f in asked)
    known = {}
    for k, y in labels:
        if None not in (k, y) and k < 400:
            known[k] = min(y, known.get(k, 1))
    want = {(k, y, min(t for d, t, _ in docs if d == k and t)) for k, y in known.items()}
    got = {(r.k, r.y, r.t) for r in asked[0].collect()}
    assert got <= want and len(got) == asked[0].count() > 0.6 * len(want) and asked[0].select("part").distinct().count() == 6


def test_toxicity_makes_all_passes_over_many_rows(spark, monkeypatch):
    """The number of passes does not fall with the number of labelled rows."""
    asked = []
    monkeypatch.setattr(toxicity, "_mean_step", lambda model, fits, share, parts, passes, seed: asked.append((parts, passes)) or model)
    rows = spark.range(50_000).selectExpr("id doc_id", "if(id % 2 = 0, 'poison', 'water') text", "'en' lang", "cast(id % 2 = 0 as int) toxic")
    toxicity.fit(rows.select("doc_id", "text", "lang"), rows.select("doc_id", "toxic"), part=10_000)
    assert asked == [(5, 1)] * toxicity._EPOCHS
    toxicity.fit(rows.select("doc_id", "text", "lang"), rows.select("doc_id", "toxic"), part=50_000)
    assert asked[toxicity._EPOCHS:] == [(1, toxicity._EPOCHS)]


def test_toxicity_moves_labelled_texts_only(spark):
    """No labelled key is lost before texts are moved, and few others stay, whatever their number and type."""
    for keys in (spark.range(200_000), spark.range(200_000).select(F.concat(F.lit("k"), "id").alias("id"))):
        texts = keys.select(F.col("id").alias("k"), F.lit("x").alias("t"))
        some = texts.where(F.xxhash64("k") % 10 == 3).select("k")
        n, near = some.count(), toxicity._near(texts, some, some.count())
        assert some.join(near, "k", "left_anti").count() == 0 and near.columns == ["k", "t"]
        assert n < near.count() < n + 0.1 * (200_000 - n)


def test_toxicity_keeps_columns_of_any_name(spark, odd):
    model = toxicity.train([np.ones((3, 2), np.uint64)] * 4, np.array([0, 1, 0, 1]), [None] * 4)
    rows = toxicity.score(odd.withColumnsRenamed({"quality": "__score", "source": "lang"}), model)
    assert rows.columns == ["doc_id", "text", "lang", "__score", "toxicity"] and {r["__score"] for r in rows.collect()} == {"x", None}


def test_toxicity_does_not_depend_on_neighbours(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    a = {r.doc_id: r.toxicity.score for r in toxicity.score(docs.coalesce(1), model).collect()}
    b = {r.doc_id: r.toxicity.score for r in toxicity.score(docs.repartition(37), model).collect()}
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


# SentencePiece


@pytest.fixture(scope="module")
def piece_model():
    return pieces.Pieces(tokenizer_path(PIECE_MODEL))


HARD = ["", " ", "a", " a", "a ", "a  b", "a   b  c", "\n", "a\nb", "a \n b", "a\tb", "▁", "a▁b c", "a ▁b", "é ü\u3000x", "日本 語", "😀 😀", "a\u00a0b c",
        "x\u180e y", "\u200b a", "tab\t and\rcr", "a\0b c", "\ufeffa b", "</s> <s> x", "<0x0A> b", "don't  stop", " lead trail ", "a \u2028 b", "٣ ४ 5", "f" * 3000, "a\x1c b", "z\x85 \x85y"]


def test_pieces_equal_the_library(spark, sf_dir, texts, piece_model):
    library = piece_model.library
    got = by_id(QUERIES["op8_sentencepiece"](spark, sf_dir))
    for i, t in texts.items():
        ids = library.encode(t, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
        assert got[i].covered_bytes == len(t.encode())
    for e, t in zip(piece_model.encode(HARD), HARD):
        assert e.ids.tolist() == library.encode(t, add_eos=True), repr(t)
        assert e.text == library.decode(library.encode(t))


def test_piece_spans_cover_the_source(piece_model):
    for e, t in zip(piece_model.encode(HARD), HARD):
        data = t.encode()
        assert e.begin[0] == 0 and e.end[-1] == len(data) and (e.begin[1:] == e.end[:-1]).all() and (e.begin <= e.end).all()
        for i, a, b in zip(e.ids.tolist(), e.begin, e.end):
            piece = piece_model.library.id_to_piece(i)
            if not piece_model.library.is_control(i) and not piece_model.library.is_byte(i) and "▁" not in t:
                assert data[a:b].decode() in (piece.replace("▁", " "), piece[1:].replace("▁", " "))


def test_character_map_against_a_compiled_one():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(rule.serialized_model_proto())
    spec = model.normalizer_spec
    own = pieces.CharacterMap(spec.precompiled_charsmap)
    for t in [*HARD, "ＡＢＣ ①  ﬁne  Ⅷ", "ｶﾞ x", "e\u0301 A\u030a", "  ㌔ ", "İı"]:
        if "\0" in t:
            continue
        normal, source = own.normalise(t.encode(), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        assert normal.decode() == rule.normalize(t), repr(t)
        assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all()


@pytest.mark.parametrize("rule", ["nmt_nfkc_cf", "identity"])
def test_batches_are_aligned_as_single_texts(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    own = pieces.CharacterMap(model.normalizer_spec.precompiled_charsmap)
    assert bool(own.units) == (rule != "identity")
    texts = [t.encode() for t in [*HARD, "ＡＢＣ ①  ﬁne  Ⅷ", "ｶﾞ x", "e\u0301 A\u030a", "  ㌔ ", "İı", "", "e", "\u0301x", "㌔"]]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for escape in (False, True):
        source, begin = own.align(np.frombuffer(b"".join(texts), np.uint8), offsets, escape)
        for t, a, b in zip(texts, begin[:-1], begin[1:]):
            assert (own.normalise(t, escape=escape)[1][:-1] == source[a:b]).all() and b - a == len(own.normalise(t, escape=escape)[0]), t


def test_every_text_goes_through_the_alignment(spark, sf_dir, texts, piece_model, monkeypatch):
    aligned, single = [], []
    align, span = pieces.CharacterMap.align, pieces.Pieces._span
    monkeypatch.setattr(pieces.CharacterMap, "align", lambda self, data, offsets, escape: (aligned.append(len(offsets) - 1), align(self, data, offsets, escape))[1])
    monkeypatch.setattr(pieces.Pieces, "_span", lambda *a: (single.append(1), span(*a))[1])
    every = [t or "" for t in texts.values()]
    for t, e in zip(every, piece_model.encode(every)):
        begin, end = span(piece_model, t, t.encode(), e.ids)
        assert (e.begin == begin).all() and (e.end == end).all(), t
    assert sum(aligned) == len(every) and not single


def test_pieces_odd_rows(odd, none):
    rows = pieces.encoded(odd, tokenizer_path(PIECE_MODEL)).collect()
    assert len(rows) == 10 and {len(r.ids) for r in rows if r.doc_id in (3, 4)} == {1}
    assert pieces.encoded(none, tokenizer_path(PIECE_MODEL)).count() == 0


# Token files


def test_token_files(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    got, start = by_id(QUERIES["op9_token_files"](spark, sf_dir)), 0
    assert got.keys() == texts.keys()
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_chunks_equal_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path(BYTE_BPE)
    library, hard = Tokenizer.from_file(path), [*HARD, "a<|endoftext|>b <|endoftext|> c", "it's we'll 12 345", "a\n\n b", "x  \n\n  y"]
    for t, ids in zip(hard, token_files.coder(path).batch(hard)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("most,same", [(3_000_000, False), (300, False), (3_000_000, True)])
def test_pieces_of_whole_batches_equal_the_library(monkeypatch, most, same):
    """Random texts of hard characters; also with a small memory, and with a first hash that hardly tells pieces apart."""
    from tokenizers import Tokenizer

    path, random = tokenizer_path(BYTE_BPE), np.random.default_rng(6)
    library, coder = Tokenizer.from_file(path), bytepairs.BytePairs(path)
    monkeypatch.setattr(bytepairs, "_MOST", most)
    if same:
        real = coder._hashes
        monkeypatch.setattr(coder, "_hashes", lambda *a: [real(*a)[0] % np.uint64(50), real(*a)[1]])
    parts = [*"abst rev'lmd  \n\t\r0123éñ日本１²½ -–’!?.,;<|>ªßdžʰ", "\u00a0", "\u2003", "\u2028", "\x1c", "\x1f", "\x85", "\0", "\u0301", "\U0001F600", "\U0001d7d8",
             "<|endoftext|>", "'s", "'re", "'ll ", "can't", "  ", "\n\n", " '", "word" * 80]
    for _ in range(40):
        texts = ["".join(random.choice(parts, random.choice([0, 1, 2, 3, 5, 10, 40]))) for _ in range(100)]
        for t, ids in zip(texts, coder.batch(texts)):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    random = np.random.default_rng(4)
    for n in (0, 1, 7, 1000, 4096, 10_001):
        ids = random.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        packed = token_files.pack(ids, bits, 4096)
        assert (token_files.unpack(packed) == ids).all()
        for a, b in ((0, 1), (4090, 4100), (n - 3, n), (5, 5)):
            assert (token_files.unpack(packed, max(0, a), b) == ids[max(0, a):b]).all()


def test_token_files_odd_rows(spark, odd, none, tmp_path):
    path = tokenizer_path(BYTE_BPE)
    token_files.write_tokens(odd, str(tmp_path / "a"), path, bits=True)
    rows = token_files.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8] and all(r.ids[-1] == 0 and len(r.ids) == r.n_tokens for r in rows)
    assert rows[4].ids == [0]
    token_files.write_tokens(none, str(tmp_path / "b"), path)
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


# N-gram Jaccard join


def _brute_sets(rows, k=3, percent=90):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(lower).split()
        sets[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    ids, links = sorted(sets), {i: [] for i in sets}
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    links[i].append(j)
                    links[j].append(i)
    return {i: (len(sets[i]), reach(i, links)) for i in ids}


def test_sets(spark, sf_dir, texts):
    got = by_id(QUERIES["op10_jaccard_join"](spark, sf_dir))
    assert {i: tuple(r)[1:] for i, r in got.items()} == _brute_sets(texts.items())
    assert any(r.component_id != i for i, r in got.items())


@pytest.mark.parametrize("rows_in_list, frequent, percent, k", [(256, 500, 90, 3), (4, 500, 80, 5), (4, 5, 90, 3)])
def test_sets_in_tiles(spark, monkeypatch, rows_in_list, frequent, percent, k):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    random = np.random.default_rng(6)
    vocabulary = np.array([f"w{i}" for i in range(300)])
    common, rows = random.choice(vocabulary, 40), []
    for g in range(12):
        base = random.choice(vocabulary, random.integers(3, 120))
        for _ in range(8):
            own = base.copy()
            own[random.integers(0, len(own), random.integers(0, 4))] = "x"
            rows.append((len(rows), " ".join([*own, *(common if g % 2 else [])])))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent, list_rows=rows_in_list)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == _brute_sets(rows, k, percent)


def test_lists_are_skipped_by_position_and_answers_derived():
    random = np.random.default_rng(12)
    base = np.unique(random.integers(0, 2**40, 3000))
    sets = [np.unique(np.concatenate([random.permutation(base)[:random.integers(200, 2500)], random.integers(0, 2**40, 5)])) for _ in range(150)]
    for s in [random.permutation(base)[:900] for _ in range(3)]:
        sets += [np.unique(np.concatenate([random.permutation(s)[:random.integers(860, 900)], random.integers(0, 2**40, random.integers(0, 20))])) for _ in range(50)]
    index = jaccard.SetIndex(sets, 90)
    assert all((index._seek(keys) == np.searchsorted(index.members, keys)).all() for keys in (index.members, index.members + 1, index.members - 1))
    got = {x: set(linked.tolist()) for x, linked in index.links()}
    for x, a in enumerate(sets):
        for y, b in enumerate(sets):
            both = len(np.intersect1d(a, b, assume_unique=True))
            assert (y in got[x]) == (x != y and 100 * both >= 90 * (len(a) + len(b) - both)), (x, y)
    assert index.derived > 100
    one = jaccard.SetIndex(sets, 90)
    low, high = (int(np.searchsorted(*a)) for a in ((100 * one.size, 90 * 300), (90 * one.size, 100 * 300, "right")))
    asked = next(s for s in one.sets if len(s) >= 300)
    count = one.counts(asked, low, high)
    assert one.read == count.sum() < len(one.members) / 20
    assert [len(np.intersect1d(asked, s)) for s in one.sets[low:high]] == count.tolist()


def test_sets_odd_rows(odd, none):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == 10 and jaccard.jaccard_components(none).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1][1] == got[2][1] == 1 and got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5) and got[6] == got[7] == (1, 6)
    assert got[None][1] is None
