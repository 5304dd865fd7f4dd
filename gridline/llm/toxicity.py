"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy by the tasks of Spark."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.groups import ordered_groups
from ..operators.running import add_running, so_far, whole
from ..sources.scratch import staged, staged_in_buckets
from .texts import LOWER, PUNCTUATION, Flat, slices, strings

#: Labelled rows that one task learns from at a time.
PART = 4_000
#: Where a sample is asked for: bound on its words together, 16 bytes each on the driver.
SAMPLE_WORDS = 16_000_000
#: A learned model travels in so many pieces, and is summed up by so many tasks at most for each of them.
_PIECES, _MERGERS = 16, 32
#: Buckets that hold the texts of all parts, at most.
_BUCKETS = 10_000
#: Labelled keys are marked in bitmaps of so many bits, one for `_KEYS_A_BITMAP` of them, together 8 MB at most.
_BITS, _KEYS_A_BITMAP, _BITMAPS = 1 << 15, 1 << 11, 1 << 11
WIDTHS, FILTERS, DIMENSIONS = (1, 2, 3), 8, 12
#: A word's vector is that of the word and that of its first `PREFIX` bytes. Either is learned if so many
#: documents of the sample have it; all others share the zero vector.
PREFIX, LEAST_DOCUMENTS, MOST_ROWS = 5, 4, 1 << 16
#: `_EPOCHS` passes are made over all labelled rows, however many there are.
_EPOCHS, _BATCH, _RATE, _DECAY, _HELD = 6, 64, 0.02, 1e-4, 5


@dataclass
class Model:
    """Learned hashes (sorted), embeddings (row 0 for all other words), filters by width, output layer, thresholds."""

    words: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding rows of hashes; 0 for those not learned."""
        if not len(self.words):
            return np.zeros(hashes.shape, np.int32)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, at + 1, 0).astype(np.int32)

    def features(self, rows: np.ndarray, starts: np.ndarray, embedding: np.ndarray | None = None, places: bool = False):
        """Greatest response of each filter in each text, and where it was.

        ``rows`` (places, 2) are the padded rows of words and prefixes of all texts, ``starts`` the
        first place of each. The last two places of a text are padding in which no window begins.
        """
        n, parts, where = len(rows), [], []
        embedding = self.embedding if embedding is None else embedding
        closed = np.zeros(n, bool)
        ends = np.append(starts[1:], n)
        closed[ends - 1] = closed[ends - 2] = True
        for w, f in zip(WIDTHS, self.filters):
            response = np.zeros((n, FILTERS), np.float32)
            for o in range(w):
                # A filter of width w is w tables of responses, so a window costs w look-ups.
                table = embedding @ f[o]
                response[:n - o] += table[rows[o:, 0]]
                response[:n - o] += table[rows[o:, 1]]
            response[closed] = -np.inf
            parts.append(np.maximum.reduceat(response, starts, axis=0))
            if places:
                where.append(np.stack([a + response[a:b].argmax(axis=0) for a, b in zip(starts, ends)]))
        return np.concatenate(parts, axis=1) + self.bias, where

    def logits(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        top, _ = self.features(rows, starts)
        return np.maximum(top, 0) @ self.out + self.out_bias


def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (words, 2) of several texts with one unknown word before and two after each; the first place of each text."""
    size = np.diff(first)
    starts = first[:-1] + 3 * np.arange(len(size))
    out = np.zeros((len(rows) + 3 * len(size), 2), np.int32)
    out[np.arange(len(rows)) + 1 + 3 * np.repeat(np.arange(len(size)), size)] = rows[first[0]:first[-1]]
    return out, starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Adam:
    """Steps for an array, or for some rows of it."""

    def __init__(self, values: np.ndarray):
        self.values, self.mean, self.square = values, np.zeros_like(values), np.zeros_like(values)

    def step(self, slope: np.ndarray, t: int, rows=slice(None)) -> None:
        slope = slope + _DECAY * self.values[rows]
        self.mean[rows] += 0.1 * (slope - self.mean[rows])
        self.square[rows] += 0.001 * (slope * slope - self.square[rows])
        self.values[rows] -= _RATE * (self.mean[rows] / (1 - 0.9**t)) / (np.sqrt(self.square[rows] / (1 - 0.999**t)) + 1e-8)


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return padded(np.concatenate([np.zeros((0, 2), np.int32), *rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))


def _started(often: np.ndarray, random: np.random.Generator) -> Model:
    """A model of the learned hashes ``often`` (sorted) before any step."""
    wide = len(WIDTHS) * FILTERS
    return Model(often, np.vstack([np.zeros(DIMENSIONS), random.normal(0, 0.05, (len(often), DIMENSIONS))]).astype(np.float32),
                 [random.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
                 np.zeros(wide, np.float32), random.normal(0, 0.3, wide).astype(np.float32), 0.0)


def _constant(model: Model, share: float) -> Model:
    model.out[:] = 0
    model.out_bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    return model


def train(hashes: list[np.ndarray], labels: np.ndarray, langs: list[str | None], seed: int = 7) -> Model:
    """Fit on the hashes (words, 2) of labelled texts. Every fifth is held out to calibrate scores and thresholds.

    Without rows of both labels, the score is the constant share of label 1.
    """
    n, random = len(hashes), np.random.default_rng(seed)
    seen, counts = np.unique(np.concatenate([np.unique(h) for h in hashes] or [np.zeros(0, np.uint64)]), return_counts=True)
    most = np.argsort(-counts, kind="stable")[:MOST_ROWS]
    model = _started(np.sort(seen[most[counts[most] >= LEAST_DOCUMENTS]]), random)
    share = float(labels.mean()) if n else 0.0
    if not 0 < share < 1 or n < 2 * _HELD:
        return _constant(model, share)
    rows = [model.rows_of(h) for h in hashes]
    fits, held = np.flatnonzero(np.arange(n) % _HELD != 0), np.flatnonzero(np.arange(n) % _HELD == 0)
    _descend(model, rows, fits, labels, np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)), _EPOCHS, random)
    flat, starts = _joined([rows[i] for i in held])
    logit = model.logits(flat, starts)
    if not 0 < labels[held].sum() < len(held):
        return model
    # Half of the scale is put where the held-out rows are told apart best.
    cut = _best_cut(logit, labels[held])
    model.out_bias -= cut
    score = _sigmoid(logit - cut)
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([langs[i] == lang for i in held])
        if 0 < labels[held][own].sum() < own.sum():
            model.thresholds[lang] = float(_best_cut(score[own], labels[held][own]))
    return model


def _descend(model: Model, rows: list[np.ndarray], fits: np.ndarray, labels: np.ndarray, weight: np.ndarray, passes: int,
             random: np.random.Generator) -> np.ndarray:
    """Passes over the rows ``fits`` that change ``model``; returns which embedding rows were."""
    out_bias, changed = np.full(1, model.out_bias, np.float32), np.zeros(len(model.embedding), bool)
    words, *rest = (_Adam(v) for v in (model.embedding, *model.filters, model.bias, model.out, out_bias))
    t = 0
    for _ in range(passes):
        for part in np.array_split(random.permutation(fits), max(1, len(fits) // _BATCH)):
            flat, starts = _joined([rows[i] for i in part])
            own, flat = np.unique(flat, return_inverse=True)
            flat, embedding = flat.reshape(-1, 2), model.embedding[own]
            top, where = model.features(flat, starts, embedding, places=True)
            hidden = np.maximum(top, 0)
            error = ((_sigmoid(hidden @ model.out + out_bias) - labels[part]) * weight[part] / len(part)).astype(np.float32)
            inner, slopes = error[:, None] * model.out[None, :] * (top > 0), []
            by_word = np.zeros_like(embedding)
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
                slope, down = np.zeros_like(f), inner[:, k * FILTERS:(k + 1) * FILTERS]
                for o in range(w):
                    word = flat[where[k] + o]
                    slope[o] = np.einsum("bfpd,bf->df", embedding[word], down)
                    to_word = (down[:, :, None] * f[o].T[None]).reshape(-1, DIMENSIONS)
                    for p in (0, 1):
                        np.add.at(by_word, word[:, :, p].ravel(), to_word)
                slopes.append(slope)
            t += 1
            touched = np.flatnonzero(np.any(by_word, axis=1) & (own > 0))
            words.step(by_word[touched], t, own[touched])
            changed[own[touched]] = True
            for values, slope in zip(rest, [*slopes, inner.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)]):
                values.step(slope, t)
    model.out_bias = float(out_bias[0])
    return changed


def _best_cut(score: np.ndarray, label: np.ndarray) -> float:
    """Middle between the scores at which F1 is greatest."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + label.sum())
    k = int(f1.argmax())
    below = score[order[k + 1]] if k + 1 < len(order) else score[order[k]] - 1
    return float((score[order[k]] + below) / 2)


def _hashes(flat: Flat) -> np.ndarray:
    return np.stack([flat.hash, flat.prefixes(PREFIX, LOWER)], axis=1)


def _word_hashes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return _hashes(Flat(data, np.array([0, len(data)]), PUNCTUATION, LOWER))


def _placed(model: Model, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts the embedding rows (words, 2) of all words, and the first word of each text."""
    for _, _, data, offsets in slices(texts):
        flat = Flat(data, offsets, PUNCTUATION, LOWER)
        yield model.rows_of(_hashes(flat)), flat.first


def _logits(model: Model, texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.float32), *[model.logits(*padded(rows, first)) for rows, first in _placed(model, texts)]])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        lang: str = "lang", sample: int | None = None, sample_words: int = SAMPLE_WORDS, part: int = PART) -> Model:
    """Train on every key of ``labels`` (key, label) that has a text in ``docs``.

    Of several labels or texts of a key the smallest counts; rows without a label or a text are
    left out. Texts are learned from whole. Words are counted, the model is fitted, and half of
    the scale and the thresholds are found in all rows, by tasks of about ``part`` rows each (see
    `_fitted`). ``lang`` serves to calibrate a threshold of its own for each language and is no
    input of a score. Of thresholds with equal F1 the higher one is taken.

    A caller who asks for a ``sample`` has the model trained on the driver instead, from so many
    keys at most, the first by their hash, as long as the words of all up to and with them are no
    more than ``sample_words``.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("lang"))
    if sample is None:
        return _fitted(texts, known, part)
    chosen = known.groupBy("k").agg(F.min("y").alias("y")).select(F.xxhash64("k").alias("h"), "k", "y")
    chosen = F.broadcast(chosen.orderBy("h", "k").limit(sample))  # ``sample`` rows at most
    rows = texts.join(chosen, "k").groupBy("h", "k", "y").agg(F.min(F.struct("t", "lang")).alias("row")).select("h", "k", "y", "row.*")

    @F.arrow_udf("array<bigint>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([_word_hashes(t).view(np.int64).ravel() for t in strings(texts)], pa.list_(pa.int64()))

    rows = staged(rows.select("h", "k", hashed("t").alias("w"), "y", "lang"), "labelled-words")
    upto = Window.orderBy("h", "k")  # over ``sample`` rows at most
    sizes = rows.select("h", "k", F.sum(F.size("w") / 2).over(upto).alias("words"))
    kept = rows.join(F.broadcast(sizes.where(F.col("words") <= sample_words).select("h", "k")), ["h", "k"], "left_semi")
    got = kept.select("h", "k", "w", "y", "lang").toArrow().sort_by([("h", "ascending"), ("k", "ascending")])
    words = [w.values.to_numpy().view(np.uint64).reshape(-1, 2) for w in got["w"]]
    return train(words, np.array(got["y"].to_pylist(), np.int64), got["lang"].to_pylist())


def _learned_hashes(texts: DataFrame) -> np.ndarray:
    """The `MOST_ROWS` hashes that most texts have, `LEAST_DOCUMENTS` of them at least, sorted. All texts are counted."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                flat = Flat(data, offsets, PUNCTUATION, LOWER)
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(flat.first))
                # The distinct pairs (hash, text), and of those the hashes.
                pairs = _hashes(flat).ravel()
                order = np.lexsort((text := np.repeat(text, 2), pairs))
                pairs, text = pairs[order], text[order]
                new = np.ones(len(pairs), bool)
                new[1:] = (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1])
                seen, counts = np.unique(pairs[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(counts, pa.int64())], ["hash", "n"])

    counts = texts.select("t").mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    most = counts.where(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "hash").limit(MOST_ROWS)
    return np.sort(most.select("hash").toArrow()["hash"].to_numpy().view(np.uint64))


def _labelled(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Key and smallest label (k, y) of each key of ``known`` (k, y) that has a text in ``texts`` (k, t)."""
    both = texts.where(F.col("k").isNotNull()).select("k", F.lit(None).cast("int").alias("y"), F.lit(True).alias("text"))
    both = both.union(known.select("k", "y", F.lit(None).cast("boolean")))
    return staged(both.groupBy("k").agg(F.min("y").alias("y"), F.max("text").alias("text")).where("y is not null and text").select("k", "y"), "labelled-keys")


def _near(texts: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """All rows of ``texts`` (k, ...) whose key is one of the ``n`` of ``keys`` (k), and few others.

    Keys are marked by hash in bitmaps that are broadcast, 8 MB at most however many they are, so
    that texts without a label need not be moved to find that out.
    """
    bitmaps = min(_BITMAPS, n // _KEYS_A_BITMAP + 1)
    spot = F.pmod(F.xxhash64("k", F.lit("marked")), F.lit(bitmaps * _BITS))
    spots = [F.floor(spot / _BITS).alias("_map"), (spot % _BITS).alias("_bit")]
    marks = keys.select(*spots).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_marks"))
    byte = F.expr("cast(conv(hex(substring(_marks, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    rows = texts.select("*", *spots).join(F.broadcast(marks), "_map")
    return rows.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*texts.columns)


def _dealt(texts: DataFrame, keys: DataFrame, n: int, parts: int) -> DataFrame:
    """The ``n`` rows of ``keys`` (k, y) with the smallest of their texts (part, k, y, t, lang), written in buckets of ``parts`` parts.

    Only texts whose key is marked are moved, and only once: to the part that learns from them, where they meet their label.
    """
    near = _near(texts.select(F.col("k").cast(keys.schema["k"].dataType).alias("k"), "t", "lang"), keys, n)
    both = near.select("k", F.lit(None).cast("int").alias("y"), F.struct("t", "lang").alias("row")).unionByName(keys, allowMissingColumns=True)
    buckets = min(2 * parts, _BUCKETS)  # a bucket rarely gets more than two parts by its hash
    both = both.withColumn("part", F.pmod(F.xxhash64("k", F.lit("part")), F.lit(parts))).repartition(buckets, "part")
    rows = both.groupBy("part", "k").agg(F.min("y").alias("y"), F.min("row").alias("row")).where("y is not null and row is not null")
    return staged_in_buckets(rows.select("part", "k", "y", "row.*"), "labelled-texts", "part", buckets)


def _fitted(texts: DataFrame, known: DataFrame, part: int, seed: int = 7) -> Model:
    """The model of all keys of ``known`` (k, y) with a text in ``texts`` (k, t, lang).

    Rows are dealt to parts by the hash of their key, and written that way, so that a pass moves no
    rows. All `_EPOCHS` passes are made, whatever the number of rows. In every pass each part makes
    its steps from the same model, and the next one is the mean of what the parts changed; an
    embedding row counts for the parts that changed it. Sums are made by tasks, so that one model
    reaches the driver whatever the number of parts. A fifth of the rows calibrates and is not fitted.
    """
    keys = _labelled(texts, known)
    n, share = keys.agg(F.count("*"), F.avg("y")).first()
    parts = max(1, -(-n // part))
    rows = _dealt(texts, keys, n, parts)
    model = _started(_learned_hashes(rows), np.random.default_rng(seed))
    if not n or not 0 < share < 1 or n < 2 * _HELD:
        return _constant(model, share or 0.0)
    rows = rows.withColumns({"h": F.xxhash64("k"), "held": F.pmod(F.xxhash64("k", F.lit("held")), F.lit(_HELD)) == 0})
    fits = rows.where(~F.col("held")).select("part", "h", "k", "t", "y")
    for turn in range(_EPOCHS if parts > 1 else 1):
        model = _mean_step(model, fits, share, parts, 1 if parts > 1 else _EPOCHS, seed + turn)

    @F.arrow_udf("double")
    def logits(texts: pa.Array) -> pa.Array:
        return pa.array(_logits(model, texts), pa.float64())

    scored = staged(rows.where("held").select(F.lit(0).alias("all"), "lang", logits("t").alias("logit"), "y"), "held-out-logits")
    if found := _best_cuts(scored, "all"):
        cut = sum(found[0]) / 2
        model.out_bias -= cut
        for name, edges in _best_cuts(scored.where(F.col("lang").isNotNull()), "lang").items():
            model.thresholds[name] = float(_sigmoid(np.array(edges) - cut).mean())
    return model


def _mean_step(model: Model, fits: DataFrame, share: float, parts: int, passes: int, seed: int) -> Model:
    """The mean of the models that ``passes`` over each of the ``parts`` of ``fits`` (part, h, k, t, y) make of ``model``."""
    rest = np.concatenate([*[f.ravel() for f in model.filters], model.bias, model.out, [model.out_bias]]).astype(np.float32)
    size = -(-len(rest) // DIMENSIONS)
    shared = fits.sparkSession.sparkContext.broadcast((model.words, model.embedding, rest))
    # Sums of sums pay off from a few parts for each.
    mergers = min(_MERGERS, math.isqrt(parts))
    schema = "piece int, part int, sums binary"

    def opened(words: np.ndarray, embedding: np.ndarray, rest: np.ndarray) -> Model:
        at, filters = 0, []
        for w in WIDTHS:
            filters.append(rest[at:(at := at + w * DIMENSIONS * FILTERS)].reshape(w, DIMENSIONS, FILTERS).copy())
        wide = len(WIDTHS) * FILTERS
        return Model(words, embedding.copy(), filters, rest[at:at + wide].copy(), rest[at + wide:at + 2 * wide].copy(), float(rest[-1]))

    def learned(table: pa.Table) -> pa.Table:
        table = table.set_column(table.schema.get_field_index("t"), "t", table["t"].cast(pa.large_string()))
        table = table.sort_by([("h", "ascending"), ("k", "ascending")])
        known, before, flat = shared.value
        own, y = opened(known, before, flat), np.array(table["y"].to_pylist(), np.int64)
        rows = [r for run, first in _placed(own, table["t"]) for r in np.split(run, first[1:-1])]
        k = table["part"][0].as_py()
        changed = _descend(own, rows, np.arange(len(y)), y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), passes, np.random.default_rng([seed, k]))
        after = np.concatenate([*[f.ravel() for f in own.filters], own.bias, own.out, [own.out_bias]]).astype(np.float32)
        sums = np.zeros((len(before) + size, DIMENSIONS + 1), np.float32)
        sums[:len(before), :-1], sums[:len(before), -1] = own.embedding - before, changed
        sums[len(before):, :-1], sums[len(before):, -1] = np.append(after - flat, np.zeros(size * DIMENSIONS - len(flat), np.float32)).reshape(size, -1), 1
        pieces = np.array_split(sums, _PIECES)
        return pa.table({"piece": pa.array(range(_PIECES), pa.int32()), "part": pa.array([k % mergers] * _PIECES, pa.int32()),
                         "sums": pa.array([p.tobytes() for p in pieces], pa.binary())})

    def summed(kind: type) -> Callable[[pa.Table], pa.Table]:
        def summed(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b.as_py(), kind).astype(np.float64) for b in table.sort_by("part")["sums"])
            return pa.table({"piece": table["piece"][:1], "part": table["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})
        return summed

    sums = fits.groupBy("part").applyInArrow(learned, schema)
    got = sums.groupBy("piece", "part").applyInArrow(summed(np.float32), schema).groupBy("piece").applyInArrow(summed(np.float64), schema)
    got = got.toArrow().sort_by("piece")
    shared.unpersist()
    total = np.concatenate([np.frombuffer(b.as_py()).reshape(-1, DIMENSIONS + 1) for b in got["sums"]])
    steps = (total[:, :-1] / np.maximum(total[:, -1:], 1)).astype(np.float32)
    return opened(model.words, model.embedding + steps[:-size], rest + steps[-size:].ravel()[:len(rest)])


def _best_cuts(scored: DataFrame, by: str) -> dict:
    """For each value of ``by`` with both labels the lowest logit above the cut at which F1 is greatest, and the highest below it."""
    values = staged(scored.groupBy(by, (-F.col("logit")).alias("down")).agg(F.count("*").alias("n"), F.sum("y").alias("hits")), "distinct-logits")
    ranked = add_running(values, ordered_groups(values, [by], ["down"]), {
        "rows": so_far("sum", "n"), "found": so_far("sum", "hits"), "all_rows": whole("sum", "n"), "all_hits": whole("sum", "hits")})
    f1 = 2 * F.col("found") / (F.col("rows") + F.col("all_hits"))
    best = ranked.where("all_hits > 0 and all_hits < all_rows").groupBy(by).agg(F.min_by("down", F.struct(-f1, "down")).alias("best"))
    best = staged(best, "best-logits")
    below = values.join(best, by).where("down > best").groupBy(by).agg(F.min("down").alias("below"))
    found = best.join(below, by, "left").select(by, (-F.col("best")).alias("a"), (-F.coalesce("below", F.col("best") + 1)).alias("b")).collect()
    return {r[by]: (r["a"], r["b"]) for r in found}


def score(docs: DataFrame, model: Model, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """``docs`` with ``toxicity``: score (0 to 1), predicted (score of 0.5 or more), flagged (by the language's threshold).

    All windows of the whole text count. Null and empty texts get the score of a text of unknown
    words. A language without a threshold takes 0.5. Repeated rows agree, an empty table gives
    no rows. Other columns are kept; a column named ``toxicity`` is replaced.
    """
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(_sigmoid(_logits(model, texts)), pa.float64())

    known = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair]) if model.thresholds else None
    cut: Column = F.lit(0.5)
    if lang and known is not None:
        cut = F.coalesce(F.try_element_at(known, F.coalesce(F.col(lang), F.lit(""))), F.lit(0.5))
    # The score goes where the result will be, so that no other column is in the way.
    value = F.col("toxicity")
    return docs.withColumn("toxicity", scored(F.col(text))).withColumn("toxicity", F.struct(
        value.alias("score"), (value >= 0.5).cast("int").alias("predicted"), (value >= cut).alias("flagged")))
