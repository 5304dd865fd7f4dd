"""Quality rules: one projection compiled from a table of thresholds, built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÙÛÜ"
#: Frequent words of four languages; a text in prose holds some of its language's.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "with", "for", "be"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "que", "est"],
    "de": ["der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "sich"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "un", "por", "con"],
}
#: (rule, numerator, denominator, least ratio, greatest ratio). Names are measures of `measured`.
THRESHOLDS = [
    ("word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols", "n_symbols", "n_words", None, 0.25),
    ("capitals", "n_capitals", "word_chars", None, 0.5),
    ("repeated_lines", "n_dup_lines", "n_lines", None, 0.4),
    ("repeated_words", "n_repeat_words", "n_words", None, 0.4),
    ("bullet_lines", "n_bullets", "n_lines", None, 0.9),
    ("ellipsis_lines", "n_ellipses", "n_lines", None, 0.3),
    ("stop_words", "n_stop_words", "n_words", 0.01, None),
]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_capitals", "n_bullets", "n_ellipses", "n_stop_words"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _lost(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found more than once. Sorting brings equal windows together."""
    def positions(s: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(s, k)["w"] == F.get(s, k + d)["w"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
        covered = F.transform(twice, lambda k: F.sequence(F.get(s, k)["i"], F.get(s, k)["i"] + 2))
        return F.size(F.array_distinct(F.flatten(covered))).cast("long")

    def counted(windows: Column) -> Column:
        placed = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            _let(F.array_sort(placed), positions))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                    lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))), counted))


def measures(text: Column) -> Column:
    """Struct of the counts that rules divide by each other. Words are runs without ASCII white space."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(_BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    stop = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws})])
    of_lines = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: F.ltrim(y).rlike(r"^[-*•]"))).cast("long").alias("n_bullets"),
        F.size(F.filter(x, lambda y: F.rtrim(y).rlike(r"(\.\.\.|…)$"))).cast("long").alias("n_ellipses")))
    of_words = _let(words, lambda x: F.struct(
        F.size(x).cast("long").alias("n_words"), _repeat_words(x).alias("n_repeat_words"),
        F.size(F.filter(x, lambda y: F.array_contains(stop, F.lower(y)))).cast("long").alias("n_stop_words")))
    return F.struct(
        of_words.alias("words"), of_lines.alias("lines"),
        F.length(F.translate(text, _BLANK, "")).cast("long").alias("word_chars"),
        _lost(text, _SYMBOLS).alias("n_symbols"), _lost(text, _CAPITALS).alias("n_capitals"))


def failed_rules(measure: Callable[[str], Column]) -> Column:
    """Names of the table's rules that a text fails. A ratio over zero passes."""
    checks = []
    for name, over, under, least, most in THRESHOLDS:
        ratio = measure(over) / F.nullif(measure(under), F.lit(0))
        low = ratio < least if least is not None else F.lit(False)
        high = ratio > most if most is not None else F.lit(False)
        checks.append(F.when(low | high, F.lit(name)))
    return F.array_compact(F.array(*checks))


def quality(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with the struct column ``out``: all measures, ``base_failed``, ``failed`` and ``kept``.

    A null text counts as empty; empty texts and texts below `MIN_WORDS` words fail. Rows
    are judged one by one: repeated rows get the same verdict, an empty table gives none.
    Other columns are kept; a column already named ``out`` is replaced.
    """
    def verdict(m: Column) -> Column:
        inner = {n: m["words"][n] for n in ("n_words", "n_repeat_words", "n_stop_words")}
        inner |= {n: m["lines"][n] for n in ("n_lines", "n_dup_lines", "n_bullets", "n_ellipses")}
        inner |= {n: m[n] for n in ("word_chars", "n_symbols", "n_capitals")}
        base = (inner["n_words"] < MIN_WORDS) | (100 * inner["n_repeat_words"] > MAX_REPEAT_PERCENT * inner["n_words"])
        failed = failed_rules(inner.__getitem__)
        return F.struct(*[inner[n].alias(n) for n in BASE + EXTRA], base.alias("base_failed"), failed.alias("failed"),
                        (~base & (F.size(failed) == 0)).alias("kept"))

    # One expression: a filter on the verdict that is pushed down then measures each text once, not once for each rule.
    return docs.withColumn(out, _let(measures(F.col(text)), verdict))
