"""URL filters: pattern rules found by their rarest literal token, checked by regular expression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import strings

#: Host (with all subdomains) and path prefix to verdict; the longest rule that fits wins.
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: ``*`` is any run of characters, ``^`` one separator or the end, ``||`` the start of a host label, ``|`` an end
#: of the url; a leading ``@@`` allows what others block. Letters match in either case.
PATTERNS = [
    "||spam-farm.", "||casino*.example.", "/adserver/*", "/banner*.gif|", "^tracker^", "&affiliate_id=", "?utm_source=feed^",
    "||click.*/redirect^", "/popup^", "|https://ads.", "@@||blog.*?utm_source=feed^", "@@/docs/*", "@@||m.*^popup^",
]

_TOKEN = re.compile(r"[a-z0-9]+")
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


@dataclass(frozen=True)
class Rule:
    pattern: str
    allow: bool
    regex: str
    tokens: tuple[str, ...]


def parse(pattern: str) -> Rule:
    """Regular expression of a pattern, and the literal tokens that every url it matches holds whole."""
    allow, body = pattern.startswith("@@"), pattern.removeprefix("@@").lower()
    host = body.startswith("||")
    start = not host and body.startswith("|")
    body = body.removeprefix("||") if host else body.removeprefix("|")
    end = body.endswith("|")
    body = body.removesuffix("|")
    regex = "".join({"*": ".*", "^": _SEPARATOR}.get(c, re.escape(c)) for c in body)
    regex = (r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if host else "^" if start else "") + regex + ("$" if end else "")
    tokens = []
    for m in _TOKEN.finditer(body):
        # A token is whole in the url only if the pattern fixes what stands on both of its sides.
        left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and (host or start)
        right = m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and end
        if left and right:
            tokens.append(m.group())
    return Rule(pattern, allow, regex, tuple(dict.fromkeys(tokens)))


class Index:
    """Rules by their rarest token; rules without a whole token are candidates of every url."""

    def __init__(self, patterns: Iterable[str], frequency: Counter[str]):
        rules = [parse(p) for p in dict.fromkeys(patterns)]
        self.rules, self.by_token, self.always = rules, {}, []
        for i, r in enumerate(rules):
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (frequency[t], -len(t), t)), []).append(i)
            else:
                self.always.append(i)
        self._compiled: dict[int, re.Pattern] = {}

    def __getstate__(self):
        return {**self.__dict__, "_compiled": {}}

    def match(self, url: str) -> tuple[str, str | None, int]:
        """(verdict, deciding pattern, candidates): allow patterns win, then the first in the list's order."""
        url = url.lower()
        found = {i for t in set(_TOKEN.findall(url)) for i in self.by_token.get(t, ())}
        found.update(self.always)
        hit = None
        for i in sorted(found):
            if hit is not None and not self.rules[i].allow:
                continue
            if i not in self._compiled:
                self._compiled[i] = re.compile(self.rules[i].regex, re.S)
            if self._compiled[i].search(url):
                hit = i
                if self.rules[i].allow:
                    break
        rule = None if hit is None else self.rules[hit]
        return ("allow" if rule is None or rule.allow else "block"), rule and rule.pattern, len(found)


def token_counts(urls: DataFrame, url: str, patterns: Iterable[str]) -> Counter[str]:
    """How many urls hold each token of the rules, over all urls; no more rows than the rules have tokens."""
    wanted = sorted({t for p in patterns for t in parse(p).tokens})
    if not wanted:
        return Counter()
    tokens = F.array_intersect(F.split(F.lower(F.col(url)), "[^a-z0-9]+"), F.array(*map(F.lit, wanted)))
    return Counter({r["t"]: r["count"] for r in urls.select(F.explode(tokens).alias("t")).groupBy("t").count().collect()})


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, url: str = "url", host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """``pages`` with the struct column ``filter``: host, path, rule, verdict, pattern, n_candidates.

    A host rule decides where one fits (the longest; ``rule`` is its text); otherwise the patterns
    decide, found through the rarest of their tokens over all urls. A null url, or one without
    ``://``, has an empty host and path and fits no host rule; patterns see it as it is, null as
    empty, and urls of any length whole. The rules are the caller's list and go to each executor
    once. Rows are judged one by one, so repeated rows agree and an empty table gives no rows.
    Other columns are kept; a column named ``filter`` is replaced.
    """
    index = pages.sparkSession.sparkContext.broadcast(Index(patterns, token_counts(pages, url, patterns)))
    kind = "struct<verdict:string,pattern:string,n_candidates:int>"

    @F.arrow_udf(kind)
    def by_pattern(urls: pa.Array) -> pa.Array:
        match = index.value.match
        memo = [match(u or "") for u in strings(urls)]
        return pa.StructArray.from_arrays(
            [pa.array([m[0] for m in memo], pa.string()), pa.array([m[1] for m in memo], pa.string()),
             pa.array([m[2] for m in memo], pa.int32())], ["verdict", "pattern", "n_candidates"])

    # What is known so far stands in the result's own place, so that no other column is in the way.
    so_far = F.col("filter")
    fits = [(F.when(((so_far["host"] == h) | F.endswith(so_far["host"], F.lit(f".{h}"))) & F.startswith(so_far["path"], F.lit(p)),
                    F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))))
            for h, p, v in sorted(host_rules, key=lambda r: (-len(r[0] + r[1]), r))]
    rows = pages.withColumn("filter", F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), by_pattern(F.col(url)).alias("by")))
    rows = rows.withColumn("filter", F.struct("filter.*", F.coalesce(*fits).alias("fit")))
    return rows.withColumn("filter", F.struct(
        so_far["host"].alias("host"), so_far["path"].alias("path"), so_far["fit"]["rule"].alias("rule"),
        F.coalesce(so_far["fit"]["verdict"], so_far["by"]["verdict"]).alias("verdict"),
        F.when(so_far["fit"].isNull(), so_far["by"]["pattern"]).alias("pattern"), so_far["by"]["n_candidates"].alias("n_candidates"),
    ))
