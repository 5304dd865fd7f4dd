"""Secret scans: formats of labelled credentials learned as probabilistic automata, candidates scored by likelihood."""

from __future__ import annotations

import math
import re
import statistics
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .texts import strings

# The three known forms, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "learned")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Bounds on what the automata are fitted on: distinct values of each kind, the first by hash, and their length.
SAMPLE, LONGEST = 1000, 128
#: A state that fewer values reach is not tested by itself.
LEAST_VALUES = 8
#: Every so many values of a kind are held out to set the mark; such a share of them may lie below it.
HELD_OUT, MISSED = 5, 0.01
_ALPHA, _FLOOR, _LITERAL, _LETTERS = 0.05, math.log(1e-4), 4, 64


def known(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three known forms, leftmost and not overlapping within a form."""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return spans + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of 16 or more credential characters with a letter and a digit, apart from ``spans``."""
    out, taken = [], sorted(s[1:] for s in spans)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if not any(x < b and a < y for x, y in taken) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            out.append((a, b))
    return out


def _class(c: str) -> str:
    """Classes have two characters, so that they are no literal ones."""
    return c if len(c) > 1 else "09" if c.isdigit() else "af" if c in "abcdef" else "gz" if c.islower() else "AZ" if c.isupper() else c


def symbols(value: str) -> list[str]:
    """The first characters as they are, where formats keep their tags; then classes."""
    return [*value[:_LITERAL], *map(_class, value[_LITERAL:])]


@dataclass
class _State:
    depth: int = 0
    count: int = 0
    final: int = 0
    next: dict[str, int] = field(default_factory=dict)
    passed: dict[str, int] = field(default_factory=dict)
    rest: Counter = field(default_factory=Counter)  # how many symbols are still to come


class Automaton:
    """Probabilistic automaton from a prefix tree whose statistically compatible states are merged.

    Two states are compatible if the rates of each next symbol, of ending, and of each number of
    symbols to come differ by less than Hoeffding's bound at `_ALPHA`, and so do the states that
    follow, as far as enough values reach them. A state that few values reach bears no test and
    goes to the state of its depth that most reach. States are visited by breadth, so that values in any
    order give the same automaton. Every fifth value is held out; the mark to reach is what all
    but a few of those score, or less.
    """

    def __init__(self, values: Iterable[str]):
        values = sorted(values)
        held = values[::HELD_OUT] if len(values) >= 2 * HELD_OUT else []
        self.states = [_State()]
        for v in (v for i, v in enumerate(values) if not held or i % HELD_OUT):
            at, path = 0, symbols(v)
            self._pass(0, len(path))
            for i, s in enumerate(path):
                state = self.states[at]
                state.passed[s] = state.passed.get(s, 0) + 1
                if s not in state.next:
                    state.next[s] = len(self.states)
                    self.states.append(_State(i + 1))
                at = state.next[s]
                self._pass(at, len(path) - i - 1)
            self.states[at].final += 1
        self.red = self._merge()
        self.near = self._classes()
        scores = sorted(map(self.score, held or values))
        # Few values say little of the lowest scores: the mark is three deviations down at least, or a tenth of the way to the floor.
        middle, spread = (statistics.fmean(scores), statistics.pstdev(scores)) if scores else (0.0, 0.0)
        self.least = min(scores[int(MISSED * len(scores))], middle - max(3 * spread, (middle - _FLOOR) / 10)) if scores else 0.0

    def _pass(self, at: int, rest: int) -> None:
        self.states[at].count += 1
        self.states[at].rest[rest] += 1

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            x, y = (self.states[i] for i in todo.pop())
            if min(x.count, y.count) < LEAST_VALUES:
                continue
            bound = math.sqrt(0.5 * math.log(2 / _ALPHA)) * (1 / math.sqrt(x.count) + 1 / math.sqrt(y.count))
            rates = [(x.final, y.final), *((x.rest[r], y.rest[r]) for r in x.rest.keys() | y.rest.keys()),
                     *((x.passed.get(s, 0), y.passed.get(s, 0)) for s in x.passed.keys() | y.passed.keys())]
            if any(abs(a / x.count - b / y.count) > bound for a, b in rates):
                return False
            todo += [(x.next[s], y.next[s]) for s in x.next.keys() & y.next.keys()]
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            i, j = todo.pop()
            if i == j:
                continue
            x, y = self.states[i], self.states[j]
            x.count += y.count
            x.final += y.final
            x.rest += y.rest
            for s, n in y.passed.items():
                x.passed[s] = x.passed.get(s, 0) + n
                if s in x.next:
                    todo.append((x.next[s], y.next[s]))
                else:
                    x.next[s] = y.next[s]

    def _merge(self) -> list[int]:
        red, states = [0], self.states
        while True:
            # Of the shallowest states that are not settled the one with most values; folding may hang new ones below any red state.
            blue = min(((states[c].depth, -states[c].count, q, s) for q in red for s, c in states[q].next.items() if c not in red), default=None)
            if blue is None:
                return red
            depth, count, parent, s = blue
            child = states[parent].next[s]
            if -count < LEAST_VALUES:
                into = max((r for r in red if states[r].depth == depth), key=lambda r: states[r].count, default=None)
            else:
                fit = [r for r in red if states[r].count >= LEAST_VALUES and self._compatible(r, child)]
                into = min(fit, key=lambda r: abs(states[r].depth - depth), default=None)
            if into is None:
                red.append(child)
            else:
                states[parent].next[s] = into
                self._fold(into, child)

    def _classes(self) -> list[set[str]]:
        """Classes of the symbols that follow the states of each depth and those next to it."""
        deepest = max(self.states[r].depth for r in self.red)
        own = [{_class(s) for r in self.red if self.states[r].depth == d for s in self.states[r].next} for d in range(deepest + 1)]
        return [set().union(*own[max(0, d - 1):d + 2]) if own[d] else set() for d in range(deepest + 1)]

    def score(self, value: str) -> float:
        """Mean log likelihood of the value's symbols and of its end.

        A symbol that a state has not seen, though its class stands about there, has a smoothed rate
        and goes where most values go. From a symbol of a new class there on each costs `_FLOOR`, and so do
        the symbols that are missing where no value has ended.
        """
        at, total, all_ = 0, 0.0, symbols(value)
        for i, s in enumerate(all_):
            state = self.states[at]
            if s in state.next:
                total += math.log(state.passed[s] / state.count)
            elif state.next and _class(s) in self.near[state.depth]:
                total -= math.log(state.count + _LETTERS)
                s = max(sorted(state.next), key=state.passed.__getitem__)
            else:
                return (total + _FLOOR * (len(all_) - i + 1)) / (len(all_) + 1)
            at = state.next[s]
        end, missing = self.states[at], 0
        if not end.final:
            missing = min(end.rest, default=0)
        return (total + (math.log(end.final / end.count) if end.final else _FLOOR * (missing + 1))) / (len(all_) + missing + 1)


@dataclass
class Detector:
    """Automata of the known kinds, and one of other candidates that formats must beat; equal likelihood is no secret."""

    formats: dict[str, Automaton]
    other: Automaton | None

    def secret(self, value: str) -> bool:
        base = self.other.score(value) if self.other else -math.inf
        return any((s := a.score(value)) >= a.least and s > base for a in self.formats.values())

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans by start, then by kind as listed."""
        base = known(text)
        base += [("learned", a, b) for a, b in candidates(text, base) if self.secret(text[a:b])]
        return sorted(base, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def labelled(text: str) -> list[tuple[str, str]]:
    """Credentials of the known forms with their kind, and other candidates as ``other``; long ones are not learned from."""
    spans = known(text)
    found = [(k, m[2] if k == "assign" and (m := ASSIGN.match(text, a)) else text[a:b]) for k, a, b in spans]
    # A value of a form of its own is learned as that form only.
    found = [("hex" if HEX.fullmatch(v) else "access" if ACCESS.fullmatch(v) else k, v) for k, v in found]
    found += [("other", text[a:b]) for a, b in candidates(text, spans)]
    return [(k, v) for k, v in found if len(v) <= LONGEST]


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Detector:
    """Learn from at most ``sample`` distinct values of each kind, the first by their hash, out of all documents."""
    @F.arrow_udf("array<struct<kind:string,value:string>>")
    def extract(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "value": v} for k, v in labelled(t or "")] for t in strings(texts)],
                        pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))

    values = staged(docs.select(F.inline(extract(F.col(text)))).distinct(), "labelled-credentials")
    def first(kind: str) -> list[str]:
        rows = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample)
        return [r["value"] for r in rows.collect()]
    learned = {k: first(k) for k in KINDS[:3]}
    other = first("other")
    return Detector({k: Automaton(v) for k, v in learned.items() if v}, Automaton(other) if other else None)


def scan(docs: DataFrame, detector: Detector | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``, an array of (kind, start, end) by start: code points, end exclusive.

    Every candidate of every whole text is scored, however long the text; a few megabytes of texts
    are in Python at a time. A null text is empty and has no spans.
    Repeated rows agree, an empty table gives no rows. Other columns are kept; a column named
    ``secrets`` is replaced.
    """
    detector = detector or fit(docs, text)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in detector.spans(t or "")] for t in strings(texts)],
                        pa.list_(span))

    return docs.withColumn("secrets", spans(F.col(text)))


def redacted(docs: DataFrame, detector: Detector | None = None, text: str = "text", by: str = "[secret]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``by``, overlapping spans once; null stays null."""
    detector = detector or fit(docs, text)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in strings(texts):
            done, at = [], 0
            for _, a, b in detector.spans(t) if t else ():
                if a >= at:
                    done += [t[at:a], by]
                at = max(at, b)
            out.append(t if t is None else "".join([*done, t[at:]]))
        return pa.array(out, pa.string())

    return docs.withColumn(text, clean(F.col(text)))
