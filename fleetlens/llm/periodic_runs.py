"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of words in which words one period apart are equal, which is at least
``least_words`` words and ``least_periods`` periods long, and which cannot grow. Re-Pair turns
the words of a text into a grammar. A run lies in the smallest symbol that holds it whole,
and crosses the border between that symbol's two parts; so the runs that cross the border
are looked for once per symbol, however often the symbol occurs, then carried to all its
occurrences. What a smaller symbol cuts off is part of an interval of the same period found
in a larger one; the maximal intervals are kept.

At a border, a run of four periods has two of them on one side, so its period shows as a
square that begins or ends there. All possible squares are compared by hash; what they
extend to is found by bisection over hashes and then compared word by word.

Words are identified by 64-bit hashes. Memory is bounded by the texts of one slice (a
megabyte) or one text.

Defined cases: a null or empty text has no words and no run; repeated rows and ids are
each judged for themselves; an empty table gives an empty result; columns of the input that
have a result's name are not read; a text of any length is judged whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import words as W
from fleetlens.llm.grammar import Nodes, bracket, repair

LEAST_WORDS, LEAST_PERIODS = 6, 4
_SLICE = 1 << 20
#: Squares compared at once.
_TESTS = 1 << 21

_RUNS = "array<struct<start: long, length: long, period: long>>"


class _Windows:
    """Equality of stretches of one array by hash."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values) + 1
        self._up, self._down = W._power("up", n), W._power("down", n)
        with np.errstate(over="ignore"):
            self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values) * self._up[: n - 1], dtype=np.uint64)])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` values from ``a`` equal those from ``b``."""
        with np.errstate(over="ignore"):
            one = (self._sum[a + size] - self._sum[a]) * self._down[a]
            return one == (self._sum[b + size] - self._sum[b]) * self._down[b]

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many values from ``a`` on equal those from ``b`` on, up to ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(a, b, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many values that end before ``a`` equal those that end before ``b``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(a - half, b - half, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low


def _squares(text: _Windows, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, first places and periods of all squares that begin or end at a symbol's border.

    The place of one that ends there is where its second half begins.
    """
    value, out = text.values, []
    whole = (nodes.end - nodes.begin) // LEAST_PERIODS
    for side, behind in ((nodes.end - nodes.middle, False), (nodes.middle - nodes.begin, True)):
        most = np.minimum(side // 2, whole)
        node = np.repeat(np.arange(len(most)), most)
        period = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
        at = nodes.middle[node]
        hit = value[at - 1] == value[at - 1 - period] if behind else value[at] == value[at + period]
        node, period, at = node[hit], period[hit], at[hit]
        hit = text.equal(at - period, at - 2 * period, period) if behind else text.equal(at, at + period, period)
        node, period, at = node[hit], period[hit], at[hit]
        out.append((node, at - period if behind else at, period))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _exact(value: np.ndarray, at: int, low: int, high: int, period: int) -> tuple[int, int]:
    """The part around ``at`` of [low, high) in which values a period apart are really equal."""
    wrong = np.flatnonzero(value[low : high - period] != value[low + period : high]) + low
    if len(wrong):
        before, after = wrong[wrong < at], wrong[wrong >= at]
        low = int(before[-1]) + 1 if len(before) else low
        high = int(after[0]) + period if len(after) else high
    return low, high


def _crossing(text: _Windows, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs inside each symbol that cross its border: symbol, start, end, period; the smallest period of each stretch."""
    node, at, period = _squares(text, nodes)
    low = at - text.behind(at, at + period, at - nodes.begin[node])
    high = at + period + text.ahead(at, at + period, nodes.end[node] - at - period)
    long = high - low >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    node, low, high, period, at = (x[long] for x in (node, low, high, period, at))
    # A stretch of period q has all multiples of q, too.
    order = np.lexsort([period, high, low, node])
    node, low, high, period, at = (x[order] for x in (node, low, high, period, at))
    new = np.ones(len(node), dtype=bool)
    new[1:] = (np.diff(node) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
    node, low, high, period, at = (x[new] for x in (node, low, high, period, at))
    for i, (m, a, b, q) in enumerate(zip(at.tolist(), low.tolist(), high.tolist(), period.tolist(), strict=True)):
        low[i], high[i] = _exact(text.values, m, a, b, q)
    true = high - low >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    return node[true], low[true], high[true], period[true]


def _slices_of(nodes: Nodes) -> Iterator[Nodes]:
    """The symbols long enough for a run, in parts of bounded work."""
    size = nodes.end - nodes.begin
    use = np.flatnonzero(size >= LEAST_WORDS)
    for a, b in W.slices(size[use].tolist(), _TESTS):
        own = use[a:b]
        times = nodes.first[own + 1] - nodes.first[own]
        first = np.concatenate([[0], np.cumsum(times)])
        place = nodes.place[np.repeat(nodes.first[own] - first[:-1], times) + np.arange(first[-1])]
        yield Nodes(nodes.begin[own], nodes.middle[own], nodes.end[own], first, place)


def find_runs(words: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start, then period.

    ``words`` are the word hashes of all sequences in a row; ``sequence`` tells them apart.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(words):
        return none, none, none
    own = words ^ W.mix(sequence.astype(np.uint64))
    symbols = np.unique(own, return_inverse=True)[1]
    rounds, begin, owner = repair(symbols, sequence)
    text, found = _Windows(words), []
    for nodes in [*rounds, *bracket(begin, owner, len(words))]:
        for part in _slices_of(nodes):
            node, low, high, period = _crossing(text, part)
            times = part.first[node + 1] - part.first[node]
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            shift = part.place[np.repeat(part.first[node], times) + inner] - np.repeat(part.begin[node], times)
            found.append([np.repeat(low, times) + shift, np.repeat(high, times) + shift, np.repeat(period, times)])
    low, high, period = (np.concatenate([none, *[f[i] for f in found]]) for i in range(3))
    # An interval inside another of its period is a piece of it.
    order = np.lexsort([-high, low, period])
    low, high, period = low[order], high[order], period[order]
    if len(low):
        width = len(words) + 1
        reach = np.maximum.accumulate(period * width + high)
        keep = np.concatenate([[True], (period * width + high)[1:] > reach[:-1]])
        low, high, period = low[keep], high[keep], period[keep]
    # A multiple of the smallest period has the same interval.
    order = np.lexsort([period, high, low])
    low, high, period = low[order], high[order], period[order]
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (np.diff(low) != 0) | (np.diff(high) != 0)
    low, high, period = low[keep], high[keep], period[keep]
    order = np.lexsort([period, low])
    return low[order], high[order], period[order]


def _longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of most periods, exactly; of equal ones the first, then the shortest period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _judged(texts: list[bytes]) -> list[tuple]:
    """Per text: its runs and the text without their repetitions."""
    found = W.split(texts, lower=False)
    low, high, period = find_runs(found.hashes, found.doc)
    dropped = np.zeros(len(found.hashes) + 1, dtype=np.int64)
    np.add.at(dropped, low + period, 1)
    np.add.at(dropped, high, -1)
    kept = np.cumsum(dropped)[:-1] == 0
    owner = np.searchsorted(found.first, low, side="right") - 1
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    low = low - found.first[owner]
    high = high - found.first[owner]
    runs = list(zip(low.tolist(), (high - low).tolist(), period.tolist(), strict=True))
    out = []
    for i, text in enumerate(texts):
        own = runs[starts[i] : starts[i + 1]]
        words = text.split()
        if own:
            stays = kept[found.first[i] : found.first[i + 1]].tolist()
            words = [w for w, stay in zip(words, stays, strict=True) if stay]
        out.append((own, b" ".join(words)))
    return out


def collapsed(text: Column) -> Column:
    """Each text's ``runs`` by start, then period, and its ``text``: words that repeat their run are left out."""

    @F.arrow_udf(f"struct<runs: {_RUNS}, text: string>")
    def collapse(column: pa.Array) -> pa.Array:
        texts, out = W.as_bytes(column), []
        for a, b in W.slices([len(t) for t in texts], _SLICE):
            for runs, text in _judged(texts[a:b]):
                out.append({"runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "text": text.decode()})
        return pa.array(out, _ARROW)

    return collapse(text)


_ARROW = pa.struct(
    [
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("text", pa.string()),
    ]
)


def run_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``n_runs``, the run of most periods, and digests of all runs and of the collapsed text.

    Digests are taken where the runs are found, so no text leaves its task.
    """
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    types = [pa.int64()] * 5 + [pa.string()] * 2
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, T.LongType() if t == pa.int64() else T.StringType()) for n, t in zip(names, types, strict=True)]])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.as_bytes(batch.column(1))
            for a, b in W.slices([len(t) for t in texts], _SLICE):
                found = []
                for runs, left in _judged(texts[a:b]):
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    start, length, period = _longest(runs) if runs else (None, None, None)
                    exponent = 1000 * length // period if runs else None
                    digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest()
                    found.append((len(runs), start, length, period, exponent, *digests))
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", *names])

    return rows.mapInArrow(digest, schema)
