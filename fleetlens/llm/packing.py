"""Packing documents into sequences as a cutting-stock problem.

Each document is cut into whole sequences and one remainder. The remainders' lengths,
rounded up to units, make a histogram of at most ``capacity / unit`` classes, whatever
the corpus. Column generation finds how many sequences of which pattern of classes fill
least: a linear program over the patterns known so far gives each class a price, a
knapsack by dynamic programming finds the pattern worth most at these prices, until none
is worth more than a sequence. The whole parts of the solution are then handed out to the
remainders of each class by rank. What the rounding leaves is bounded by the number of
classes; it is laid end to end and cut at the sequences' ends.

Ranks need no sort: a task counts the pieces of each class as it writes them, and the
tasks' counts, summed, say where its ranks begin.

Defined cases: a null text is empty, and an empty one is its closing id alone; repeated
rows and ids are packed as often as they occur; an empty table has no pieces; texts of
any length are cut, never shortened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import words as W
from fleetlens.llm.tokens import worker_tokenizer
from fleetlens.session import materialize

_SLICE = 1 << 20


@dataclass(frozen=True)
class PackingPlan:
    """How often (``uses``) each pattern (a line of ``patterns``, pieces per class) is used."""

    classes: np.ndarray
    patterns: np.ndarray
    uses: np.ndarray


def _best_pattern(prices: np.ndarray, classes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: pieces per class worth most within ``room`` units."""
    worth, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for space in range(1, room + 1):
        fits = np.searchsorted(classes, space, side="right")
        worth[space] = worth[space - 1]
        if fits:
            value = worth[space - classes[:fits]] + prices[:fits]
            best = int(value.argmax())
            if value[best] > worth[space] + 1e-12:
                worth[space], choice[space] = value[best], best
    pattern, space = np.zeros(len(classes)), room
    while space > 0:
        if choice[space] < 0:
            space -= 1
        else:
            pattern[choice[space]] += 1
            space -= classes[choice[space]]
    return float(worth[room]), pattern


def plan_patterns(demand: dict[int, int], room: int, rounds: int = 20) -> PackingPlan:
    """Solve the linear program by column generation; ``uses`` are rounded down.

    ``demand`` has the number of pieces per class (its units). After ``rounds`` steps per
    class the solution at hand is used: it is feasible at any time.
    """
    classes = np.array(sorted(c for c, n in demand.items() if n), dtype=np.int64)
    m = len(classes)
    if not m:
        return PackingPlan(classes, np.zeros((0, 0)), np.zeros(0, dtype=np.int64))
    whole = room // classes
    patterns = np.diag(whole).astype(float)
    inverse = np.diag(1.0 / whole)
    amount = np.array([demand[int(c)] for c in classes]) / whole
    for _ in range(rounds * m):
        worth, pattern = _best_pattern(inverse.sum(axis=0), classes, room)
        if worth <= 1 + 1e-9:
            break
        change = inverse @ pattern
        can = change > 1e-9
        steps = np.where(can, amount / np.where(can, change, 1), np.inf)
        out = int(steps.argmin())
        step = steps[out]
        amount = np.maximum(amount - step * change, 0)
        amount[out] = step
        patterns[out] = pattern
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
    return PackingPlan(classes, patterns, np.floor(amount + 1e-6).astype(np.int64))


def cut_documents(
    docs: DataFrame,
    tokenizer_path: Callable[[], str],
    end_id: int,
    capacity: int,
    unit: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece, written: its ids (little-endian), place in the document, class and rank.

    ``tokenizer_path`` is called in the tasks, as the file lies on each machine.
    """
    top = capacity // unit
    schema = (
        "doc_id long, start long, length long, doc_tokens long, ids binary, "
        "class int, task int, task_rank long"
    )
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "class", "task", "task_rank"]
    types = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(tokenizer_path(), end_id)
        task, counts = TaskContext.get().partitionId(), [0] * (top + 1)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), W.as_bytes(batch.column(1))
            for a, b in W.slices([len(t) for t in texts], _SLICE):
                ids, first = tokenizer.encode(texts[a:b])
                first = first.tolist()
                rows = []
                for key, begin, end in zip(keys[a:b], first[:-1], first[1:], strict=True):
                    for at in range(begin, end, capacity):
                        piece = ids[at : min(at + capacity, end)]
                        size = -(-len(piece) // unit)
                        rows.append(
                            (key, at - begin, len(piece), end - begin, piece.tobytes(), size, task, counts[size])
                        )
                        counts[size] += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    cut = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)
    return materialize(cut, "pieces", compression="zstd")


def _ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with their rank among all of their class."""
    counts = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        "class", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")
    )
    return (
        pieces.join(begins, ["class", "task"])
        .withColumn("rank", F.col("begin") + F.col("task_rank"))
        .drop("begin")
    )


def _assign(pieces: DataFrame, plan: PackingPlan) -> DataFrame:
    """Add ``sequence_id`` and the order inside it; both null for what no pattern takes."""
    base = np.concatenate([[0], np.cumsum(plan.uses)])
    begins, bases, times = {}, {}, {}
    for k, c in enumerate(plan.classes.tolist()):
        own = np.flatnonzero((plan.patterns[:, k] > 0.5) & (plan.uses > 0))
        n = np.rint(plan.patterns[own, k]).astype(np.int64)
        begins[c] = np.concatenate([[0], np.cumsum(n * plan.uses[own])])
        bases[c], times[c] = base[own], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("class").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, slot = np.full(len(rank), -1, np.int64), np.zeros(len(rank), np.int64)
            for c in np.unique(kind).tolist():
                taken = np.flatnonzero((kind == c) & (rank < begins[c][-1]))
                pattern = np.searchsorted(begins[c], rank[taken], side="right") - 1
                inner = rank[taken] - begins[c][pattern]
                sequence[taken] = bases[c][pattern] + inner // times[c][pattern]
                slot[taken] = inner % times[c][pattern]
            columns = [*batch.columns, pa.array(sequence, mask=sequence < 0), pa.array(slot)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "slot"])

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())]
    schema = T.StructType([*pieces.schema.fields, *added])
    return pieces.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer_path: Callable[[], str],
    end_id: int,
    capacity: int = 4096,
    unit: int = 16,
    doc_id: str = "doc_id",
    text: str = "text",
    content: Callable[[Column], Column] = lambda ids: ids,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``,
    and ``content`` of its ids: the ids themselves, or what the caller makes of them, which then
    is all that moves.
    """
    stored = cut_documents(docs, tokenizer_path, end_id, capacity, unit, doc_id, text)
    sizes = stored.groupBy("class").agg(F.count("*").alias("n")).collect()
    plan = plan_patterns({r["class"]: r["n"] for r in sizes}, capacity // unit)
    placed = stored.withColumn("content", content(F.col("ids"))).drop("ids")
    placed = materialize(_assign(_ranked(placed), plan), "placed", compression="zstd")
    inside = Window.partitionBy("sequence_id").orderBy("class", "slot")
    by_pattern = placed.filter("sequence_id IS NOT NULL").withColumn(
        "offset", F.sum("length").over(inside) - F.col("length")
    )
    # At most classes x patterns pieces are left, however large the corpus.
    along = Window.orderBy("class", "rank")
    key = ["class", "task", "task_rank"]
    left = (
        placed.filter("sequence_id IS NULL")
        .select(*key, F.sum("length").over(along).alias("to"), "length")
        .withColumn("at", F.col("to") - F.col("length"))
        .withColumn("part", F.explode(F.expr(f"sequence(at div {capacity}, (to - 1) div {capacity})")))
        .withColumn("begin", F.greatest("at", F.col("part") * capacity))
        .select(
            *key,
            (F.col("part") + int(plan.uses.sum())).alias("sequence_id"),
            (F.col("begin") - F.col("part") * capacity).alias("offset"),
            (F.col("begin") - F.col("at")).alias("skip"),
            (F.least("to", (F.col("part") + 1) * capacity) - F.col("begin")).alias("take"),
        )
    )
    laid = stored.join(F.broadcast(left), key).select(
        "doc_id",
        (F.col("start") + F.col("skip")).alias("start"),
        F.col("take").alias("length"),
        "doc_tokens",
        "sequence_id",
        "offset",
        content(F.expr("substring(ids, int(4 * skip) + 1, int(4 * take))")).alias("content"),
    )
    return by_pattern.select(*laid.columns).unionByName(laid)
