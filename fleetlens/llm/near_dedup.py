"""MinHash near-duplicate classes: DartMinHash signatures, banded join, exact check.

A text is the weighted set of its runs of five words (A-Z lower-cased, split at white
space); a text of fewer words is one run. Equal texts are one row from the start. Texts
that agree in a whole band of their signatures share a bucket. In a bucket all pairs are
compared by their exact weighted Jaccard similarity, and the components of the links are
what leaves the task, never the pairs. Buckets with the same members are compared once. A
large bucket is dealt into blocks, and each pair of blocks is a task of bounded size.

Two texts of similarity 0.8 miss each other with probability 5e-6 (40 bands of 6).

Defined cases: a null text is a class of its own, never grouped; texts without words are
grouped if they are equal; a class is named by its smallest id, or null if none has one;
repeated rows are in one class; an empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import words as W
from fleetlens.llm.components import connected_components
from fleetlens.llm.dart_minhash import signatures
from fleetlens.session import materialize

_SLICE = 1 << 19


@dataclass(frozen=True)
class NearRule:
    """Texts are linked at a similarity of at least ``least[0] / least[1]``.

    ``block_texts`` and ``block_cells`` bound, on average, what a side of one comparison holds.
    """

    run: int = 5
    least: tuple[int, int] = (4, 5)
    bands: int = 40
    rows: int = 6
    block_texts: int = 256
    block_cells: int = 1 << 20


def weighted_cells(texts: list[bytes], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs, a repeated run once per repetition, and where each text's begin."""
    found = W.split(texts)
    hashes, at = W.windows(found, run)
    owner = found.doc[at]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(fresh)
    times = np.arange(len(hashes)) - np.repeat(begins, np.diff(np.append(begins, len(hashes))))
    with np.errstate(over="ignore"):
        cells = np.where(fresh, hashes, W.mix(hashes + times.astype(np.uint64)))
    return cells, np.searchsorted(owner, np.arange(len(texts) + 1))


def _band_keys(text: Column, rule: NearRule) -> Column:
    """A struct per text: ``cells``, how many it has, and ``bands``, a key per band (none without words)."""
    arrow = pa.struct([("cells", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<cells: long, bands: array<long>>")
    def keys(column: pa.Array) -> pa.Array:
        texts, out = W.as_bytes(column), []
        for a, b in W.slices([len(t) for t in texts], _SLICE):
            cells, first = weighted_cells(texts[a:b], rule.run)
            dart = signatures(cells, first, rule.bands * rule.rows).reshape(b - a, rule.bands, rule.rows)
            key = np.broadcast_to(W.mix(np.arange(rule.bands)), (b - a, rule.bands))
            with np.errstate(over="ignore"):
                for j in range(rule.rows):
                    key = W.mix(key + dart[:, :, j])
            for size, line in zip(np.diff(first).tolist(), key.view(np.int64).tolist(), strict=True):
                out.append({"cells": size, "bands": line if size else []})
        return pa.array(out, arrow)

    return keys(text)


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def distinct_texts(docs: DataFrame, rule: NearRule, doc_id: str, text: str) -> DataFrame:
    """One written row per distinct text: ``vid``, ``key``, ``first_id``, ``copies``, ``cells``, ``bands``."""
    rows = docs.filter(F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), _text_key(F.col(text)).alias("key"),
        _band_keys(F.col(text), rule).alias("s"),
    )
    texts = rows.groupBy("key").agg(
        F.min("id").alias("first_id"), F.count("*").alias("copies"), F.any_value("s").alias("s")
    )
    # Fixed once written: later steps read the numbers, they do not make them again.
    return materialize(
        texts.select(F.monotonically_increasing_id().alias("vid"), "key", "first_id", "copies", "s.*"),
        "texts",
    )


def _tasks(texts: DataFrame, rule: NearRule) -> DataFrame:
    """``task`` and ``vid``: which texts are compared together."""
    held = texts.select("vid", "cells", F.explode("bands").alias("bucket"))
    mark = F.xxhash64("vid").cast("decimal(20,0)")
    buckets = (
        held.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum("cells").alias("cells"), F.sum(mark).alias("mark"))
        .filter("n > 1")
        # The same members in several bands need one comparison.
        .groupBy("n", "cells", "mark")
        .agg(F.min("bucket").alias("bucket"))
        .withColumn(
            "blocks",
            F.greatest(
                F.ceil(F.col("n") / (2 * rule.block_texts)), F.ceil(F.col("cells") / (2 * rule.block_cells))
            ).cast("int"),
        )
        .select("bucket", F.when(F.col("blocks") > 1, 2 * F.col("blocks")).otherwise(1).alias("blocks"))
    )
    own = F.pmod(F.xxhash64("vid", F.lit(1)), F.col("blocks")).cast("int")
    others = F.expr("filter(sequence(0, blocks - 1), x -> blocks = 1 OR x <> own)")
    return (
        held.select("vid", "bucket")
        .join(buckets, "bucket")
        .withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select(
            "vid",
            F.struct("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("task"),
        )
    )


def links(sets: list[np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """The component of each set (the smallest member's place), where links are pairs of a similarity
    of at least ``least[0] / least[1]``."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    number = np.cumsum(np.diff(column, prepend=-1) > 0) - 1
    portion = max(1, (1 << 21) // len(sets))
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, portion):
        low, high = np.searchsorted(number, [a, a + portion])
        holds = np.zeros((len(sets), portion), dtype=np.float32)
        holds[owner[low:high], number[low:high] - a] = 1
        common += holds @ holds.T
    # common / (a + b - common) >= p / q
    p, q = least
    linked = (p + q) * common >= p * (size[:, None] + size[None, :])
    label = np.arange(len(sets))
    while True:
        lower = np.where(linked, label[None, :], len(sets)).min(axis=1)
        lower = np.minimum(lower, label)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _compare(rule: NearRule):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(vids: list[int], sets: list[bytes]) -> pa.RecordBatch:
        vids = np.array(vids)
        root = vids[links([np.frombuffer(s, np.uint64) for s in sets], rule.least)]
        other = root != vids
        return pa.RecordBatch.from_arrays([pa.array(vids[other]), pa.array(root[other])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, vids, sets = None, [], []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "vid", "set")), strict=True)
            for *task, vid, cells in rows:
                if task != current:
                    if len(vids) > 1:
                        yield edges(vids, sets)
                    current, vids, sets = task, [], []
                vids.append(vid)
                sets.append(cells)
        if len(vids) > 1:
            yield edges(vids, sets)

    return run


def _cell_sets(docs: DataFrame, wanted: DataFrame, rule: NearRule, doc_id: str, text: str) -> DataFrame:
    """``vid`` and ``set`` (hashes, 8 bytes each) of the texts that ``wanted`` names."""

    @F.arrow_udf("binary")
    def cells_of(column: pa.Array) -> pa.Array:
        texts, out = W.as_bytes(column), []
        for a, b in W.slices([len(t) for t in texts], _SLICE):
            cells, first = weighted_cells(texts[a:b], rule.run)
            out += [cells[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
        return pa.array(out, pa.binary())

    one_row = F.col("_id").eqNullSafe(F.col("first_id")) & (F.col("_key") == F.col("key"))
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), _text_key(F.col(text)).alias("_key"), text)
    found = rows.join(wanted, one_row).select("vid", cells_of(F.col(text)).alias("set"))
    # A row may be repeated.
    return found.groupBy("vid").agg(F.any_value("set").alias("set"))


def text_classes(
    docs: DataFrame, rule: NearRule = NearRule(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One written row per distinct text: ``key`` (MD5), ``class_id``, ``class_size`` (documents), ``keeper``
    (the key of the text that its class keeps)."""
    texts = distinct_texts(docs, rule, doc_id, text)
    tasks = materialize(_tasks(texts, rule), "tasks")
    wanted = texts.join(tasks.select("vid").distinct(), "vid").select("vid", "key", "first_id")
    members = tasks.join(_cell_sets(docs, wanted, rule, doc_id, text), "vid").select("task.*", "vid", "set")
    compared = (
        members.repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_compare(rule), "a long, b long")
    )
    roots = connected_components(compared)
    linked = roots.join(texts.select("vid", "key", "first_id", "copies"), F.col("vertex") == F.col("vid"))
    # The smallest id keeps; a class without ids keeps the smallest key.
    order = F.struct(F.col("first_id").isNull(), "first_id", "key")
    classes = linked.groupBy("root").agg(
        F.min("first_id").alias("class_id"),
        F.sum("copies").alias("class_size"),
        F.min_by("key", order).alias("keeper"),
    )
    named = roots.join(classes, "root").select("vertex", "class_id", "class_size", "keeper")
    return materialize(
        texts.join(named, F.col("vid") == F.col("vertex"), "left").select(
            "key",
            F.when(F.col("vertex").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", "copies").alias("class_size"),
            F.coalesce("keeper", "key").alias("keeper"),
        ),
        "classes",
    )


def near_classes(
    docs: DataFrame, rule: NearRule = NearRule(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: its id, ``class_id``, ``class_size`` and ``kept`` (the class's document to keep;
    repeated rows of it are marked alike)."""
    classes = text_classes(docs, rule, doc_id, text)
    rows = docs.select(F.col(doc_id), _text_key(F.col(text)).alias("_key"))
    return rows.join(classes, F.col("_key") == F.col("key"), "left").select(
        doc_id,
        F.when(F.col("_key").isNull(), F.col(doc_id)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.when(F.col("_key").isNull(), F.lit(True))
        .otherwise((F.col("key") == F.col("keeper")) & F.col(doc_id).eqNullSafe(F.col("class_id")))
        .alias("kept"),
    )


def keep_one(
    docs: DataFrame, rule: NearRule = NearRule(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with one document per class, unchanged; rows without text all stay."""
    classes = text_classes(docs, rule, doc_id, text)
    keepers = classes.filter(F.col("key") == F.col("keeper")).select(
        F.col("key").alias("_keeper"), F.col("class_id").alias("_class")
    )
    ids = docs.select(F.col(doc_id).alias("_class"), _text_key(F.col(text)).alias("_keeper"))
    rows = (
        ids.filter(F.col("_keeper").isNotNull())
        .groupBy("_class", "_keeper")
        .agg(F.count("*").alias("_rows"))
    )
    keepers = materialize(
        keepers.alias("k")
        .join(
            rows.alias("r"),
            (F.col("k._keeper") == F.col("r._keeper")) & F.col("k._class").eqNullSafe(F.col("r._class")),
        )
        .select("k.*", "_rows"),
        "keepers",
    )
    same = F.col(doc_id).eqNullSafe(F.col("_class")) & (_text_key(F.col(text)) == F.col("_keeper"))
    kept = docs.join(keepers.filter("_rows = 1"), same, "left_semi")
    repeated = keepers.filter("_rows > 1")
    if not repeated.isEmpty():
        # Rows that share id and text: any one of each.
        copies = docs.join(repeated, same).dropDuplicates(["_class", "_keeper"])
        kept = kept.unionByName(copies.select(*docs.columns))
    return kept.unionByName(docs.filter(F.col(text).isNull()))
