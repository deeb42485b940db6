"""Token counts by a two-tier lookup of word lengths on the map side.

The tokenizer in use drops white space and never joins words across it, so a text has as
many tokens as its words have together, and words repeat. The first tier is a compact
table from word hash to number of tokens, broadcast: the words most frequent in the first
``slices`` runs of texts, of a megabyte each. It is a cache and no statistic: what is picked changes the
time, never a count, so a bounded look at the table is enough. The second tier is a table
of the same kind in each Python worker, which keeps what its tasks had to encode. Only
words in neither are given to the tokenizer. No word leaves its task.

Defined cases: a null text is empty and has no tokens; null and repeated ids and repeated
rows are counted like others; an empty table gives an empty result; columns that have a
result's name are not read. Special strings inside a text are special tokens, as is the
library's default. A text of any length is one row and is read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import words as W
from fleetlens.llm.hash_table import HashTable
from fleetlens.llm.tokens import worker_tokenizer

#: Words in the broadcast table at most (12 bytes each, at most half of its slots in use).
FREQUENT_WORDS = 1 << 17
#: Slots of a worker's own table; a word that finds no place replaces another.
CACHE_SLOTS = 1 << 21
_SLICE = 1 << 20

_caches: dict[str, HashTable] = {}


def _cache(path: str) -> HashTable:
    if path not in _caches:
        _caches.clear()
        _caches[path] = HashTable(CACHE_SLOTS)
    return _caches[path]


def _encoded_lengths(found: W.Words, at: np.ndarray, path: str) -> np.ndarray:
    """The number of tokens of the words at ``at``, by the tokenizer."""
    raw = found.data.tobytes()
    spans = zip(found.start[at].tolist(), found.end[at].tolist(), strict=True)
    return worker_tokenizer(path, 0).lengths([raw[a:b].decode() for a, b in spans])


def _lengths(found: W.Words, path: str, known: HashTable | None = None) -> np.ndarray:
    """The number of tokens of each word: from the table, this worker's own, or the tokenizer."""
    own = _cache(path)
    lengths = np.full(len(found.hashes), -1) if known is None else known.get(found.hashes).astype(np.int64)
    rare = np.flatnonzero(lengths < 0)
    lengths[rare] = own.get(found.hashes[rare])
    missed = rare[lengths[rare] < 0]
    if len(missed):
        fresh, at, inverse = np.unique(found.hashes[missed], return_index=True, return_inverse=True)
        learnt = _encoded_lengths(found, missed[at], path)
        lengths[missed] = learnt[inverse]
        own.put(fresh, learnt)
    return lengths


def frequent_lengths(
    docs: DataFrame,
    tokenizer_path: Callable[[], str],
    text: str = "text",
    size: int = FREQUENT_WORDS,
    slices: int = 16,
) -> HashTable:
    """The first tier. The driver gets at most ``slices`` rows of ``size / 4`` words each (or 1,024)."""
    each = max(size // 4, 1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.as_bytes(batch.column(0))
            for a, b in W.slices([len(t) for t in texts], _SLICE):
                found = W.split(texts[a:b], lower=False)
                hashes, at, counts = np.unique(found.hashes, return_index=True, return_counts=True)
                top = np.argsort(-counts, kind="stable")[:each]
                lengths = _lengths(found, tokenizer_path())[at[top]]
                packed = [hashes[top].astype("<u8"), lengths.astype("<i4"), counts[top].astype("<i8")]
                row = [pa.array([x.tobytes()], pa.binary()) for x in packed]
                yield pa.RecordBatch.from_arrays(row, ["hash", "length", "n"])

    looked = docs.select(text).mapInArrow(run, "hash binary, length binary, n binary")
    rows = looked.limit(slices).collect() if size else []
    hashes = np.concatenate([np.zeros(0, "<u8"), *[np.frombuffer(r["hash"], "<u8") for r in rows]])
    lengths = np.concatenate([np.zeros(0, "<i4"), *[np.frombuffer(r["length"], "<i4") for r in rows]])
    counts = np.concatenate([np.zeros(0, "<i8"), *[np.frombuffer(r["n"], "<i8") for r in rows]])
    distinct, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(distinct))
    top = np.argsort(-total, kind="stable")[:size]
    table = HashTable(max(2 * len(top), 2))
    table.put(distinct[top], lengths[at[top]])
    return table


def _counts(texts: list[bytes], frequent: HashTable, path: str) -> np.ndarray:
    found = W.split(texts, lower=False)
    lengths = _lengths(found, path, frequent)
    return np.diff(np.concatenate([[0], np.cumsum(lengths)])[found.first])


def token_count(text: Column, tokenizer_path: Callable[[], str], frequent: Broadcast) -> Column:
    """The number of tokens of each text."""

    @F.arrow_udf("long")
    def count(column: pa.Array) -> pa.Array:
        texts, path = W.as_bytes(column), tokenizer_path()
        parts = [_counts(texts[a:b], frequent.value, path) for a, b in W.slices([len(t) for t in texts], _SLICE)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64())

    return count(text)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: Callable[[], str],
    limit: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = FREQUENT_WORDS,
    slices: int = 16,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``tokenizer_path`` is called in the tasks, as the file lies on each machine.
    """
    table = frequent_lengths(docs, tokenizer_path, text, size, slices)
    frequent = docs.sparkSession.sparkContext.broadcast(table)
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        token_count(whole, tokenizer_path, frequent).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
