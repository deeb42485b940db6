"""Benchmark decontamination with an FM-index per shard of the training texts.

The words of a run of texts become one-byte fingerprints, with a mark after each text;
their FM-index is searched backwards for every benchmark phrase at once, occurrences are
located by sampled suffix positions and then checked against the full word hashes, and
overlapping or adjoining ones are merged into spans to remove.

A phrase is any ten consecutive words of an item; an item of fewer words is one phrase.
Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.

A shard is as large as fits a task, whatever the corpus; texts are never cut. Benchmark
phrases are the query set: they are sent to tasks in blocks of bounded size, and every
block is searched in every shard. The driver makes one block after the other and a worker
holds one at a time; the rest lie in Spark's broadcast files. Ids of items may be of any
type. Defined cases: null and word-less texts have no hit; an
item without id marks words but is in no list; items that share a phrase are all listed;
an empty benchmark hits nothing; repeated rows give repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm import words as W
from fleetlens.llm.fm_index import FmIndex
from fleetlens.session import materialize

PHRASE_WORDS = 10
#: Bytes of text in a shard, phrases in a block, occurrences handled at once.
SHARD_BYTES = 4 << 20
BLOCK_PHRASES = 50_000
_AT_ONCE = 1 << 19

_NOT_WORD = np.ones(256, dtype=bool)
_NOT_WORD[0x30:0x3A] = _NOT_WORD[0x61:0x7B] = _NOT_WORD[0x80:] = False


def _found_type(item: str) -> str:
    return f"struct<n_words: long, n_hit: long, items: array<{item}>, spans: array<struct<start: long, end: long>>>"


def _found_arrow(item: str) -> pa.DataType:
    return pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("items", pa.list_(pa.string() if item == "string" else pa.int64())),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )


def item_type(benchmark: DataFrame, item: str = "item_id") -> str:
    """Whole numbers stay numbers; ids of any other type are texts."""
    return "long" if isinstance(benchmark.schema[item].dataType, T.IntegralType) else "string"


@dataclass
class PhraseBlock:
    """Phrases of one length: their word hashes (a line each) and the items that hold them."""

    hashes: np.ndarray
    items: np.ndarray
    first_item: np.ndarray


def _symbols(hashes: np.ndarray) -> np.ndarray:
    """One byte per word; 0 and 1 are taken by the ends of the shard and of each text."""
    return (hashes % np.uint64(254) + np.uint64(2)).astype(np.uint8)


def phrase_blocks(
    benchmark: DataFrame, item: str = "item_id", text: str = "text"
) -> Iterator[list[PhraseBlock]]:
    """The phrases of the benchmark, one block after the other, each of ``BLOCK_PHRASES`` on average."""
    kind = item_type(benchmark, item)

    @F.arrow_udf("array<binary>")
    def phrases_of(column: pa.Array) -> pa.Array:
        out = []
        for one in W.as_bytes(column):
            hashes = W.split([one], _NOT_WORD).hashes
            size = min(PHRASE_WORDS, len(hashes))
            out.append([hashes[i : i + size].tobytes() for i in range(len(hashes) - size + 1)] if size else [])
        return pa.array(out, pa.list_(pa.binary()))

    found = benchmark.select(
        F.col(item).cast(kind).alias("item"), F.explode(phrases_of(F.col(text))).alias("phrase")
    )
    phrases = materialize(
        found.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items")), "phrases"
    )
    n_blocks = math.ceil(phrases.count() / BLOCK_PHRASES)
    for b in range(n_blocks):
        rows = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(n_blocks)) == b).collect()
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r["phrase"]) // 8, []).append(r)
        block = []
        for size, group in sorted(by_size.items()):
            lists = [r["items"] for r in group]
            block.append(
                PhraseBlock(
                    np.frombuffer(b"".join(r["phrase"] for r in group), np.uint64).reshape(-1, size),
                    np.array([i for items in lists for i in items], dtype=np.int64 if kind == "long" else object),
                    np.concatenate([[0], np.cumsum([len(items) for items in lists])]),
                )
            )
        yield block


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [first, last), and which range each is of."""
    sizes = last - first
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner], owner


def _occurrences(index: FmIndex, block: PhraseBlock, word_at: np.ndarray, hashes: np.ndarray):
    """Verified occurrences: phrase and first word, in bounded portions."""
    size = block.hashes.shape[1]
    low, high = index.search(_symbols(block.hashes))
    hit = np.flatnonzero(high > low)
    for a, b in W.slices((high - low)[hit].tolist(), _AT_ONCE):
        rows, owner = _expand(low[hit[a:b]], high[hit[a:b]])
        phrase, word = hit[a:b][owner], word_at[index.locate(rows)]
        same = np.ones(len(word), dtype=bool)
        for j in range(size):
            same &= hashes[word + j] == block.hashes[phrase, j]
        yield phrase[same], word[same]


def _search_shard(texts: list[bytes], blocks) -> list[dict]:
    found = W.split(texts, _NOT_WORD)
    n, place = len(found.hashes), np.arange(len(found.hashes)) + found.doc
    step, pairs = np.zeros(n + 1, dtype=np.int64), set()
    if n:
        symbols = np.ones(n + len(texts) + 1, dtype=np.uint8)
        symbols[place], symbols[-1] = _symbols(found.hashes), 0
        word_at = np.zeros(len(symbols), dtype=np.int64)
        word_at[place] = np.arange(n)
        index = FmIndex(symbols)
        for block in blocks():
            for phrases in block:
                for phrase, word in _occurrences(index, phrases, word_at, found.hashes):
                    step += np.bincount(word, minlength=n + 1)
                    step -= np.bincount(word + phrases.hashes.shape[1], minlength=n + 1)
                    once = np.unique(np.stack([found.doc[word], phrase], axis=1), axis=0)
                    at, owner = _expand(phrases.first_item[once[:, 1]], phrases.first_item[once[:, 1] + 1])
                    pairs.update(zip(once[owner, 0].tolist(), phrases.items[at].tolist(), strict=True))
    covered = np.cumsum(step)[:n] > 0
    n_hit = np.bincount(found.doc[covered], minlength=len(texts))
    fresh = np.diff(found.doc, prepend=-1) != 0
    begins = np.flatnonzero(covered & (fresh | ~np.concatenate([[False], covered])[:n]))
    final = np.concatenate([fresh[1:], [True]])[:n]
    ends = np.flatnonzero(covered & (final | ~np.concatenate([covered[1:], [False]])[:n]))
    # Code points before a byte, within its text.
    points = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
    owner = found.doc[begins]
    starts = points[found.start[begins]] - points[found.offsets[owner]]
    stops = points[found.end[ends]] - points[found.offsets[owner]]
    out = [
        {"n_words": int(w), "n_hit": int(h), "items": [], "spans": []}
        for w, h in zip(np.diff(found.first), n_hit, strict=True)
    ]
    for doc, a, b in zip(owner.tolist(), starts.tolist(), stops.tolist(), strict=True):
        out[doc]["spans"].append({"start": a, "end": b})
    for doc, item in sorted(pairs):
        out[doc]["items"].append(item)
    return out


def _searcher(benchmark: DataFrame):
    """A function from an Arrow column of texts to (text, what was found in it), shard by shard."""
    context = benchmark.sparkSession.sparkContext
    sent = [context.broadcast(block) for block in phrase_blocks(benchmark)]

    def blocks():
        for block in sent:
            yield block.value
            if len(sent) > 1:
                vars(block).pop("_value", None)  # a worker holds one block at a time

    def search(column: pa.Array):
        texts = W.as_bytes(column)
        for a, b in W.slices([len(t) for t in texts], SHARD_BYTES):
            yield from zip(texts[a:b], _search_shard(texts[a:b], blocks), strict=True)

    return search


def find_leaks(text: Column, benchmark: DataFrame) -> Column:
    """A struct per text: ``n_words``, ``n_hit``, ``items`` (ascending) and ``spans`` (code points)."""
    search = _searcher(benchmark)

    kind = item_type(benchmark)
    arrow = _found_arrow(kind)

    @F.arrow_udf(_found_type(kind))
    def find(column: pa.Array) -> pa.Array:
        return pa.array([found for _, found in search(column)], arrow)

    return find(text)


def cut_spans(text: str, spans: list[dict]) -> str:
    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def without_leaks(text: Column, benchmark: DataFrame) -> Column:
    """The text without the spans of benchmark phrases. One function finds and cuts, so a task
    needs one Python worker."""
    search = _searcher(benchmark)

    @F.arrow_udf("string")
    def cut(column: pa.Array) -> pa.Array:
        out = [
            cut_spans(raw.decode(), found["spans"]) if found["spans"] else raw.decode()
            for raw, found in search(column)
        ]
        return pa.array(out, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))

    return cut(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of benchmark phrases cut out of the text."""
    return docs.withColumn(text, without_leaks(F.col(text), benchmark))
