"""Phrases whose words stand together, mined with stripes.

A stripe is a prefix and a counter of the words that come next. Tasks build stripes for
the prefixes in their texts, stripes of one prefix are merged element by element, and the
merged stripe says all at once which phrases extend its prefix, how often the prefix
occurs (its total; a place where nothing countable follows counts under ``OTHER``), and how
frequent its best frequent extension is (what may subsume it). The stripe of the empty prefix, one
per language, has the words themselves. Stripes of longer prefixes follow one length at a
time, since a frequent phrase has frequent parts only: a prefix is counted if it is
frequent, with a next word if the words behind its first are frequent, too.

What is frequent is asked of a Bloom filter of bounded size, sent to all tasks. It lets
through a little too much, and the more the larger the corpus; that costs shuffle, and no
result, as counts are exact and the final level decides. A stripe whose prefix is very
frequent is dealt out in fragments by the hash of the next word, so that no stripe is
larger than ``fragment`` occurrences, whatever its prefix's share; which ones are, is a
table of 65,536 bytes.

Words are identified by 64-bit hashes, phrases by the hashes of their words.

Defined cases: a null text has no words; a null language is ``und``; repeated rows count as
often as they occur; an empty table gives an empty result; other columns are not read; a
text of any length is read whole (it is the unit of memory, besides slices of 4 MB).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import words as W
from fleetlens.session import materialize

_PIECE = np.isin(np.arange(256), [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])
_SEPARATOR = _PIECE | np.isin(np.arange(256), [0x20, 0x09])
_NOTHING = np.zeros(256, dtype=bool)
_U = np.uint64
_ODD = _U(0x9FB21C651E98DF25)

#: Counts what ends a piece, or has a next word too rare to matter.
OTHER = 0
_SLICE = 1 << 22
#: Entries of stripes a task holds before it hands them on.
_HELD = 1 << 19
_WORD_BITS = 10
_SLOT_BITS = 16
_PROBES = 3
_FILTER_RANGES = 64


def _extend(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its prefix and its last word."""
    with np.errstate(over="ignore"):
        return W.mix(prefix * _ODD + word)


@dataclass
class _Tokens:
    """Word hashes, different in each language; the piece each word is in; the words themselves."""

    ids: np.ndarray
    piece: np.ndarray
    words: W.Words
    langs: list[str]
    lang: np.ndarray


def _tokens(texts: list[bytes], langs: list[str]) -> _Tokens:
    words = W.split(texts, _SEPARATOR)
    border = _PIECE[words.data]
    border[words.offsets[1:] - 1] = True
    known = sorted(set(langs))
    number = {x: i for i, x in enumerate(known)}
    seeds = W.mix(W.split([b"l" + x.encode() for x in known], _NOTHING, lower=False).hashes)
    lang = np.array([number[x] for x in langs], dtype=np.int64)[words.doc] if known else words.doc
    ids = W.mix(words.hashes ^ seeds[lang]) if known else words.hashes
    return _Tokens(ids, np.cumsum(border)[words.start], words, known, lang)


def _texts(batch: pa.RecordBatch) -> Iterator[_Tokens]:
    langs, texts = batch.column(0).to_pylist(), W.as_bytes(batch.column(1))
    for a, b in W.slices([len(t) for t in texts], _SLICE):
        yield _tokens(texts[a:b], langs[a:b])


def _binaries(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """Row i holds ``data[first[i]:first[i + 1]]``."""
    offsets = (first * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary rows in a row, and how many each has."""
    rows = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, kind), *rows]), np.fromiter(map(len, rows), np.int64, len(rows))


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of ``keys`` (the last one is the main order) and the sums of their counts."""
    if not len(counts):
        return keys, counts
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(counts), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts[order], at)


# Words: the stripe of the empty prefix.


def _word_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in _texts(batch):
            ids, at, counts = np.unique(t.ids, return_index=True, return_counts=True)
            if not len(ids):
                continue
            lang, part = t.lang[at], (ids >> _U(64 - _WORD_BITS)).astype(np.int64)
            order = np.lexsort([part, lang])
            ids, at, counts, lang, part = (x[order] for x in (ids, at, counts, lang, part))
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (lang[1:] != lang[:-1]) | (part[1:] != part[:-1])
            begin = np.flatnonzero(new)
            first = np.append(begin, len(ids))
            raw = t.words.data.tobytes()
            spans = list(zip(t.words.start[at].tolist(), t.words.end[at].tolist(), strict=True))
            texts = [b" ".join([raw[x:y] for x, y in spans[a:b]]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t.langs[i] for i in lang[begin].tolist()], pa.string()),
                    pa.array(part[begin], pa.int32()),
                    _binaries(ids, first),
                    _binaries(counts.astype("<i8"), first),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["lang", "part", "ids", "counts", "words"],
            )


def _merge_words(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by language and part: each part's total and its frequent words."""

    def merged(key, ids, counts, names):
        (ids, at), counts = _summed([ids, np.zeros(len(ids), np.int64)], counts)[0], _summed([ids], counts)[1]
        often = counts >= least
        return key[0], int(counts.sum()), ids[often], counts[often], [names[i] for i in ids[often].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out, (lang, part) = [], (batch.column(i).to_pylist() for i in range(2))
            rows = zip(lang, part, *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            for lang_, part_, ids, counts, words in rows:
                ids, counts = np.frombuffer(ids, "<u8"), np.frombuffer(counts, "<i8")
                fresh = zip(ids.tolist(), words.split(" "), strict=True)
                if held and held[0] == (lang_, part_):
                    held[1].append(ids)
                    held[2].append(counts)
                    held[3].update(fresh)
                    if sum(map(len, held[1])) > 4 * len(held[3]) + _HELD:
                        (ids,), counts = _summed([np.concatenate(held[1])], np.concatenate(held[2]))
                        held = (held[0], [ids], [counts], held[3])
                else:
                    if held:
                        out.append(merged(held[0], np.concatenate(held[1]), np.concatenate(held[2]), held[3]))
                    held = ((lang_, part_), [ids], [counts], dict(fresh))
            yield from _word_rows(out)
        if held:
            yield from _word_rows([merged(held[0], np.concatenate(held[1]), np.concatenate(held[2]), held[3])])

    return run


_WORD_ROWS = pa.struct([("lang", pa.string()), ("total", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))])


def _word_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        columns = [[lang, total, ids.view(np.int64), counts, names] for lang, total, ids, counts, names in rows]
        arrays = [pa.array([c[i] for c in columns], _WORD_ROWS.field(i).type) for i in range(5)]
        yield pa.RecordBatch.from_arrays(arrays, [f.name for f in _WORD_ROWS])


# What the tasks are told: frequent phrases, and which stripes are dealt out.


class _Known:
    """A Bloom filter of the frequent phrases, and the fragment bits of very frequent ones."""

    def __init__(self, parts: dict[int, bytes], width: int, bits: np.ndarray):
        self._bits = np.frombuffer(b"".join(parts.get(i, bytes(width // 8)) for i in range(_FILTER_RANGES)), np.uint8)
        self._width, self._fragments = width, bits

    @staticmethod
    def places(ids: np.ndarray, width: int) -> Iterator[np.ndarray]:
        """The places of each id's bits inside its range."""
        inner = ids << _U(6)
        for j in range(_PROBES):
            yield (W.mix(inner + _U(j)) % _U(width)).astype(np.int64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(ids), dtype=bool), np.arange(len(ids))
        base = (ids >> _U(58)).astype(np.int64) * self._width
        for j, at in enumerate(self.places(ids, self._width)):
            at = (at + base)[left]
            left = left[(self._bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        out[left] = True
        return out

    def fragment_bits(self, prefix: np.ndarray) -> np.ndarray:
        return self._fragments[(prefix >> _U(64 - _SLOT_BITS)).astype(np.int64)]


def _known(level: DataFrame, most_bytes: int, fragment: int) -> _Known:
    """Built where the phrases lie; the driver gets ``most_bytes`` and 65,536 numbers at most."""
    count = level.count()
    width = min(max(16 * count // _FILTER_RANGES, 512), 8 * most_bytes // _FILTER_RANGES) // 8 * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own = (ids >> _U(58)).astype(np.int64)
            for r in np.unique(own).tolist():
                flags = held.setdefault(r, np.zeros(width, dtype=bool))
                for at in _Known.places(ids[own == r], width):
                    flags[at] = True
        if held:
            bits = [np.packbits(x, bitorder="little").tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(bits, pa.binary())], ["r", "bits"])

    by_range = level.select("id").repartition(_FILTER_RANGES, F.shiftrightunsigned("id", 58))
    parts = {x["r"]: bytes(x["bits"]) for x in by_range.mapInArrow(run, "r int, bits binary").collect()}
    slots = (
        level.filter(F.col("f") > fragment)
        .groupBy(F.shiftrightunsigned("id", 64 - _SLOT_BITS).cast("int").alias("slot"))
        .agg(F.max(F.ceil(F.log2(F.col("f") / fragment))).cast("int").alias("bits"))
    )
    bits = np.zeros(1 << _SLOT_BITS, dtype=np.int64)
    for x in slots.collect():
        bits[x["slot"]] = x["bits"]
    return _Known(parts, width, bits)


# Stripes of longer prefixes.


def _entries(t: _Tokens, size: int, known: _Known) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of ``size`` words that may be frequent, and the next word of each, or ``OTHER``."""
    n = len(t.ids)
    if n < size:
        return t.ids[:0], t.ids[:0]
    phrase = t.ids[: n - size + 1]
    inside = t.piece[: n - size + 1] == t.piece[size - 1 :]
    for j in range(1, size):
        phrase = _extend(phrase, t.ids[j : n - size + 1 + j])
    often = inside.copy()
    often[inside] = known.has(phrase[inside])
    at = np.flatnonzero(often)
    behind = at + size
    follows = np.zeros(len(at), dtype=bool)
    room = behind < n
    follows[room] = (t.piece[behind[room]] == t.piece[at[room]]) & often[at[room] + 1]
    following = np.full(len(at), OTHER, dtype=np.uint64)
    following[follows] = t.ids[behind[follows]]
    return phrase[at], following


_ROW = "bucket int, part int, prefixes binary, sizes binary, following binary, counts binary"


def _bucket(prefix: np.ndarray, bits: int) -> np.ndarray:
    return (prefix >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(prefix), dtype=np.int64)


def _stripe_rows(prefix: np.ndarray, following: np.ndarray, counts: np.ndarray, known: _Known, bits: int) -> pa.RecordBatch:
    """A row per bucket and part: its stripes, by prefix. Part 0 holds whole stripes, the others fragments."""
    split = known.fragment_bits(prefix)
    part = np.where(split > 0, ((following >> _U(1)).astype(np.int64) >> (63 - split)) + 1, 0)
    key = _bucket(prefix, bits) * (int(part.max(initial=0)) + 1) + part
    order = np.argsort(key, kind="stable")
    prefix, following, counts, part, key = (x[order] for x in (prefix, following, counts, part, key))
    row = np.ones(len(key), dtype=bool)
    row[1:] = key[1:] != key[:-1]
    stripe = row.copy()
    stripe[1:] |= prefix[1:] != prefix[:-1]
    begin, at = np.flatnonzero(row), np.flatnonzero(stripe)
    first, of = np.append(begin, len(key)), np.append(np.searchsorted(at, begin), len(at))
    columns = [
        pa.array(_bucket(prefix[begin], bits), pa.int32()),
        pa.array(part[begin], pa.int32()),
        _binaries(prefix[at], of),
        _binaries(np.diff(np.append(at, len(key))).astype("<u4"), of),
        _binaries(following, first),
        _binaries(counts.astype("<u4"), first),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _ROW.split(", ")])


def _stripes(size: int, known, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def handed_on() -> Iterator[pa.RecordBatch]:
            if held:
                following, prefix, counts = (np.concatenate([h[i] for h in held]) for i in range(3))
                held.clear()
                (following, prefix), counts = _summed([following, prefix], counts)
                yield _stripe_rows(prefix, following, counts, known.value, bits)

        for batch in batches:
            for t in _texts(batch):
                prefix, following = _entries(t, size, known.value)
                (following, prefix), counts = _summed([following, prefix], np.ones(len(prefix), np.int64))
                if len(counts):
                    held.append((following, prefix, counts))
                if sum(len(h[0]) for h in held) > _HELD:
                    yield from handed_on()
        yield from handed_on()

    return run


def _merge_stripes(least: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by bucket and part: the merged stripes, of which the frequent extensions are kept."""

    def rows(prefix, part, following, counts) -> pa.RecordBatch:
        new = np.ones(len(prefix), dtype=bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])
        begin = np.flatnonzero(new)
        often = (counts >= least) & (following != OTHER)
        first = np.append(0, np.cumsum(np.add.reduceat(often.astype(np.int32), begin))).astype(np.int32)
        ids = _extend(prefix[often], following[often])
        lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int64) if x is counts else x.view(np.int64))) for x in (ids, following[often])]
        lists.append(pa.ListArray.from_arrays(pa.array(first), pa.array(counts[often])))
        columns = [
            pa.array(prefix[begin].view(np.int64)),
            pa.array(np.add.reduceat(counts, begin)),
            pa.array(np.maximum.reduceat(np.where(often, counts, 0), begin)),
            *lists,
        ]
        return pa.RecordBatch.from_arrays(columns, ["prefix", "total", "best", "ids", "following", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, k) for k in ("<u8", "<i8", "<u8", "<i8")]
        for batch in batches:
            heads, _ = _flat(batch.column(2), "<u8")
            sizes, _ = _flat(batch.column(3), "<u4")
            following, entries = _flat(batch.column(4), "<u8")
            counts, _ = _flat(batch.column(5), "<u4")
            part = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), entries)
            fresh = (np.repeat(heads, sizes), part, following, counts.astype(np.int64))
            prefix, part, following, counts = (np.concatenate([h, x]) for h, x in zip(held, fresh, strict=True))
            if not len(prefix):
                continue
            # The bucket's part that comes last may go on in the next batch.
            last = (_bucket(prefix[-1:], bits)[0], part[-1])
            (following, prefix, part), counts = _summed([following, prefix, part], counts)
            open_ = (_bucket(prefix, bits) == last[0]) & (part == last[1])
            held = [x[open_] for x in (prefix, part, following, counts)]
            if not open_.all():
                yield rows(*(x[~open_] for x in (prefix, part, following, counts)))
        if len(held[0]):
            yield rows(*held)

    return run


# Levels: frequent phrases of one length, with the counts of their parts.


def _longer(stripes: DataFrame, level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``level`` with what its stripes say of it, and the phrases one word longer."""
    owners = stripes.groupBy(F.col("prefix").alias("id")).agg(F.sum("total").alias("total"), F.max("best").alias("best"))
    entries = stripes.select("prefix", F.explode(F.arrays_zip("ids", "following", "counts")).alias("e"))
    heads = level.join(owners, "id", "left")
    prefixes = heads.select(F.col("id").alias("prefix"), "lang", F.col("words").alias("head"), F.col("lefts").alias("head_lefts"), "total")
    suffixes = level.select(F.col("words").alias("tail"), F.col("f").alias("tail_f"), F.col("rights").alias("tail_rights"))
    longer = (
        entries.select("prefix", F.col("e.ids").alias("id"), F.col("e.following").alias("word"), F.col("e.counts").alias("f"))
        .join(prefixes, "prefix")
        .withColumn("words", F.concat("head", F.array("word")))
        .withColumn("tail", F.expr("slice(words, 2, size(words) - 1)"))
        .join(suffixes, "tail")
        .select(
            "id",
            "lang",
            "words",
            "f",
            F.concat("head_lefts", F.array("total")).alias("lefts"),
            F.concat(F.array("tail_f"), "tail_rights").alias("rights"),
        )
    )
    return heads, longer


def _decimal(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _scored(level: DataFrame, size: int) -> DataFrame:
    """The lowest-scoring cut of each phrase; arithmetic in decimals, as products may pass 64 bits."""
    cuts = []
    for k in range(1, size):
        left, right = F.col("lefts")[k - 1], F.col("rights")[k - 1]
        score = F.expr(
            f"cast(2000000 as decimal(7,0)) * cast(f as decimal(20,0)) "
            f"div (cast(lefts[{k - 1}] as decimal(20,0)) + cast(rights[{k - 1}] as decimal(20,0)))"
        )
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    best = F.array_min(F.array(*cuts))
    return level.withColumn("cut", best).select("lang", "words", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", "subsumed")


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    least: int = 30,
    longest: int = 4,
    subsume_percent: int = 80,
    top: int = 2000,
    filter_bytes: int = 1 << 25,
    fragment: int = 1 << 18,
    bucket: int = 1 << 20,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``filter_bytes`` bounds what is broadcast, ``fragment`` the occurrences in one stripe and
    ``bucket`` those in the stripes that move together; no result depends on them.
    """
    spark = docs.sparkSession
    # The top rows of each language are chosen before they meet in one task.
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(limit, str(max(top, int(spark.conf.get(limit, "1000")))))
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL")

    pieces = texts.mapInArrow(_word_stripes, "lang string, part int, ids binary, counts binary, words string")
    stripes = materialize(
        pieces.repartition("lang", "part")
        .sortWithinPartitions("lang", "part")
        .mapInArrow(_merge_words(least), "lang string, total long, ids array<long>, counts array<long>, words array<string>"),
        "word_stripes",
    )
    totals = stripes.groupBy("lang").agg(F.sum("total").alias("n"))
    # Stripes move in buckets of about that many places of the corpus.
    n = stripes.agg(F.sum("total")).first()[0] or 0
    bits = max(n // bucket, 1).bit_length() - 1
    words = stripes.select("lang", F.explode(F.arrays_zip("ids", "counts", "words")).alias("e")).select(
        "lang", F.col("e.ids").alias("id"), F.col("e.counts").alias("f"), F.col("e.words").alias("word")
    )
    empty = F.expr("cast(array() as array<bigint>)")
    level = words.select("id", "lang", F.array("id").alias("words"), "f", empty.alias("lefts"), empty.alias("rights"))
    scored = None
    for size in range(1, longest):
        known = spark.sparkContext.broadcast(_known(level, filter_bytes, fragment))
        stripes = materialize(
            texts.mapInArrow(_stripes(size, known, bits), _ROW)
            .repartition("bucket", "part")
            .sortWithinPartitions("bucket", "part")
            .mapInArrow(
                _merge_stripes(least, bits),
                "prefix long, total long, best long, ids array<long>, following array<long>, counts array<long>",
            ),
            f"stripes{size}",
        )
        heads, longer = _longer(stripes, level)
        longer = materialize(longer, f"phrases{size + 1}")
        if size > 1:
            # A phrase one word longer that holds this one extends it on the right or on the left.
            before = longer.groupBy(F.expr("slice(words, 2, size(words) - 1)").alias("words")).agg(F.max("f").alias("before"))
            subsumed = _decimal(F.greatest("best", "before", F.lit(0))) * 100 >= _decimal(F.col("f")) * subsume_percent
            own = _scored(heads.join(before, "words", "left").withColumn("subsumed", subsumed), size)
            scored = own if scored is None else scored.unionByName(own)
        level = longer
    own = _scored(level.withColumn("subsumed", F.lit(False)), longest)
    scored = own if scored is None else scored.unionByName(own)

    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = materialize(scored.filter("NOT subsumed").withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top), "best_phrases")
    named = (
        first.select("lang", "words", F.posexplode("words").alias("at", "id"))
        .join(words.select("id", "word"), "id")
        .groupBy("lang", "words")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    ranked = first.join(named, ["lang", "words"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    )
    return (
        ranked.filter(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
