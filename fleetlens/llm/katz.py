"""Katz backoff language model over words, trained and applied by Spark.

Bigram counts are discounted by Good-Turing; what is taken off is given, through a
backoff weight per history that makes its probabilities sum to exactly one, to the words
not seen after it, in proportion to their unigram probabilities, which are discounted the
same way. All unseen words together are one event. A probability is looked up per token,
recursively: the bigram if it is known, else the weight of the history times the unigram.

Texts are encoded once, in blocks: the distinct words of a block, and its texts as
numbers of these. Blocks are a table bucketed by block. Per-block distinct words, then
word pairs, go to the partition of their hash; the counts over the whole corpus come back
to the blocks that asked, as packed arrays. So every n-gram of the corpus is counted, a
word that stands in every text is sent once per block, and texts never move. The pairs of
the at most ``HOT`` most frequent histories are dealt by both words.

Defined cases: a null text is empty, and an empty one is its end alone; rows without id
are not learned from by the query; repeated rows count as often as they occur; without
any training text every word is unseen and every score 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import words as W
from fleetlens.session import materialize, shared_dir

#: Bytes of text in a block; entries in a counting partition; a history is hot that makes up a HOT-th of all tokens.
BLOCK_BYTES = 4 << 20
PART_ENTRIES = 1 << 19
HOT = 20_000
#: Counts up to this are discounted.
CUT = 5

_END = W.mix(np.array([0x656E64], dtype=np.uint64))[0]


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers or doubles as compressed byte planes."""
    parts = [struct.pack("<I", len(arrays))]
    for x in arrays:
        x = x.view(np.uint64) if x.dtype.kind == "f" else x.astype(np.uint64)
        parts += [struct.pack("<I", len(x)), x.view(np.uint8).reshape(-1, 8).T.tobytes()]
    return zstandard.compress(b"".join(parts), 3)


def expand(packed: bytes) -> list[np.ndarray]:
    raw, at = zstandard.decompress(packed), 4
    out = []
    for _ in range(struct.unpack_from("<I", raw)[0]):
        (n,) = struct.unpack_from("<I", raw, at)
        planes = np.frombuffer(raw, np.uint8, 8 * n, at + 4).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64))
        at += 4 + 8 * n
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """A sorted array as differences, which squeeze better; ``np.cumsum`` undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


@dataclass(frozen=True)
class Discounts:
    """Good-Turing factors: ``factor[r]`` for a count of r, 1 beyond ``CUT``."""

    factor: np.ndarray

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.factor[np.minimum(counts, CUT + 1)] * counts


def good_turing(n: list[int]) -> Discounts:
    """From ``n[r]``, how many n-grams have a count of r (up to ``CUT + 1``).

    Where the counts are too few for Katz's formula, the next smaller cut is tried; a cut of
    zero takes the share of the once-seen (at least a half of one) off all counts alike.
    """
    for cut in range(CUT, 0, -1):
        if n[1] == 0 or any(n[r] == 0 for r in range(1, cut + 1)):
            continue
        common = (cut + 1) * n[cut + 1] / n[1]
        if common >= 1:
            continue
        factor = np.ones(CUT + 2)
        for r in range(1, cut + 1):
            factor[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        if all(0 < factor[r] < 1 for r in range(1, cut + 1)):
            return Discounts(factor)
    seen = sum(n[1:]) or 1
    return Discounts(np.full(CUT + 2, 1 - max(n[1], 0.5) / (seen + 1)))


@dataclass(frozen=True)
class Unigrams:
    """Totals over the training tokens and the discounted distribution."""

    tokens: int
    types: int
    discounts: Discounts
    unseen: float

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words by their count; the event of an unseen word at 0."""
        seen = self.discounts(counts) / max(self.tokens, 1)
        return np.where(counts > 0, seen, self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-half estimate."""
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def is_hot(self, counts: np.ndarray) -> np.ndarray:
        return counts * HOT >= max(self.tokens, 1)


def unigram_model(tokens: int, types: int, n: list[int]) -> Unigrams:
    discounts = good_turing(n)
    few = sum(r * n[r] * (1 - discounts.factor[r]) for r in range(1, CUT + 1))
    many = (tokens - sum(r * n[r] for r in range(1, CUT + 1))) * (1 - discounts.factor[CUT + 1])
    return Unigrams(tokens, types, discounts, (few + many) / tokens if tokens else 1.0)


def _by_part(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each part that occurs, the positions that are its own, in order."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    numbers, begins = np.unique(part[order], return_index=True)
    return list(zip(numbers.tolist(), np.split(order, begins[1:]), strict=True))


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (W.mix(hashes) % np.uint64(parts)).astype(np.int64)


# --- blocks -------------------------------------------------------------------------

_BLOCK = (
    "block long, doc_ids array<long>, learned array<boolean>, sizes array<long>, n_tokens long, "
    "n_words long, vocabulary binary, counts binary, stream binary"
)
_BLOCK_ARROW = pa.schema(
    [
        ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("learned", pa.list_(pa.bool_())),
        ("sizes", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("n_words", pa.int64()),
        ("vocabulary", pa.binary()), ("counts", pa.binary()), ("stream", pa.binary()),
    ]
)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, learned = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = W.as_bytes(batch.column(2))
        for a, b in W.slices([len(t) for t in texts], BLOCK_BYTES):
            found = W.split(texts[a:b])
            sizes = np.diff(found.first) + 1
            tokens = np.full(len(found.hashes) + b - a, _END, dtype=np.uint64)
            tokens[np.arange(len(found.hashes)) + found.doc] = found.hashes
            vocabulary, stream = np.unique(tokens, return_inverse=True)
            in_training = np.repeat(np.array(learned[a:b], dtype=bool), sizes)
            counts = np.bincount(stream[in_training], minlength=len(vocabulary))
            row = {
                "block": number, "doc_ids": ids[a:b], "learned": learned[a:b], "sizes": sizes.tolist(),
                "n_tokens": len(tokens), "n_words": len(vocabulary),
                "vocabulary": squeeze(_steps(vocabulary)), "counts": squeeze(counts), "stream": squeeze(stream),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)
            number += 1


def block_table(docs: DataFrame, doc_id: str, text: str, learn) -> DataFrame:
    """The encoded texts, one row per block, in a table bucketed by block."""
    spark = docs.sparkSession
    name = f"ngram_blocks_{uuid.uuid4().hex}"
    (
        docs.select(F.col(doc_id).cast("long"), F.coalesce(learn, F.lit(False)), F.col(text))
        .mapInArrow(_encode, _BLOCK)
        .write.option("path", f"{shared_dir(spark)}/fleetlens/{name}")
        .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
        .saveAsTable(name)
    )
    return spark.table(name)


@dataclass
class Block:
    """A block's tokens: ``history`` and ``word`` are places in the vocabulary; the place after
    its last one is the start of a text. ``shared`` words stand in other blocks too."""

    row: dict
    doc: np.ndarray
    learned: np.ndarray
    history: np.ndarray
    word: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    shared: np.ndarray


# --- words --------------------------------------------------------------------------

_ASKED = "part int, block long, payload binary, stats array<long>"
_ASKED_ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("stats", pa.list_(pa.int64()))]
)
_HOT = "struct<id: long, n: array<long>, mass: double>"
_TOLD = f"block long, part int, payload binary, stats array<long>, hot array<{_HOT}>"
_TOLD_ARROW = pa.schema(
    [
        ("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary()), ("stats", pa.list_(pa.int64())),
        ("hot", pa.list_(pa.struct([("id", pa.int64()), ("n", pa.list_(pa.int64())), ("mass", pa.float64())]))),
    ]
)


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes = np.cumsum(expand(row["vocabulary"])[0], dtype=np.uint64)
                counts = expand(row["counts"])[0]
                rows = [
                    {"part": p, "block": row["block"], "payload": squeeze(_steps(hashes[own]), counts[own])}
                    for p, own in _by_part(_part(hashes, parts))
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_ASKED_ARROW)

    return run


def _count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)[: CUT + 2]


def _tell_words(parts: int):
    def run(table: pa.Table) -> pa.Table:
        asked = [expand(x) for x in table.column("payload").to_pylist()]
        part = table.column("part")[0].as_py()
        flat = np.concatenate([np.cumsum(h, dtype=np.uint64) for h, _ in asked])
        words, which = np.unique(flat, return_inverse=True)
        counts = np.bincount(which, np.concatenate([c for _, c in asked]), len(words)).astype(np.int64)
        blocks = np.bincount(which, minlength=len(words))
        # Frequent words get small numbers, which squeeze well; a word without count gets 0.
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        ids = np.where(counts > 0, rank * parts + part + 1, 0)
        out, at = [], 0
        for block, (own, _) in zip(table.column("block").to_pylist(), asked, strict=True):
            here = which[at : at + len(own)]
            out.append({"block": block, "part": part, "payload": squeeze(counts[here], ids[here], blocks[here] > 1)})
            at += len(own)
        out[0]["stats"] = [int(counts.sum()), int((counts > 0).sum()), *_count_of_counts(counts)[1:].tolist()]
        return pa.Table.from_pylist(out, schema=_TOLD_ARROW)

    return run


def _open(row: dict, told: list[dict], parts: int) -> Block:
    """The block with the corpus counts and ids of its words."""
    hashes = np.cumsum(expand(row["vocabulary"])[0], dtype=np.uint64)
    counts, ids, shared = (np.zeros(len(hashes) + 1, dtype=np.int64) for _ in range(3))
    shared[-1] = 1
    own = dict(_by_part(_part(hashes, parts)))
    for answer in told:
        places = own[answer["part"]]
        counts[places], ids[places], shared[places] = expand(answer["payload"])
    sizes = np.array(row["sizes"], dtype=np.int64)
    word = expand(row["stream"])[0].astype(np.int64)
    history = np.concatenate([[0], word[:-1]])
    history[np.cumsum(sizes) - sizes] = len(hashes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return Block(row, doc, np.array(row["learned"], dtype=bool), history, word, counts, ids, shared > 0)


# --- pairs --------------------------------------------------------------------------

#: The id of the start of a text as a history. No word has it.
_START = 1 << 62


@dataclass
class Pairs:
    """A block's distinct pairs. ``which`` gives each token its pair. ``asked`` are the pairs whose
    counts other blocks share, sorted by ``part``, history id and word id."""

    history: np.ndarray
    word: np.ndarray
    which: np.ndarray
    counts: np.ndarray
    asked: np.ndarray
    part: np.ndarray
    histories: np.ndarray
    history_part: np.ndarray


def _pairs(block: Block, model: Unigrams, starts: int, parts: int) -> Pairs:
    start = len(block.ids) - 1
    block.counts[start], block.ids[start] = starts, _START
    distinct, which = np.unique(block.history * len(block.ids) + block.word, return_inverse=True)
    history, word = distinct // len(block.ids), distinct % len(block.ids)
    learned = block.learned[block.doc]
    counts = np.bincount(which[learned], minlength=len(distinct))
    # A history that stands in no other block needs no other block's counts.
    shared = block.shared & (block.counts > 0)
    hot = model.is_hot(block.counts)
    hot[start] = True
    salt = np.where(hot[history], block.ids[word], 0).astype(np.uint64)
    part = _part(block.ids[history].astype(np.uint64) ^ W.mix(salt), parts)
    asked = np.flatnonzero(shared[history] & (block.ids[word] > 0))
    asked = asked[np.lexsort((block.ids[word[asked]], block.ids[history[asked]], part[asked]))]
    histories = np.unique(history[shared[history] & ~hot[history]])
    histories = histories[np.argsort(block.ids[histories])]
    own = _part(block.ids[histories].astype(np.uint64) ^ W.mix(np.zeros(1, np.uint64)), parts)
    return Pairs(history, word, which, counts, asked, part, histories, own)


def _ask_pairs(model: Unigrams, starts: int, word_parts: int, parts: int):
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.Table.from_pylist([], schema=_ASKED_ARROW)
        row = block.to_pylist()[0]
        opened = _open(row, told.to_pylist(), word_parts)
        pairs = _pairs(opened, model, starts, parts)
        asking = dict(_by_part(pairs.part[pairs.asked]))
        lists = dict(_by_part(pairs.history_part))
        rows = []
        for p in sorted(asking.keys() | lists.keys()):
            own = pairs.asked[asking.get(p, np.zeros(0, np.int64))]
            word = pairs.word[own]
            history, at = np.unique(opened.ids[pairs.history[own]], return_inverse=True)
            payload = squeeze(
                _steps(history), np.bincount(at, minlength=len(history)), opened.ids[word],
                opened.counts[word], pairs.counts[own],
                _steps(opened.ids[pairs.histories[lists.get(p, np.zeros(0, np.int64))]]),
            )
            rows.append({"part": p, "block": row["block"], "payload": payload, "stats": None})
        alone = ~opened.shared[pairs.history] & (pairs.counts > 0)
        rows = rows or [{"part": 0, "block": row["block"], "payload": None, "stats": None}]
        rows[0]["stats"] = _count_of_counts(pairs.counts[alone])[1:].tolist()
        return pa.Table.from_pylist(rows, schema=_ASKED_ARROW)

    return run


def _history_sums(history: np.ndarray, size: int, counts: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per history (its place) the number of followers seen 1 .. CUT times, the tokens of the others (a line
    of CUT + 1), and the unigram mass of all followers."""
    sums = np.zeros((size, CUT + 1), dtype=np.int64)
    for r in range(1, CUT + 1):
        sums[:, r - 1] = np.bincount(history[counts == r], minlength=size)
    many = counts > CUT
    sums[:, CUT] = np.bincount(history[many], counts[many], size).astype(np.int64)
    seen = counts > 0
    # Without any follower the sums of bincount would be whole numbers.
    return sums, np.bincount(history[seen], mass[seen], size).astype(np.float64)


def _tell_pairs(model: Unigrams):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        stats = np.zeros(CUT + 1, dtype=np.int64)
        asked = []
        for row in table.to_pylist():
            if row["stats"] is not None:
                stats += np.array(row["stats"])
            if row["payload"] is not None:
                asked.append((row["block"], [x.astype(np.int64) for x in expand(row["payload"])]))
        if not asked:
            empty = {"block": -1, "part": part, "payload": None, "stats": stats.tolist()}
            return pa.Table.from_pylist([empty], schema=_TOLD_ARROW)
        history = np.concatenate([np.repeat(np.cumsum(x[0]), x[1]) for _, x in asked])
        word, of_word, own = (np.concatenate([x[i] for _, x in asked]) for i in (2, 3, 4))
        order = np.lexsort((word, history))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (np.diff(history[order]) != 0) | (np.diff(word[order]) != 0)
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        counts = np.bincount(which, own, len(first)).astype(np.int64)
        stats += _count_of_counts(counts)[1:]
        names, place = np.unique(history[first], return_inverse=True)
        sums, mass = _history_sums(place, len(names), counts, model.probability(of_word[first]))
        listed = np.unique(np.concatenate([np.cumsum(x[5]) for _, x in asked]))
        out, at = [], 0
        for block, x in asked:
            told = counts[which[at : at + len(x[2])]]
            at += len(x[2])
            ids = np.cumsum(x[5])
            near = np.minimum(np.searchsorted(names, ids), max(len(names) - 1, 0))
            known = names[near] == ids if len(names) else np.zeros(len(ids), dtype=bool)
            lines = np.where(known[:, None], sums[near], 0) if len(names) else np.zeros((len(ids), CUT + 1), np.int64)
            weight = np.where(known, mass[near], 0.0) if len(names) else np.zeros(len(ids))
            payload = squeeze(told, *lines.T, weight)
            out.append({"block": block, "part": part, "payload": payload})
        hot = np.flatnonzero(~np.isin(names, listed))
        out[0]["stats"] = stats.tolist()
        out[0]["hot"] = [
            {"id": int(names[h]), "n": sums[h].tolist(), "mass": float(mass[h])} for h in hot
        ]
        return pa.Table.from_pylist(out, schema=_TOLD_ARROW)

    return run


# --- scores -------------------------------------------------------------------------

_SCORED = (
    "doc_id long, n_tokens long, n_known long, base_score double, score double"
)
_SCORED_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("base_score", pa.float64()), ("score", pa.float64()),
    ]
)


def backoff(sums: np.ndarray, mass: np.ndarray, total: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """Per history its denominator and its backoff weight.

    A history that keeps nothing for unseen followers gets one more in its denominator.
    """
    kept = sums[:, :CUT] @ (discounts.factor[1 : CUT + 1] * np.arange(1, CUT + 1))
    kept = kept + sums[:, CUT] * discounts.factor[CUT + 1]
    full = kept >= total * (1 - 1e-12)
    total = np.maximum(total + full, 1)
    return total, (1 - kept / total) / np.maximum(1 - mass, 1e-300)


def _score(model: Unigrams, starts: int, word_parts: int, parts: int, discounts: Discounts, hot: dict):
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.Table.from_pylist([], schema=_SCORED_ARROW)
        row, answers = block.to_pylist()[0], told.to_pylist()
        opened = _open(row, [a for a in answers if a["order"] == 1], word_parts)
        pairs = _pairs(opened, model, starts, parts)
        size = len(opened.ids)
        probability = model.probability(opened.counts)
        # Of histories that are only here, the counts are all here.
        counts = np.where(opened.shared[pairs.history], 0, pairs.counts)
        sums, mass = _history_sums(pairs.history, size, counts, probability[pairs.word])
        asking, lists = dict(_by_part(pairs.part[pairs.asked])), dict(_by_part(pairs.history_part))
        for answer in answers:
            if answer["order"] == 2 and answer["payload"] is not None:
                x = expand(answer["payload"])
                none, p = np.zeros(0, np.int64), answer["part"]
                counts[pairs.asked[asking.get(p, none)]] = x[0]
                places = pairs.histories[lists.get(p, none)]
                sums[places] = np.stack(x[1:-1], axis=1).astype(np.int64)
                mass[places] = x[-1].view(np.float64)
        hot_here = model.is_hot(opened.counts)
        hot_here[-1] = True
        for place in np.flatnonzero(hot_here):
            if (known := hot.get(int(opened.ids[place]))) is not None:
                sums[place], mass[place] = known
        total, weight = backoff(sums, mass, opened.counts, discounts)
        seen = counts > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(
                seen,
                discounts(counts) / total[pairs.history],
                np.where(opened.counts[pairs.history] > 0, weight[pairs.history], 1.0) * probability[pairs.word],
            )
        n = len(row["doc_ids"])
        known = opened.counts[opened.word] > 0
        base = model.base(opened.counts)
        return pa.table(
            [
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(row["sizes"], pa.int64()),
                pa.array(np.bincount(opened.doc[known], minlength=n)),
                pa.array(np.bincount(opened.doc, base[opened.word], n)),
                pa.array(np.bincount(opened.doc, np.log10(value)[pairs.which], n)),
            ],
            schema=_SCORED_ARROW,
        )

    return run


def _summed(told: DataFrame) -> list[int]:
    """The stats of all partitions, added up: one row."""
    size = CUT + 3
    row = told.filter("stats IS NOT NULL").agg(
        *[F.coalesce(F.sum(F.try_element_at("stats", F.lit(i + 1))), F.lit(0)) for i in range(size)]
    ).first()
    return [int(x) for x in row]


def score_texts(docs: DataFrame, learn, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows where ``learn`` holds and score all: ``doc_id``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (add-half unigrams), ``score`` (log10)."""
    blocks = block_table(docs, doc_id, text, learn)
    facts = blocks.agg(
        F.sum("n_words"),
        F.sum("n_tokens"),
        F.sum(F.size(F.filter("learned", lambda x: x))),
    ).first()
    n_words, n_tokens, starts = (int(x or 0) for x in facts)
    word_parts = math.ceil(max(n_words, 1) / PART_ENTRIES)
    parts = math.ceil(max(n_tokens, 1) / PART_ENTRIES)

    asked = blocks.select("block", "vocabulary", "counts").mapInArrow(_ask_words(word_parts), _ASKED)
    words = materialize(asked.groupBy("part").applyInArrow(_tell_words(word_parts), _TOLD), "words")
    tokens, types, *n = _summed(words)
    model = unigram_model(tokens, types, [0, *n[: CUT + 1]])

    told = words.select("block", "part", "payload")
    asked = (
        blocks.groupBy("block")
        .cogroup(told.groupBy("block"))
        .applyInArrow(_ask_pairs(model, starts, word_parts, parts), _ASKED)
    )
    pairs = materialize(asked.groupBy("part").applyInArrow(_tell_pairs(model), _TOLD), "pairs")
    discounts = good_turing([0, *_summed(pairs)[: CUT + 1]])
    # Hot histories are at most HOT, and the start.
    hot_rows = (
        pairs.select(F.explode("hot").alias("h"))
        .groupBy("h.id")
        .agg(*[F.sum(F.col("h.n")[i]).alias(f"n{i}") for i in range(CUT + 1)], F.sum("h.mass").alias("mass"))
        .collect()
    )
    hot = {r["id"]: (np.array(r[1 : CUT + 2], dtype=np.int64), r["mass"]) for r in hot_rows}

    both = told.withColumn("order", F.lit(1)).unionByName(
        pairs.select("block", "part", "payload", F.lit(2).alias("order"))
    )
    scored = (
        blocks.groupBy("block")
        .cogroup(both.groupBy("block"))
        .applyInArrow(_score(model, starts, word_parts, parts, discounts, hot), _SCORED)
    )
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
