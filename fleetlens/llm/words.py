"""Words of many texts at once, as 64-bit hashes, with numpy.

A batch of texts is one byte array. A byte either belongs to a word or separates
words; both word definitions in use here (runs of non-space, runs of letters and
digits) class UTF-8 bytes, so no text is walked in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACES = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + _ODD
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | _U(1)
_P = _U(0xD6E8FEB86659FD93)


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % 2**64
    return x


_P_INV = _U(_inverse(int(_P)))
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(max(n, 1 << 20), _P if kind == "up" else _P_INV, dtype=np.uint64)
        base[0] = 1
        with np.errstate(over="ignore"):
            _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


@dataclass
class Words:
    """``hashes`` of all words in order; ``doc`` the text each is from; byte ``start`` and ``end``
    in ``data``; ``first`` (one more than texts) where each text's words begin; ``offsets`` its bytes."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    inside: np.ndarray


def split(texts: list[bytes], separator: np.ndarray = SPACES, lower: bool = True) -> Words:
    """Split each text at the bytes that ``separator`` marks; equal words get equal hashes."""
    # One separating byte ends each text, so no word crosses a border.
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts)) + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if len(texts) == 0:
        data, offsets = data[:0], offsets[:1]
    if lower:
        data = LOWER[data]
    inside = ~separator[data]
    if len(offsets) > 1:
        inside[offsets[1:] - 1] = False
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = np.zeros(len(start), dtype=np.uint64)
    if len(start):
        with np.errstate(over="ignore"):
            value = _BYTE[data] * _power("up", len(data))
            value[~inside] = 0
            hashes = mix(np.add.reduceat(value, start) * _power("down", len(data))[start])
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, offsets, start, end, hashes, doc, first, inside)


def prefixes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` bytes of all words longer than that, and which words these are."""
    long = np.flatnonzero(words.end - words.start > size)
    if not len(long):
        return np.zeros(0, dtype=np.uint64), long
    start = words.start[long]
    with np.errstate(over="ignore"):
        total = np.zeros(len(long), dtype=np.uint64)
        for j in range(size):
            total += _BYTE[words.data[start + j]] * _power("up", size)[j]
    return mix(total ^ _U(size)), long


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the position of their first word.

    A text of fewer words, but not none, is one run.
    """
    n = np.diff(words.first)
    take = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    doc_start = np.repeat(words.first[:-1], take)
    inner = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
    at = doc_start + inner
    last = np.repeat(words.first[1:], take)
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            here = at + j
            ok = here < last
            part = words.hashes[np.where(ok, here, 0)] if len(words.hashes) else out
            out = out * _P + np.where(ok, mix(part + _U(j)), _U(0))
    return mix(out), at


def slices(sizes: list[int], limit: int):
    """Cut consecutive items into runs of at most ``limit`` in sum; a larger item stands alone."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow string column in UTF-8; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
