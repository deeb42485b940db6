"""FM-index of a text shard, in numpy.

The text is an array of symbols below 256 that ends with the only 0. The Burrows-Wheeler
transform lies in a wavelet matrix: one bit vector per bit of a symbol, with a running
count per 64 bits, so the rank of a symbol takes eight look-ups. Every method works on
arrays of queries at once.
"""

from __future__ import annotations

import numpy as np

_SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order: eight symbols at once, then by doubling the ties."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    slots, keys = np.arange(n), key[order]
    width = 8
    while True:
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(begins, len(keys)))
        rank[order[slots]] = np.repeat(slots[begins], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return order
        tied = order[slots]
        behind = tied + width
        later = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        keys = rank[tied] * (n + 2) + later
        by_key = np.argsort(keys)
        order[slots], keys = tied[by_key], keys[by_key]
        width *= 2


class _Bits:
    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, dtype=np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before ``i``."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FmIndex:
    def __init__(self, text: np.ndarray):
        places = suffix_array(text)
        column = text[places - 1]
        self.size = len(text)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])[:256]
        self.levels: list[tuple[int, _Bits, int]] = []
        for bit in range(7, -1, -1):
            ones = (column >> bit) & 1 == 1
            self.levels.append((bit, _Bits(ones), int(len(ones) - ones.sum())))
            column = np.concatenate([column[~ones], column[ones]])
        symbols = np.arange(256)
        self.origin = self._descend(np.zeros(256, dtype=np.int64), symbols)
        sampled = places % _SAMPLE == 0
        self.sampled = _Bits(sampled)
        self.samples = places[sampled].astype(np.int32)

    def _descend(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``i`` in the transform."""
        return self._descend(i, symbol) - self.origin[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern (one per line), by backward search."""
        patterns = patterns.astype(np.int64)
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, j]
            low[alive] = self.less[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.less[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in ``rows``: step back to the next sampled one."""
        place = np.zeros(len(rows), dtype=np.int64)
        rows, alive, steps = rows.copy(), np.arange(len(rows)), 0
        while len(alive):
            here = rows[alive]
            known = self.sampled.at(here)
            done = alive[known]
            place[done] = self.samples[self.sampled.rank(rows[done])] + steps
            alive, here = alive[~known], here[~known]
            symbol = np.zeros(len(here), dtype=np.int64)
            for bit, bits, zeros in self.levels:
                one, ones = bits.at(here), bits.rank(here)
                symbol += one.astype(np.int64) << bit
                here = np.where(one, zeros + ones, here - ones)
            rows[alive] = self.less[symbol] + here - self.origin[symbol]
            steps += 1
        return place
