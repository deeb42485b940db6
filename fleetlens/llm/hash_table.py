"""A table from 64-bit hashes to small numbers in two numpy arrays, looked up many at a time."""

from __future__ import annotations

import numpy as np

#: Slots tried for a hash, one after another.
_PROBES = 8


class HashTable:
    """Holds at most its ``slots``; a hash that finds all its slots taken replaces another.

    Values are not negative; 0 is not a hash (it marks a free slot) and is never found.
    """

    def __init__(self, slots: int, value_type=np.int32):
        self._mask = np.uint64((1 << max(slots - 1, 1).bit_length()) - 1)
        room = int(self._mask) + _PROBES
        self.keys = np.zeros(room, dtype=np.uint64)
        self.values = np.zeros(room, dtype=value_type)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 where there is none."""
        slot = (hashes & self._mask).astype(np.int64)
        key = self.keys[slot]
        found = np.where(key == hashes, self.values[slot], -1)
        open_ = np.flatnonzero((key != hashes) & (key != 0))
        for step in range(1, _PROBES):
            if not len(open_):
                break
            at = slot[open_] + step
            key, wanted = self.keys[at], hashes[open_]
            hit = key == wanted
            found[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (key != 0)]
        found[hashes == 0] = -1
        return found

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Store distinct hashes that are not in the table yet."""
        open_ = np.flatnonzero(hashes)
        slot = (hashes & self._mask).astype(np.int64)
        for step in range(_PROBES):
            if not len(open_):
                return
            at = slot[open_] + step
            free = np.flatnonzero(self.keys[at] == 0)
            # Where several want one slot, the last write stands.
            self.keys[at[free]] = hashes[open_[free]]
            won = free[self.keys[at[free]] == hashes[open_[free]]]
            self.values[at[won]] = values[open_[won]]
            left = np.ones(len(open_), dtype=bool)
            left[won] = False
            open_ = open_[left]
        at = slot[open_]
        self.keys[at] = hashes[open_]
        won = self.keys[at] == hashes[open_]
        self.values[at[won]] = values[open_[won]]
