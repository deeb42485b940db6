"""Which of a few hundred keywords occur in which texts, for a batch of texts at once.

Every keyword is filed under one run of three of its bytes, the one that is rarest in the
first texts. About a megabyte of whole texts is one byte array: its runs of three are looked
up in a table, and only where one is found is the keyword that is filed there compared. No
text is walked in Python, and the work hardly depends on the number of keywords.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SIZE = 3
#: Bytes of texts looked at together; a run of texts ends as soon as it has them.
_SLICE = 1 << 20


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive items in runs (first, behind last) that end as soon as their sum reaches ``limit``."""
    begin, total = 0, 0
    for i, size in enumerate(sizes, 1):
        total += size
        if total >= limit or i == len(sizes):
            yield begin, i
            begin, total = i, 0


def _code(run: bytes) -> int:
    return int.from_bytes(run.ljust(_SIZE, b"\0")[:_SIZE], "big")


class KeywordGate:
    """Keywords are not empty; texts are compared as they are, so lower-case them first."""

    def __init__(self, words: list[str]):
        self.words = [w.encode() for w in words]
        self._anchors: list[tuple[int, int]] | None = None
        self._table = np.zeros(1 << (8 * _SIZE), dtype=np.uint16)

    def _file(self, codes: np.ndarray) -> None:
        known = sorted({_code(w[i : i + _SIZE]) for w in self.words if len(w) >= _SIZE for i in range(len(w) - _SIZE + 1)})
        self._table[known] = np.arange(1, len(known) + 1)
        counts = dict(zip(known, np.bincount(self._table[codes], minlength=len(known) + 1)[1:].tolist(), strict=True))
        self._table[known] = 0
        self._anchors, places = [], {}
        for w in self.words:
            if len(w) < _SIZE:
                self._anchors.append((0, 0))
                continue
            at = min(range(len(w) - _SIZE + 1), key=lambda i: (counts[_code(w[i : i + _SIZE])], i))
            code = _code(w[at : at + _SIZE])
            places.setdefault(code, len(places) + 1)
            self._anchors.append((places[code], at))
        for code, place in places.items():
            self._table[code] = place

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and words (numbers of both), each pair once, by word, then row."""
        rows, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for a, b in runs([len(t) for t in texts], _SLICE):
            row, word = self._find(texts[a:b])
            rows.append(row + a)
            found.append(word)
        row, word = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort([row, word])
        return row[order], word[order]

    def _find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # A byte that is in no UTF-8 text keeps matches inside their text.
        data = np.frombuffer(b"\xff".join(texts) + b"\xff" * _SIZE, dtype=np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        codes = data[:-2].astype(np.uint32)
        for more in (data[1:-1], data[2:]):
            codes <<= 8
            codes |= more
        if self._anchors is None:
            self._file(codes)
        place = self._table[codes]
        at = np.flatnonzero(place != 0)
        order = np.argsort(place[at], kind="stable")
        at = at[order]
        first = np.searchsorted(place[at], np.arange(1, len(self.words) + 2))
        rows, found = [], []
        for number, (word, (anchor, shift)) in enumerate(zip(self.words, self._anchors, strict=True)):
            start = at[first[anchor - 1] : first[anchor]] - shift if anchor else np.flatnonzero(data == word[0])
            start = start[(start >= 0) & (start + len(word) <= len(data))]
            for j, byte in enumerate(word):
                start = start[data[start + j] == byte]
            row = np.unique(np.searchsorted(begins, start, side="right") - 1)
            rows.append(row)
            found.append(np.full(len(row), number))
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *found])
