"""Token ids of many texts, each distinct word tokenized once.

The tokenizer in use drops white space and never joins words across it, so the ids of
a text are those of its space-separated words in turn. A corpus repeats its words, so
most of them are looked up by hash instead of tokenized.
"""

from __future__ import annotations

import os
import re

import numpy as np

from fleetlens.llm import words as W
from fleetlens.llm.hash_table import HashTable

#: Distinct words a worker process keeps; beyond, the store starts anew.
CACHE_WORDS = 1 << 21
#: Plain words given to the tokenizer at once.
_JOINED = 1000


#: Words whose runs are known: Latin letters, one run, perhaps with a mark behind, another.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?").fullmatch


class WordTokenizer:
    """Ids of texts by a tokenizer file; ``end_id`` closes each text."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        # The same model without normalizing and patterns, for runs whose letters are lower-case bytes already.
        self._model = Tokenizer.from_file(path)
        self._model.normalizer = normalizers.Sequence([])
        self._model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(0xC0, 0x100)) if _PLAIN(c)]
        self._letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        self._end_id = end_id
        vocabulary = self._tokenizer.get_vocab()
        self._closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self._places = HashTable(2 * CACHE_WORDS, np.int32)
        self._words = 0
        self._first = np.zeros(1 << 12, dtype=np.int64)
        self._ids = np.zeros(1 << 14, dtype=np.uint32)

    def _store(self, sizes: np.ndarray, ids: list[np.ndarray]) -> None:
        """Append the ids of words in a row."""
        n, end = self._words, int(self._first[self._words])
        total = end + int(sizes.sum())
        while len(self._first) <= n + len(sizes):
            self._first = np.concatenate([self._first, np.zeros_like(self._first)])
        while len(self._ids) < total:
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._first[n + 1 : n + 1 + len(sizes)] = end + np.cumsum(sizes)
        self._ids[end:total] = np.concatenate([*ids, np.zeros(0, dtype=np.uint32)])
        self._words = n + len(sizes)

    def _by_word(self, words: list[str]) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
        """The words in another order, the number of ids of each in that order, and their ids."""
        # A plain word has one run, or two if it ends in a mark.
        runs = np.fromiter((0 if not _PLAIN(w) else 1 if w[-1].isalpha() else 2 for w in words), np.int64, len(words))
        plain, order, alone = np.flatnonzero(runs), [], np.flatnonzero(runs == 0).tolist()
        parts = [plain[a : a + _JOINED] for a in range(0, len(plain), _JOINED)]
        spaced = [
            " ".join([words[i] if n == 1 else f"{words[i][:-1]} {words[i][-1]}" for i, n in zip(p.tolist(), runs[p].tolist(), strict=True)])
            for p in parts
        ]
        texts = [t if t.isascii() else t.translate(self._letters) for t in map(str.lower, spaced)]
        sizes, ids = [], []
        for part, found in zip(parts, self._encode(texts, self._model), strict=True):
            # The word with its n-th run ends at the n-th id that closes a run.
            closing, ends = np.flatnonzero(self._closes[found]) + 1, np.cumsum(runs[part])
            if len(closing) != ends[-1]:
                alone += part.tolist()
                continue
            order += part.tolist()
            sizes.append(np.diff(closing[ends - 1], prepend=0))
            ids.append(found)
        own = self._encode([words[i] for i in alone])
        sizes.append(np.fromiter(map(len, own), dtype=np.int64, count=len(own)))
        return order + alone, np.concatenate(sizes), [*ids, *own]

    def lengths(self, words: list[str]) -> np.ndarray:
        """The number of ids of each word."""
        order, sizes, _ = self._by_word(words)
        out = np.zeros(len(words), dtype=np.int64)
        out[order] = sizes
        return out

    def _learn(self, words: list[str]) -> list[int]:
        """Store the ids of ``words``; the places of the words in the order they are stored."""
        order, sizes, ids = self._by_word(words)
        self._store(sizes, ids)
        return order

    def _encode(self, texts: list[str], by=None) -> list[np.ndarray]:
        found = (by or self._tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last one's end)."""
        found = W.split(texts, lower=False)
        entry = self._places.get(found.hashes).astype(np.int64)
        missed = np.flatnonzero(entry < 0)
        if len(missed):
            fresh, at, inverse = np.unique(found.hashes[missed], return_index=True, return_inverse=True)
            if self._words + len(fresh) > CACHE_WORDS and self._words:
                self._forget()
                return self.encode(texts)
            base, at = self._words, missed[at]
            raw = found.data.tobytes()
            spans = zip(found.start[at].tolist(), found.end[at].tolist(), strict=True)
            places = np.zeros(len(fresh), dtype=np.int64)
            places[self._learn([raw[a:b].decode() for a, b in spans])] = base + np.arange(len(fresh))
            entry[missed] = places[inverse]
            self._places.put(fresh, places)
        sizes = self._first[entry + 1] - self._first[entry]
        before = np.concatenate([[0], np.cumsum(sizes)])
        # One closing id stands behind each earlier text.
        out = np.full(int(before[-1]) + len(texts), self._end_id, dtype=np.uint32)
        source = np.arange(before[-1]) + np.repeat(self._first[entry] - before[:-1], sizes)
        out[np.arange(before[-1]) + np.repeat(found.doc, sizes)] = self._ids[source]
        return out, before[found.first] + np.arange(len(texts) + 1)


_own: dict[tuple[str, int], WordTokenizer] = {}


def worker_tokenizer(path: str, end_id: int) -> WordTokenizer:
    """The tokenizer of this worker process: tasks that follow each other share its store."""
    if (path, end_id) not in _own:
        _own.clear()
        _own[path, end_id] = WordTokenizer(path, end_id)
    return _own[path, end_id]
