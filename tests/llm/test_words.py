import re

import numpy as np

from fleetlens.llm import words as W

TEXTS = ["The cat the  Cat\n x", "", "a b c d e f g", "été É\tß", " lead", "trail "]


def test_split_finds_the_words_of_a_regular_expression():
    found = W.split([t.encode() for t in TEXTS])
    plain = [w for t in TEXTS for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    got = [found.data[a:b].tobytes().decode() for a, b in zip(found.start, found.end)]
    lowered = [w.translate({i: i + 32 for i in range(65, 91)}) for w in plain]
    assert got == lowered
    assert len(set(found.hashes.tolist())) == len(set(lowered))
    assert np.diff(found.first).tolist() == [len(t.split()) for t in TEXTS]


def test_windows_are_equal_where_their_words_are():
    found = W.split([b"a b c d e f", b"x a b c d e", b"a b", b""])
    hashes, at = W.windows(found, 5)
    assert at.tolist() == [0, 1, 6, 7, 12]
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 4


def test_no_texts():
    found = W.split([])
    assert len(found.hashes) == 0 and len(W.windows(found, 5)[0]) == 0


def test_slices_leave_no_item_out():
    assert list(W.slices([5, 5, 50, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(W.slices([], 10)) == []
