import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import periodic_runs, words as W
from fleetlens.llm.grammar import bracket, repair
from fleetlens.llm.periodic_runs import collapsed, find_runs, run_digests
from fleetlens.llm.queries import QUERIES


def by_brute_force(words):
    """Every maximal run, from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if end - start >= max(6, 4 * q) and (start, end) not in found:
                found[start, end] = q
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, words):
    runs = by_brute_force(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = (None,) * 4
    if runs:
        s, n, q = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def hashed(sequences):
    found = W.split([" ".join(map(str, s)).encode() for s in sequences], lower=False)
    return found.hashes, found.doc, found.first


def runs_of(sequences):
    hashes, owner, first = hashed(sequences)
    low, high, period = find_runs(hashes, owner)
    out = [[] for _ in sequences]
    for a, b, q in zip(low.tolist(), high.tolist(), period.tolist()):
        i = owner[a]
        out[i].append((a - int(first[i]), b - a, q))
    return out


def periodic(rng):
    """A sequence of stretches, some of them periodic with a broken end."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(3)
        if kind == 0:
            out += [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(12))]
        else:
            root = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 9))]
            out += (root * 12)[: rng.randrange(len(root) * 12)]
        if kind == 2:
            out += out[-rng.randrange(1, 20) :] * rng.randrange(1, 5)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    sequences = [periodic(rng) for _ in range(120)]
    assert runs_of(sequences) == [by_brute_force(s) for s in sequences]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_over_few_words(sequence):
    assert runs_of([sequence]) == [by_brute_force(sequence)]


def test_thue_morse_blocks_are_told_apart():
    """Words whose polynomial hashes agree are still compared."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    other = [1 - b for b in bits]
    sequence = bits * 2 + other * 2 + bits
    assert runs_of([sequence]) == [by_brute_force(sequence)]


def test_long_runs():
    sequence = ["a"] * 30_000 + ["b"] + ["x", "y", "z"] * 5_000
    assert runs_of([sequence]) == [[(0, 30_000, 1), (30_001, 15_000, 3)]]


def test_grammar_rebuilds_the_sequences():
    rng = random.Random(5)
    hashes, owner, _ = hashed([periodic(rng) for _ in range(60)])
    symbols = np.unique(hashes ^ W.mix(owner.astype(np.uint64)), return_inverse=True)[1]
    rounds, begin, left = repair(symbols, owner)
    for nodes in [*rounds, *bracket(begin, left, len(hashes))]:
        for i in range(len(nodes.begin)):
            own = hashes[nodes.begin[i] : nodes.end[i]]
            assert nodes.begin[i] < nodes.middle[i] < nodes.end[i]
            for p in nodes.place[nodes.first[i] : nodes.first[i + 1]]:
                assert (hashes[p : p + len(own)] == own).all() and owner[p] == owner[p + len(own) - 1]
    # No pair is left that repeats without overlap.
    ends = np.append(begin, len(hashes))
    parts = [tuple(hashes[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
    seen = collections.defaultdict(list)
    for i in range(len(parts) - 1):
        if left[i] == left[i + 1]:
            seen[left[i], parts[i], parts[i + 1]].append(i)
    assert all(len(at) == 1 or max(at) - min(at) == 1 for at in seen.values())


def planted(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def collected(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = collections.Counter(expected(r.doc_id, planted(r.doc_id, r.text)) for r in docs)
    got = QUERIES["op12_periodic_runs"].run(spark, small)
    assert collected(got) == want
    assert sum(n for row, n in want.items() if row[1]) > 10


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    short = odd_docs.filter("text IS NULL OR length(text) < 1000")
    more = spark.createDataFrame([(30, "go " * 40 + "\x0bstop\x0c" + "é ü\t" * 9), (31, "a b a b a b a")], "doc_id long, text string")
    rows = short.select("doc_id", "text").unionByName(more)
    want = collections.Counter(expected(r.doc_id, [w.decode() for w in (r.text or "").encode().split()]) for r in rows.collect())
    clash = rows.withColumn("n_runs", rows.text).withColumn("start", rows.doc_id)
    assert collected(run_digests(clash)) == want
    assert run_digests(no_docs).count() == 0
    assert run_digests(odd_docs).count() == odd_docs.count()


def test_operator_returns_runs_and_texts(spark):
    docs = spark.createDataFrame([("so " * 7 + "it goes",), (None,)], "text string")
    first, second = [r.c for r in docs.select(collapsed("text").alias("c")).collect()]
    assert [tuple(r) for r in first.runs] == [(0, 7, 1)] and first.text == "so it goes"
    assert second.runs == [] and second.text == ""


def test_bounded_parts_give_the_same(monkeypatch):
    rng = random.Random(9)
    sequences = [periodic(rng) for _ in range(80)]
    whole = runs_of(sequences)
    monkeypatch.setattr(periodic_runs, "_TESTS", 7)
    assert runs_of(sequences) == whole
