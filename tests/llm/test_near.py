import collections

import numpy as np
import pytest

from fleetlens.llm.components import connected_components
from fleetlens.llm.dart_minhash import signatures
from fleetlens.llm.near_dedup import NearRule, keep_one, links, near_classes


def cells(text):
    words = text.translate({i: i + 32 for i in range(65, 91)}).split()
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4) if words else 0))


def classes(rows):
    """Components by comparing all pairs; the members of each."""
    texts = sorted({t for _, t in rows if t is not None})
    sets, root = [cells(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = sum((sets[i] & sets[j]).values())
            if common and 9 * common >= 4 * (sum(sets[i].values()) + sum(sets[j].values())):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for d, t in rows:
        if t is not None:
            groups[find(texts.index(t))].append(d)
    return list(groups.values())


def want(rows):
    out = [(d, d, 1, True) for d, t in rows if t is None]
    for group in classes(rows):
        least = min((d for d in group if d is not None), default=None)
        out += [(d, least, len(group), d == least) for d in group]
    return sorted(out, key=str)


def result(docs, rule=NearRule()):
    return sorted((tuple(r) for r in near_classes(docs, rule).collect()), key=str)


def edited(words, rng, share):
    return [f"new{rng.integers(10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def star():
    """A hot group of different near copies around one text, exact copies, and others."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in rng.integers(0, 500, 120)]
    rows = [(i, " ".join(edited(base, rng, rng.choice([0.005, 0.02, 0.1])))) for i in range(150)]
    rows += [(200 + i, " ".join(base)) for i in range(20)]
    rows += [(300 + i, " ".join(f"o{x}" for x in rng.integers(0, 400, 60))) for i in range(60)]
    rows += [(400, "one two three"), (401, "One TWO  three"), (402, "one two")]
    return rows


@pytest.mark.parametrize("rule", [NearRule(), NearRule(block_texts=10), NearRule(block_cells=600)])
def test_classes_equal_brute_force(spark, star, rule):
    docs = spark.createDataFrame(star, "doc_id long, text string").repartition(3)
    assert result(docs, rule) == want(star)


def test_whole_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert result(docs) == want([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = result(odd_docs)
    # A repeated row of the kept document is marked like it.
    assert got == want(rows)
    assert near_classes(no_docs).count() == 0 and keep_one(no_docs).count() == 0
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # Of the rows with id None, the one with a text stands for its own class.
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter([1, 3, 4, 5, None, None, 6, 8, 9])


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in keep_one(docs).collect()] == [(1, "a b c d e f")]


def test_signatures_agree_as_the_sets_do():
    rng = np.random.default_rng(0)
    sets, similar = [], []
    for _ in range(60):
        a = rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)
        b = np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)])
        sets += [a, b]
        similar.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    lines = signatures(np.concatenate(sets), first, 240)
    estimate = (lines[::2] == lines[1::2]).mean(axis=1)
    assert abs((estimate - similar).mean()) < 0.01 and np.abs(estimate - similar).max() < 0.15
    assert (signatures(sets[3], np.array([0, len(sets[3])]), 240) == lines[3]).all()


def test_links_are_exact():
    a, b, c = np.arange(10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(3, 12, dtype=np.uint64)
    assert links([a, b, c], (4, 5)).tolist() == [0, 0, 2]
    assert links([c, a], (4, 5)).tolist() == [0, 1]


def test_components_of_paths_and_loops(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    edges = spark.createDataFrame(path + [(100, 101), (101, 100), (7, 7), (200, 200)], "a long, b long")
    got = {r.vertex: r.root for r in connected_components(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == got[100] == 100
    assert connected_components(edges.limit(0)).count() == 0
