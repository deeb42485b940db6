import collections
import random
import re

import pytest

from fleetlens.llm import collocations as C
from fleetlens.llm.collocations import collocations

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_brute_force(rows, least, top=2000, percent=80):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(_LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) >= 2 and a >= least}
    longer = collections.Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    found = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * longer[lang, w] >= percent * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, rows_ in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def prose(seed, rows=400, langs=("en", "de", None, "")):
    """Texts over few words, with phrases that always stand together, and hot ones."""
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "Zoë", "x", "New York", "in the end of", "as well as", "e", "mc²", " y"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "; ", "!", "\x0b"]
    out = []
    for _ in range(rows):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(30))
        out.append((rng.choice(langs), "".join(w + rng.choice(marks) for w in words)))
    return out


def collected(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("least, top", [(5, 2000), (30, 20)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = prose(1)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = by_brute_force(rows, least, top)
    assert len(want) > 20
    assert collected(collocations(docs, least=least, top=top)) == want


def test_small_filter_fragments_and_slices_change_nothing(spark, monkeypatch):
    rows = prose(2, 300)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = by_brute_force(rows, 4)
    assert collected(collocations(docs, least=4, filter_bytes=64, fragment=8, bucket=100)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.source, r.text) for r in odd_docs.collect()]
    docs = odd_docs.withColumn("phrase", odd_docs.text).withColumn("rank", odd_docs.doc_id)
    got = collected(collocations(docs, lang="source", least=2))
    assert got == by_brute_force(rows, 2) and got
    assert collocations(no_docs, lang="source").count() == 0
    assert collocations(odd_docs.select("text", "line"), lang="line").count() == len(by_brute_force([("x", t) for _, t in rows], 30))


def test_merged_stripes_hold_totals_and_extensions():
    import numpy as np
    import pyarrow as pa

    known = C._Known({}, 512, np.zeros(1 << 16, dtype=np.int64))
    known._fragments[:] = 2
    prefix = np.sort(np.array([7, 7, 7, 2**63 + 9], dtype=np.uint64))
    following = np.array([0, 5, 2**63, 5], dtype=np.uint64)
    one = C._stripe_rows(prefix, following, np.array([3, 4, 1, 2]), known, 1)
    two = C._stripe_rows(prefix[:2], following[:2], np.array([1, 10]), known, 1)
    rows = sorted(one.to_pylist() + two.to_pylist(), key=lambda r: (r["bucket"], r["part"]))
    assert {r["bucket"] for r in rows} == {0, 1} and {r["part"] for r in rows} == {1, 3}
    # One row per batch: stripes go on over batches.
    batches = [pa.RecordBatch.from_pylist([r], schema=one.schema) for r in rows]
    merged = [x for b in C._merge_stripes(2, 1)(iter(batches)) for x in b.to_pylist()]
    by_prefix, second = collections.Counter(), 9 - 2**63
    for r in merged:
        by_prefix[r["prefix"]] += r["total"]
    assert by_prefix == {7: 19, second: 2}
    assert {(r["prefix"], w, c) for r in merged for w, c in zip(r["following"], r["counts"])} == {(7, 5, 14), (second, 5, 2)}
    assert max(r["best"] for r in merged if r["prefix"] == 7) == 14


def test_filter_has_all_and_little_more(spark):
    import numpy as np

    from fleetlens.llm import words as W

    ids = W.mix(np.arange(20_000, dtype=np.uint64))
    level = spark.createDataFrame([(int(i),) for i in ids[:10_000].view(np.int64)], "id long").selectExpr("id", "10L AS f")
    known = C._known(level, 1 << 20, 5)
    assert known.has(ids[:10_000]).all() and known.has(ids[10_000:]).mean() < 0.02
    assert (known.fragment_bits(ids[:10_000]) == 1).all()
    small = C._known(level, 1 << 10, 50)
    assert small.has(ids[:10_000]).all() and not small.fragment_bits(ids).any()


def test_a_task_holds_few_entries_of_stripes():
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from fleetlens.llm import collocations as C

    known = SimpleNamespace(value=SimpleNamespace(
        has=lambda ids: np.ones(len(ids), dtype=bool), fragment_bits=lambda ids: np.zeros(len(ids), dtype=np.int64)
    ))
    texts = [" ".join(f"{i * 100_000 + j:x}" for j in range(100_000)) for i in range(22)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([t])], ["lang", "text"]) for t in texts]
    tracemalloc.start()
    entries = sum(len(x) // 8 for out in C._stripes(1, known, 0)(iter(batches)) for x in out.column("following").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert entries == 2_200_000
    assert peak < 130 << 20, peak
