import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import katz

CUT = katz.CUT


def tokens(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


class Plain:
    """The same model, from dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = collections.Counter(), collections.defaultdict(collections.Counter)
        for t in texts:
            self.words.update(t)
            for a, b in zip(["<s>", *t[:-1]], t):
                self.pairs[a][b] += 1
        self.n = sum(self.words.values())
        self.one = self.factors(self.words.values())
        self.two = self.factors(c for p in self.pairs.values() for c in p.values())
        left = math.fsum(c - self.cut(self.one, c) for c in self.words.values())
        self.unseen = left / self.n if self.n else 1.0

    def factors(self, counts):
        have = collections.Counter(counts)
        return katz.good_turing([0, *(have[r] for r in range(1, CUT + 2))]).factor

    def cut(self, factors, c):
        return factors[min(c, CUT + 1)] * c

    def p(self, w):
        return self.cut(self.one, self.words[w]) / self.n if self.words[w] else self.unseen

    def after(self, a):
        total = sum(self.pairs[a].values())
        left = math.fsum(c - self.cut(self.two, c) for c in self.pairs[a].values())
        if left <= total * 1e-12:
            total, left = total + 1, left + 1
        return total, left / total / (1 - math.fsum(map(self.p, self.pairs[a])))

    def score(self, text):
        out = 0.0
        for a, b in zip(["<s>", *text[:-1]], text):
            if a not in self.pairs:
                out += math.log10(self.p(b))
                continue
            total, weight = self.after(a)
            seen = self.pairs[a][b]
            out += math.log10(self.cut(self.two, seen) / total if seen else weight * self.p(b))
        return out


def check(docs, learned):
    rows = docs.select("doc_id", "text", F.coalesce(learned, F.lit(False)).alias("l")).collect()
    model = Plain([tokens(r.text) for r in rows if r.l])
    types = len(model.words)
    want = []
    for r in rows:
        t = tokens(r.text)
        base = sum(math.log10((model.words[w] + 0.5) / (model.n + 0.5 * (types + 1))) for w in t)
        want.append((r.doc_id, len(t), sum(model.words[w] > 0 for w in t), model.n, base, model.score(t)))
    got = [tuple(r[c] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
           for r in katz.score_texts(docs, learned).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-7)
    return model


@pytest.mark.parametrize("sizes", [None, (30_000, 5_000, 200), (5_000, 1 << 20, 20)])
def test_scores_equal_dictionaries(spark, small, monkeypatch, sizes):
    if sizes:
        for name, value in zip(("BLOCK_BYTES", "PART_ENTRIES", "HOT"), sizes):
            monkeypatch.setattr(katz, name, value)
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    model = check(docs, F.col("doc_id") % 3 != 0)
    for a in list(model.pairs)[:5]:
        total, weight = model.after(a)
        seen = sum(model.cut(model.two, c) for c in model.pairs[a].values()) / total
        rest = sum(model.p(w) for w in model.words if not model.pairs[a][w]) + model.unseen
        assert seen + weight * rest == pytest.approx(1, abs=1e-9)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    check(odd_docs, F.col("doc_id") != 7)
    check(odd_docs, F.lit(False))
    assert katz.score_texts(no_docs, F.lit(True)).count() == 0


def test_arrays_come_back():
    arrays = [np.array([], np.uint64), np.array([1, 2**63], np.uint64), np.array([0.5, -1e300])]
    back = katz.expand(katz.squeeze(*arrays))
    assert [b.tolist() for b in back[:2]] == [a.tolist() for a in arrays[:2]]
    assert back[2].view(np.float64).tolist() == arrays[2].tolist()


def test_discounts_are_fractions():
    for n in ([0] * 7, [0, 5, 0, 0, 0, 0, 0], [0, 100, 40, 20, 10, 7, 5], [0, 1, 9, 9, 9, 9, 9], [0, 0, 3, 1, 1, 1, 1]):
        factor = katz.good_turing(n).factor
        assert (factor[1:] > 0).all() and (factor <= 1).all() and factor[1:].min() < 1
