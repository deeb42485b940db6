"""The pipeline against the same stages written plainly."""

import collections
import re

import numpy as np
import pytest
from test_lines import plain as plain_lines
from test_near import classes
from test_packing import check as check_packing
from test_quality import measure

import corpus_pipeline
from fleetlens.session import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)

    def words(n, kind="w"):
        return [f"{kind}{i}" for i in rng.integers(0, 3000, n)]

    footer = "this footer stands on every site of all"
    items = [" ".join(words(n, "b")) for n in (30, 12, 4)]
    texts = [" ".join(words(60)) + "\n" + " ".join(words(40)) for _ in range(40)]
    rows = [(i, t if i % 3 else f"{t}\n{footer}", f"s{i % 8}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[3], f"s{i}") for i in range(3)]  # copies
    near = texts[5].split(" ")
    rows += [(110 + i, " ".join(near[: -i - 1] + words(1)), "s1") for i in range(3)]  # near copies
    rows += [(120 + i, f"{texts[i + 10]} {item} tail", "s2") for i, item in enumerate(items)]  # leaks
    rows += [(130, "too short", "s3"), (131, "again and again " * 20, "s3"), (132, None, "s4"), (133, "", None)]
    rows += [(140 + i, "junk", "bad") for i in range(60)] + [(210, " ".join(words(50)), "bad")]
    rows += [(None, " ".join(words(50)), "s5"), (7, rows[7][1], rows[7][2])]  # no id; a repeated row
    docs = spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], COLUMNS)
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def good(rows):
    def fails(text):
        n, chars, symbols, lines, dup, repeat = measure(text)
        return n < 10, 100 * repeat > 20 * n, 100 * symbols > 10 * chars, 100 * dup > 30 * lines

    hosts = collections.defaultdict(list)
    for r in rows:
        hosts[r.source].append(fails(r.text))
    bad = set()
    for k in range(4):
        rates = {h: sum(f[k] for f in fs) / len(fs) for h, fs in hosts.items()}
        mean = sum(f[k] for fs in hosts.values() for f in fs) / len(rows)
        variance = np.var(list(rates.values()))
        weight = max(mean * (1 - mean) / variance - 1, 0) if variance else 0
        for h, fs in hosts.items():
            rate = (sum(f[k] for f in fs) + mean * weight) / (len(fs) + weight) if variance else mean
            if rate > 0.5:
                bad.add(h)
    assert bad == {"bad", None}
    return [(r.doc_id, r.text) for r in rows if not any(fails(r.text)[:2]) and r.source not in bad]


def without_leaks(text, items):
    lowered = lambda t: t.translate({i: i + 32 for i in range(65, 91)})
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = set()
    for item in items:
        w = re.findall(word, lowered(item))
        size = min(10, len(w))
        phrases |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    found = list(re.finditer(word, lowered(text)))
    hit = [False] * len(found)
    for size in {len(p) for p in phrases}:
        for i in range(len(found) - size + 1):
            if tuple(m.group() for m in found[i : i + size]) in phrases:
                hit[i : i + size] = [True] * size
    gone = [False] * len(text)
    for i, h in enumerate(hit):
        if h:
            end = found[i + 1].start() if i + 1 < len(hit) and hit[i + 1] else found[i].end()
            gone[found[i].start() : end] = [True] * (end - found[i].start())
    return "".join(c for c, g in zip(text, gone) if not g)


def texts_of(docs):
    return collections.Counter((r.doc_id, r.text) for r in docs.collect())


def test_stages_equal_plain_ones(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near-dedup", "decontamination", "packing"]

    def stage(name, docs):
        out = materialize(stages[name](spark, docs, folder), "stage")
        assert [f.simpleString() for f in out.schema] == [f.simpleString() for f in docs.schema]
        assert out.filter("n_chars <> length(text)").isEmpty()
        return out

    kept = stage("quality rules", docs)
    assert texts_of(kept) == collections.Counter(good(docs.collect()))
    lined = stage("line dedup", kept)
    rows = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    assert texts_of(lined) == collections.Counter(plain_lines(rows, 5, 3))
    single = stage("near-dedup", lined)
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    by_id = dict(rows)
    groups = classes(rows)
    want = [min((d for d in g if d is not None), default=None) for g in groups]
    assert texts_of(single) == collections.Counter((d, by_id[d]) for d in want)
    assert any(len(g) > 3 for g in groups)
    clean = stage("decontamination", single)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    assert texts_of(clean) == collections.Counter((d, without_leaks(t, items)) for d, t in rows)
    assert texts_of(clean) != texts_of(single)

    from pyspark.sql import functions as F

    from fleetlens.llm.packing import pack
    from fleetlens.llm.packing_queries import CAPACITY, END_ID, tokenizer_path

    packed = stages["packing"](spark, clean, folder)
    whole = pack(clean, tokenizer_path, END_ID, CAPACITY)
    check_packing(whole, clean, CAPACITY)

    def lengths(pieces):
        """Where a piece is cut may depend on the order of rows; what is packed may not."""
        return collections.Counter(map(tuple, pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()))

    assert lengths(packed) == lengths(whole) == lengths(corpus_pipeline.run(spark, folder))


def test_empty_documents(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents_pass_every_stage(spark, corpus, odd_docs):
    folder, _ = corpus
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), "odd")
        assert docs.columns == odd_docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0
