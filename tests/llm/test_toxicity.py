import numpy as np
from pyspark.sql import functions as F

from fleetlens.llm.toxicity import FactorizationMachine, distinct_terms, fit, score, train

DIM = 1 << 12


def scores(texts, model):
    return 1 / (1 + np.exp(-model.margins(*distinct_terms([t.encode() for t in texts], DIM))))


def learned(rows, **settings):
    terms, first = distinct_terms([t.encode() for t, _ in rows], DIM)
    lists = [terms[a:b] for a, b in zip(first[:-1], first[1:])]
    return fit(lists, np.array([float(y) for _, y in rows]), DIM, **settings)


def test_pairs_weigh_what_single_terms_cannot():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"word{i}" for i in rng.integers(0, 40, 6)] + ["grim"] * insult + ["folk"] * group
        rows.append((" ".join(rng.permutation(words)), insult == group))  # neither term alone says anything
    model = learned(rows, epochs=200, rate=0.3, spread=0.05)
    right = (scores([t for t, _ in rows], model) >= 0.5) == np.array([y for _, y in rows])
    assert right.mean() > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, labels.filter(~fold))
    held = docs.join(labels.filter(fold), "doc_id").select("toxic", score(F.col("text"), model).alias("s")).toPandas()
    toxic = held.toxic == 1
    assert (held.s[toxic] >= 0.5).mean() > 0.7 and (held.s[~toxic] >= 0.5).mean() < 0.01


def test_one_kind_of_label_and_none():
    assert 0 < scores(["x"], learned([("a b", True), ("c", True)]))[0] < 1
    none = fit([], np.zeros(0), DIM)
    assert 0 < scores(["", "x"], none)[0] < 1


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 0), (2, 1), (2, 0), (4, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int"
    )
    for some in (labels, labels.limit(0)):
        model = train(odd_docs, some)
        got = odd_docs.select("doc_id", "text", score(F.col("text"), model).alias("s")).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.s <= 1 for r in got)
        empty = {r.s for r in got if r.text in (None, "")}
        assert len(empty) == 1
    assert no_docs.select(score(F.col("text"), model)).count() == 0


def test_rare_terms_that_are_toxic_only_as_a_pair():
    rng = np.random.default_rng(3)

    def row(*planted):
        return " ".join(rng.permutation([f"word{i}" for i in rng.integers(0, 300, 6)] + list(planted)))

    rows = [(row("vile"), True) for _ in range(1900)] + [(row(), False) for _ in range(1900)]
    # Each term stands in 3 % of the rows, as often in toxic as in other ones.
    rows += [(row("grim", "folk"), True) for _ in range(60)]
    rows += [(row("grim"), False) for _ in range(60)] + [(row("folk"), False) for _ in range(60)]
    model = learned(rows, epochs=200, rate=0.3, spread=0.05, shrink=1e-4)
    grim, folk = (int(distinct_terms([w], DIM)[0][0]) for w in (b"grim", b"folk"))
    assert model.factors[[grim, folk]].any(axis=1).all()
    pair, alone = [row("grim", "folk") for _ in range(100)], [row(w) for w in ("grim", "folk") for _ in range(50)]
    assert (scores(pair, model) >= 0.5).mean() > 0.9 and (scores(alone, model) < 0.5).mean() > 0.9


def test_margins_against_all_pairs_one_by_one():
    rng = np.random.default_rng(5)
    model = FactorizationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    texts = [np.sort(rng.choice(50, n, replace=False)) for n in (0, 1, 2, 9, 30)]
    first = np.cumsum([0, *map(len, texts)])
    for got, terms in zip(model.margins(np.concatenate(texts).astype(int), first), texts, strict=True):
        want = model.intercept + sum(model.weights[t] for t in terms)
        want += sum(model.factors[a] @ model.factors[b] for i, a in enumerate(terms) for b in terms[:i])
        assert abs(got - want) < 1e-9


def test_pairs_are_learned_with_the_settings_of_the_query():
    rng = np.random.default_rng(11)

    def row(*planted):
        return " ".join(rng.permutation([f"word{i}" for i in rng.integers(0, 300, 6)] + list(planted)))

    rows = [(row("vile"), True) for _ in range(1500)] + [(row(), False) for _ in range(1500)]
    rows += [(row("grim", "folk"), True) for _ in range(200)]
    rows += [(row("grim"), False) for _ in range(200)] + [(row("folk"), False) for _ in range(200)]
    model = learned(rows)
    pair, alone = [row("grim", "folk") for _ in range(100)], [row(w) for w in ("grim", "folk") for _ in range(50)]
    assert (scores(pair, model) >= 0.5).mean() > 0.9 and (scores(alone, model) < 0.5).mean() > 0.9
