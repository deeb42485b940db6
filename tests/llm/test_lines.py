import collections

import pytest
from pyspark.sql import functions as F

from fleetlens.llm.line_dedup import LineRule, boilerplate, dedup_lines, line_table


def plain(rows, sites, words):
    """doc_id, text, source -> what stays of each text."""
    holders = collections.defaultdict(set)
    ids = collections.defaultdict(list)
    for d, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            bare = line.strip(" \t\r")
            holders[bare].add(s or "")
            ids[bare].append(d)
    shared = {x for x, h in holders.items() if len(h) >= sites and len(x.split()) >= words}
    keeper = {x: min((i for i in ids[x] if i is not None), default=None) for x in shared}

    def stays(d, line):
        bare = line.strip(" \t\r")
        return bare not in shared or d == keeper[bare]

    return [(d, t and "\n".join(x for x in t.split("\n") if stays(d, x))) for d, t, _ in rows]


def cleaned(docs, rule):
    return collections.Counter((r.doc_id, r.text) for r in dedup_lines(docs, rule).collect())


@pytest.mark.parametrize("sites", [2, 5, 40])
def test_lines_equal_brute_force_around_the_threshold(spark, sites):
    # Line n stands on n sites, so some are far below, near and far above any threshold.
    rows = [
        (100 * n + s, f"own line of {n} and {s}\n  shared line number {n}\t\r", f"site{s}")
        for n in range(1, 60, 3) for s in range(n)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    rule = LineRule(min_sites=sites)
    assert cleaned(docs, rule) == collections.Counter(plain(rows, sites, 3))


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rule = LineRule(min_sites=2)
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    out = dedup_lines(odd_docs, rule)
    assert out.columns == [*odd_docs.columns, "n_lines", "n_removed_lines"]
    assert cleaned(odd_docs, rule) == collections.Counter(plain(rows, 2, 3))
    assert dedup_lines(no_docs).count() == 0


def test_one_text_of_a_group_of_copies_stays_whole(spark):
    text = "a line of some words\nanother line of words"
    rows = [(i, text, f"s{i}") for i in range(1, 30)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].text == text and {got[i].text for i in range(2, 30)} == {""}
    assert (got[2].n_lines, got[2].n_removed_lines) == (2, 2)


def test_lines_without_any_id_stay(spark):
    rows = [(None, "words in a line here", f"s{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.text for r in dedup_lines(docs).collect()} == {"words in a line here"}


def test_no_python_on_the_main_path(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rule = LineRule()
    lines = line_table(docs, rule, "doc_id", "text", "source")
    for df in (lines, boilerplate(lines, rule), dedup_lines(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert lines.agg(F.count("*")).first()[0] > 0
