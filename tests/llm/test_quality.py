import collections
import re

from fleetlens.llm.quality import QualityRules, host_verdicts, judge, keep_good, measured


def measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            len(lines) - len(set(lines)), len(hit))


TEXTS = [
    "one two three four five six\none two three four five\n\n \x0b\n six", "", None, " ", "é#|<> \n é#|<> ",
    "a b c d e " * 30, "a", "a\na\n a\na", "x" * 100_000, "q\u2028r s\u00a0t",
]


def test_measures_equal_plain_ones(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: tuple(r[1:]) for r in measured(docs).collect()}
    assert got == {i: measure(t) for i, t in enumerate(TEXTS)}


GOOD = " ".join(f"word{i}" for i in range(30))


def test_hosts_are_shrunk_and_judge_their_documents(spark):
    rows = [(i, "short", "bad") for i in range(40)] + [(100 + i, GOOD, "bad") for i in range(5)]
    rows += [(1000 + 10 * h + i, GOOD if i else "short", f"good{h}") for h in range(150) for i in range(10)]
    rows += [(900, GOOD, "tiny"), (901, "short", "tiny"), (902, "short", "tiny"), (903, GOOD, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in judge(docs).collect()}
    assert not any(got[100 + i].kept for i in range(5))  # good texts of a host that mostly fails
    assert got[900].kept and got[903].kept and got[1001].kept  # two of three failures are too few to tell
    assert not got[1000].kept and got[1000].base_failed and not got[1000].host_rejected
    kept = {r.doc_id for r in keep_good(docs).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


def test_hosts_that_agree_share_one_rate(spark):
    rows = [(h * 10 + i, GOOD, f"h{h}") for h in range(3) for i in range(3)]
    table = measured(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    verdicts = host_verdicts(table, QualityRules()).collect()
    assert len(verdicts) == 3 and not any(v.rejected for v in verdicts)
    assert {v.few_words_rate for v in verdicts} == {0.0}


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    got = judge(odd_docs)
    assert got.count() == odd_docs.count()
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[3].n_words == by_id[4].n_words == by_id[5].n_words == 0 and not by_id[3].kept
    assert by_id[1].kept and by_id[6].n_words == 60_000
    kept = keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(
        r.doc_id for r in got.collect() if r.kept
    )
    assert judge(no_docs).count() == 0 and keep_good(no_docs).count() == 0
