import numpy as np
import pytest

from fleetlens.llm.decontaminate import decontaminate, find_leaks
from fleetlens.llm.fm_index import FmIndex, suffix_array


@pytest.mark.parametrize("size, letters", [(1, 3), (50, 4), (3000, 5), (2000, 200)])
def test_index_counts_and_locates_like_a_scan(size, letters):
    rng = np.random.default_rng(size)
    text = np.append(rng.integers(1, letters, size - 1), 0).astype(np.uint8)
    plain = text.tobytes()
    places = suffix_array(text)
    assert places.tolist() == sorted(range(size), key=lambda i: plain[i:])
    index = FmIndex(text)
    assert index.locate(np.arange(size)).tolist() == places.tolist()
    for length in (1, 2, 5):
        if size < 20:
            continue
        patterns = np.stack([text[i : i + length] for i in rng.integers(0, size - 6, 60)])
        patterns[::5] = rng.integers(1, letters, patterns[::5].shape)
        for pattern, low, high in zip(patterns, *index.search(patterns)):
            found = sorted(places[low:high].tolist())
            assert found == [i for i in range(size) if plain.startswith(pattern.tobytes(), i)]


def test_long_repeats_sort():
    text = np.append(np.tile(np.array([5, 6, 7], np.uint8), 2000), 0).astype(np.uint8)
    plain = text.tobytes()
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: plain[i:])


PASSAGE = "one two three four five six seven eight nine ten eleven"


def test_spans_and_cut_text(spark):
    docs = spark.createDataFrame(
        [(1, f"É start. {PASSAGE.upper()}! end"), (2, PASSAGE[:-7]), (3, None), (4, ""), (5, "say tiny bit"), (5, "say tiny bit")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame(
        [(10, PASSAGE), (11, "Tiny, bit"), (12, None), (None, "start"), (13, ""), (14, PASSAGE)], "item_id long, text string"
    )
    leaks = docs.select("doc_id", "text", find_leaks(docs["text"], bench).alias("f"))
    got = [(r.doc_id, r.f.n_words, r.f.n_hit, r.f.items, r.text is not None and [r.text[s.start : s.end] for s in r.f.spans])
           for r in leaks.collect()]
    assert got == [
        (1, 14, 12, [10, 14], [f"start. {PASSAGE.upper()}"]),
        (2, 10, 10, [10, 14], [PASSAGE[:-7]]),
        (3, 0, 0, [], False),
        (4, 0, 0, [], []),
        (5, 3, 2, [11], ["tiny bit"]),
        (5, 3, 2, [11], ["tiny bit"]),
    ]
    assert [r.text for r in decontaminate(docs, bench).collect()] == ["É ! end", "", None, "", "say ", "say "]


def test_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "rights reserved now")], "item_id long, text string")
    cut = decontaminate(odd_docs, bench)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert decontaminate(no_docs, bench).count() == 0
    same = decontaminate(odd_docs, bench.limit(0))
    assert sorted(map(str, same.collect())) == sorted(map(str, odd_docs.collect()))


def test_many_blocks_of_phrases(spark, small, monkeypatch):
    from pyspark.sql import functions as F

    from fleetlens.llm import decontaminate as D

    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")

    def result():
        f = D.find_leaks(F.col("text"), bench)
        return sorted((r.doc_id, str(r.f)) for r in docs.select("doc_id", f.alias("f")).collect())

    whole = result()
    monkeypatch.setattr(D, "BLOCK_PHRASES", 50)
    monkeypatch.setattr(D, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(D, "_AT_ONCE", 3)
    assert result() == whole


def test_items_with_text_ids(spark):
    docs = spark.createDataFrame([(1, f"a {PASSAGE}"), (2, "else"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(
        [("item-b", PASSAGE), ("item-a", PASSAGE), (None, PASSAGE), ("10", "else")], "item_id string, text string"
    )
    got = {r.doc_id: r.f["items"] for r in docs.select("doc_id", find_leaks(docs["text"], bench).alias("f")).collect()}
    assert got == {1: ["item-a", "item-b"], 2: ["10"], 3: []}
