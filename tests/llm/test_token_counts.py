import collections

import numpy as np
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import token_counts
from fleetlens.llm.hash_table import HashTable
from fleetlens.llm.packing_queries import tokenizer_path
from fleetlens.llm.queries import QUERIES
from fleetlens.llm.token_counts import count_tokens, frequent_lengths
from fleetlens.llm.tokens import WordTokenizer


def by_library(rows, limit=2048):
    plain = Tokenizer.from_file(tokenizer_path())
    out = collections.Counter()
    for r in rows:
        text = r.text or ""
        n = len(plain.encode(text, add_special_tokens=False).ids)
        out[r.doc_id, len(text.encode()), n, n > limit] += 1
    return out


def counted(frame):
    return collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in frame.collect())


def test_query_equals_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_token_counts"].run(spark, small)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    assert counted(got) == by_library(docs)


@pytest.mark.parametrize("size, slices", [(0, 16), (1, 1), (1 << 17, 1)])
def test_the_table_changes_no_count(spark, odd_docs, size, slices):
    rows = odd_docs.select("doc_id", "text").collect()
    extra = spark.createDataFrame(
        [(20, "It's <|endoftext|> a1 b <|startoftext|>x"), (21, "́ é İ ΣΑΣ ﬁ 中文"), (22, "z" * 40_000)],
        "doc_id long, text string",
    )
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    assert counted(count_tokens(docs, tokenizer_path, size=size, slices=slices)) == by_library([*rows, *extra.collect()])


def test_limit_extra_columns_and_no_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumn("n_tokens", odd_docs.text).withColumn("over_limit", odd_docs.doc_id)
    assert counted(count_tokens(clash, tokenizer_path, limit=13)) == by_library(odd_docs.collect(), 13)
    assert count_tokens(no_docs, tokenizer_path).count() == 0


def test_second_tier_is_used_when_the_first_is_empty(monkeypatch):
    monkeypatch.setattr(token_counts, "_caches", {})
    texts, path = [b"two words and two more words"], tokenizer_path()
    first = token_counts._counts(texts, HashTable(2), path)
    monkeypatch.setattr(token_counts, "_encoded_lengths", lambda *_: pytest.fail("encoded again"))
    assert token_counts._counts(texts, HashTable(2), path).tolist() == first.tolist()


def test_table_holds_the_most_frequent(spark):
    docs = spark.createDataFrame([("a a a b b c",), ("b a",)], "text string").coalesce(1)
    table = frequent_lengths(docs, tokenizer_path, size=2)
    from fleetlens.llm import words as W

    assert table.get(W.split([b"a b c"], lower=False).hashes).tolist() == [1, 1, -1]


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_hash_table(n):
    rng = np.random.default_rng(n)
    hashes = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
    table = HashTable(2 * n + 2)
    table.put(hashes, np.arange(len(hashes)))
    got = table.get(hashes)
    # A hash may have been pushed out, never mistaken.
    assert ((got == np.arange(len(hashes))) | (got == -1)).all()
    assert (got >= 0).mean() > 0.95 if n > 100 else (got >= 0).all()
    assert (table.get(rng.integers(1, 2**63, 100, dtype=np.uint64)) == -1).all()
    assert table.get(np.zeros(1, np.uint64)).tolist() == [-1]


def test_full_hash_table_replaces():
    table = HashTable(4)
    hashes = np.arange(1, 200, dtype=np.uint64)
    for h in hashes:
        table.put(hashes[hashes == h], np.array([int(h)]))
    got = table.get(hashes)
    assert got[-1] == 199 and ((got == -1) | (got == hashes.astype(np.int64))).all()


def test_store_starts_anew(monkeypatch):
    monkeypatch.setattr("fleetlens.llm.tokens.CACHE_WORDS", 8)
    own, plain = WordTokenizer(tokenizer_path(), 2), Tokenizer.from_file(tokenizer_path())
    for text in ["one two three four", "five six seven eight nine ten", "one two " + " ".join(f"w{i}" for i in range(40)), "one"]:
        ids, _ = own.encode([text.encode()])
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
