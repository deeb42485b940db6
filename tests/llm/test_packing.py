import collections

import numpy as np
import pytest

from fleetlens.llm.packing import pack, plan_patterns
from fleetlens.llm.packing_queries import END_ID, tokenizer_path
from fleetlens.llm.tokens import WordTokenizer


def check(pieces, docs, capacity):
    """Every id once, sequences gapless; the share of padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, END_ID]
        want.update((r.doc_id, at, i, len(ids)) for at, i in enumerate(ids))
    got, room = collections.Counter(), collections.defaultdict(list)
    for r in pieces.collect():
        ids = np.frombuffer(r.content, "<u4")
        assert len(ids) == r.length > 0
        got.update((r.doc_id, r.start + k, int(i), r.doc_tokens) for k, i in enumerate(ids))
        room[r.sequence_id].append((r.offset, r.length))
    assert got == want
    padded = 0
    for parts in room.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
        padded += 0 if end & (end - 1) == 0 else capacity - end
    return padded / max(sum(want.values()), 1)


@pytest.mark.parametrize("capacity, unit", [(4096, 16), (64, 4)])
def test_pieces_hold_every_id_once(spark, small, capacity, unit):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    padding = check(pack(docs, tokenizer_path, END_ID, capacity, unit), docs, capacity)
    assert padding < 0.05


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    check(pack(odd_docs, tokenizer_path, END_ID), odd_docs, 4096)
    assert pack(no_docs, tokenizer_path, END_ID).count() == 0


def test_plan_is_as_good_as_the_bound():
    rng = np.random.default_rng(3)
    demand = {int(c): int(n) for c, n in zip(range(1, 65), rng.integers(0, 5000, 64))}
    plan = plan_patterns(demand, 64)
    assert (plan.patterns @ plan.classes <= 64).all()
    made = plan.uses @ plan.patterns
    assert (made <= [demand[c] for c in plan.classes.tolist()]).all()
    volume = sum(c * n for c, n in demand.items())
    left = volume - (made * plan.classes).sum()
    # No solution needs fewer sequences than the volume, or than pieces over half a sequence.
    large = sum(n for c, n in demand.items() if c > 32)
    assert plan.uses.sum() + left / 64 <= 1.05 * max(volume / 64, large) + 64


def test_tokenizer_equals_whole_texts(small):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer_path()), WordTokenizer(tokenizer_path(), END_ID)
    texts = ["It's a test, don't! 12 a1 café İstanbul ΣΑΣ ñ. x;; <|endoftext|> é 가. ﬁ ß.", "", "  ", "中文。中 'll ª º ǅ"]
    ids, first = own.encode([t.encode() for t in texts])
    for text, a, b in zip(texts, first[:-1], first[1:]):
        assert ids[a:b].tolist() == [*plain.encode(text, add_special_tokens=False).ids, END_ID]
