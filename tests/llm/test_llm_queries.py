"""Queries of the subpackage against their SQL, and what the queries promise of their columns."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from fleetlens.llm.queries import QUERIES

ORACLE = {n: q.sql for n, q in QUERIES.items() if q.sql}
COLUMNS = {
    "op2_": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op6_": "page_id host path rule verdict",
    "op8_": "doc_id held_out score predicted",
    "op9_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_": "lang rank phrase a l r n score",
    "op12_": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_": "doc_id n_bytes n_tokens over_limit",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, name):
    result = compare(spark, connect(small), QUERIES[name].run, ORACLE[name], small)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("start", sorted(COLUMNS))
def test_columns_come_first(spark, small, start):
    name = next(n for n in QUERIES if n.startswith(start))
    wanted = COLUMNS[start].split()
    assert QUERIES[name].run(spark, small).columns[: len(wanted)] == wanted


def test_entry_lists_one_query_per_operator_and_the_pipeline():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
