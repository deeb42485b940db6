"""The query on document quality and its SQL."""

from __future__ import annotations

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.quality import judge

_RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}


def _sql() -> str:
    fails = ", ".join(f"({c})::int AS {n}" for n, c in _RULES.items())
    sums = ", ".join(f"sum({n})::double AS {n}" for n in _RULES)
    prior = ", ".join(
        f"sum({n}) / sum(docs) AS {n}_m, var_pop({n} / docs) AS {n}_v" for n in _RULES
    )
    rejected = " OR ".join(
        f"CASE WHEN {n}_v = 0 THEN {n}_m ELSE ({n} + {n}_m * w_{n}) / (docs + w_{n}) END > 0.5"
        for n in _RULES
    )
    weights = ", ".join(
        f"CASE WHEN {n}_v = 0 THEN 0 ELSE greatest({n}_m * (1 - {n}_m) / {n}_v - 1, 0) END AS w_{n}"
        for n in _RULES
    )
    space = r"[^\x20\x09-\x0D]"
    return rf"""
    WITH docs AS (
      SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{space}+') AS w
      FROM documents),
    windows AS (
      SELECT r, i, array_to_string(w[i:i + 4], ' ') AS win
      FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
    repeated AS (
      SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
    covered AS (
      SELECT r, count(DISTINCT i + k) AS n_repeat_words
      FROM repeated, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
    lines AS (
      SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
      WHERE regexp_matches(line, '{space}') GROUP BY r),
    measured AS (
      SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM docs LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
    failed AS (SELECT source, {fails} FROM measured),
    hosts AS (SELECT source, count(*)::double AS docs, {sums} FROM failed GROUP BY source),
    prior AS (SELECT {prior} FROM hosts),
    weighed AS (SELECT *, {weights} FROM hosts, prior),
    verdicts AS (SELECT source, {rejected} AS host_rejected FROM weighed),
    judged AS (
      SELECT m.*, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, host_rejected
      FROM measured m JOIN verdicts v ON m.source IS NOT DISTINCT FROM v.source)
    SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars,
      n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
      n_repeat_words::bigint AS n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept,
      host_rejected
    FROM judged
    """


@llm_query(_sql())
def op9_quality_rules(spark, sf_dir):
    """Every document measured and judged by its own and its host's failures."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host_rejected",
    )
