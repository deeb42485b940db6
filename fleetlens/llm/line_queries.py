"""The query on boilerplate lines and its SQL."""

from __future__ import annotations

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.line_dedup import dedup_lines

_SQL = r"""
    WITH docs AS (SELECT row_number() OVER () AS r, * FROM documents),
    cut AS (
      SELECT r, doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS pos
      FROM docs),
    lines AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM cut),
    shared AS (
      SELECT bare, min(doc_id) AS keeper FROM lines
      WHERE len(regexp_split_to_array(bare, '[ \t\r]+')) >= 3
      GROUP BY bare HAVING count(DISTINCT site) >= 5),
    marked AS (
      SELECT lines.*, shared.bare IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone
      FROM lines LEFT JOIN shared USING (bare)),
    cleaned AS (
      SELECT r, count(*) AS n_lines, count_if(gone) AS n_removed_lines,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
      FROM marked GROUP BY r)
    SELECT doc_id, coalesce(n_lines, 0)::bigint AS n_lines,
      coalesce(n_removed_lines, 0)::bigint AS n_removed_lines, cleaned.text AS text
    FROM docs LEFT JOIN cleaned USING (r)
"""


@llm_query(_SQL)
def op1_line_dedup(spark, sf_dir):
    """Every document without the lines that five or more sources share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed_lines", "text")
