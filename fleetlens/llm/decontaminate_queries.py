"""The query on benchmark passages in documents and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.decontaminate import find_leaks

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_SQL = rf"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    phrases AS (
      SELECT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i
            FROM (SELECT *, least(len(w), 10) AS size FROM items WHERE len(w) > 0))),
    runs AS (
      SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
            FROM docs, (SELECT DISTINCT size FROM phrases) WHERE len(w) >= size)),
    hits AS (SELECT DISTINCT r, size, i, item_id FROM runs JOIN phrases USING (size, phrase)),
    covered AS (
      SELECT r, count(DISTINCT k) AS n_hit
      FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r),
    listed AS (
      SELECT r, count(*) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS ids
      FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit,
      coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)
"""


@llm_query(_SQL)
def op10_decontaminate(spark, sf_dir):
    """Every document with the benchmark items found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(F.col("text"), table(spark, sf_dir, "benchmark"))
    ids = F.sort_array(F.col("f.items").cast("array<string>"))
    return docs.select("doc_id", leaks.alias("f")).select(
        "doc_id",
        "f.n_words",
        "f.n_hit",
        F.size("f.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("f.n_hit") > 0).alias("contaminated"),
    )
