"""The query on periodic runs and its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.periodic_runs import run_digests

_WORD = r"[^\x20\x09-\x0D]+"


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which, for a tenth of the ids, the words from some place on repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.array(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0)))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        g = F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        # A word's place is counted from 0, an element's from 1.
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(again, " ")).otherwise(F.lit(""))

    return F.when(h % 10 == 0, F.transform(words, repeated)[0]).otherwise(text)


#: Grams of 2^k words find all periods above 2^(k-1) and up to 2^k: in such a run the next equal gram is one period on.
_LEVELS = 15


def _sql() -> str:
    crc_table = """
    crc_table AS (
      SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]),
          lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
        FROM range(256) r(i)))"""
    levels = []
    for k in range(1, _LEVELS):
        half = 2 ** (k - 1)
        # Grams longer than half a text can't stand in a run.
        levels.append(f"""
    g{k} AS (
      SELECT a.r, a.i, dense_rank() OVER (ORDER BY a.name, b.name) AS name
      FROM g{k - 1} a JOIN g{k - 1} b ON a.r = b.r AND b.i = a.i + {half} JOIN docs d ON d.r = a.r
      WHERE len(d.w) >= {2 * half + 2})""")
    nexts = " UNION ALL ".join(
        f"SELECT {2**k} AS g, r, i, lead(i) OVER (PARTITION BY r, name ORDER BY i) - i AS q FROM g{k}" for k in range(_LEVELS)
    )
    return rf"""
    WITH {crc_table},
    raw AS (
      SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
          lambda c, b: xor(t[(xor(c, b) & 255) + 1], c // 256)), 4294967295) AS h
      FROM documents, crc_table),
    placed AS (SELECT *, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS d FROM raw),
    docs AS (
      SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0
        THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // d) END + 1] FOR i IN range(len(w))]
        ELSE w END AS w
      FROM placed),
    words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
    g0 AS (SELECT r, i, dense_rank() OVER (ORDER BY word) AS name FROM words), {", ".join(levels)},
    nexts AS (SELECT * FROM ({nexts}) WHERE q <= g AND 2 * q > g),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY r, g, q ORDER BY i) AS island FROM nexts),
    runs AS (
      SELECT r, min(i) AS start, max(i) + q + g - min(i) AS length, q AS period
      FROM islands GROUP BY r, g, q, island HAVING max(i) + q + g - min(i) >= greatest(6, 4 * q)),
    best AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS place
        FROM runs) WHERE place = 1),
    listed AS (
      SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
      FROM runs GROUP BY r),
    dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (
      SELECT r, string_agg(word, ' ' ORDER BY i) AS left_over FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length,
      period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
      sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
    FROM docs LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
    """


@llm_query(_sql())
def op12_periodic_runs(spark, sf_dir):
    """The periodic runs of every document, a tenth of them made periodic."""
    docs = table(spark, sf_dir, "documents")
    return run_digests(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
