"""The query on phrase collocations and its SQL."""

from __future__ import annotations

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.collocations import collocations

_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM places, (VALUES (1), (2), (3), (4)) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
candidates AS (SELECT lang, k, p, f, string_split(p, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.p, c.f, j, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.p = array_to_string(c.w[1:c.j], ' ')
  JOIN f r ON r.lang = c.lang AND r.p = array_to_string(c.w[c.j + 1:], ' ')),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS place FROM cuts) WHERE place = 1),
parts AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS p, f
  FROM candidates, (VALUES (1), (2), (3)) a(i), (VALUES (2), (3)) b(s) WHERE s < k AND i + s - 1 <= k),
longer AS (SELECT lang, p, max(f) AS f FROM parts GROUP BY lang, p),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.f DESC, c.p) AS rank
  FROM lowest c LEFT JOIN longer g ON g.lang = c.lang AND g.p = c.p
  WHERE g.f IS NULL OR 100 * g.f < 80 * c.f)
SELECT lang, rank::BIGINT AS rank, p AS phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@llm_query(_SQL)
def op11_collocations(spark, sf_dir):
    """The 2000 best phrases of two to four words in each language."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
