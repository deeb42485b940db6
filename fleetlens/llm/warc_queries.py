"""The query on the page archive and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.warc import header_field, read_archive, write_archive

_SQL = """
    WITH body AS (
      SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
        strlen(coalesce(html, '')) AS payload_bytes
      FROM pages),
    placed AS (
      SELECT *, max(page_id) OVER (PARTITION BY html) AS holder, count(*) OVER (PARTITION BY html) AS uses
      FROM body),
    typed AS (
      SELECT *, uses > 1 AND payload_bytes >= 1000 AND holder IS NOT NULL
        AND page_id IS DISTINCT FROM holder AS revisit
      FROM placed)
    SELECT page_id, payload_bytes::bigint AS payload_bytes, payload_digest,
      CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN revisit THEN holder END AS refers_to
    FROM typed
"""


@llm_query(_SQL)
def op3_warc_archive(spark, sf_dir):
    """Every page archived, and what the archive then says of it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = read_archive(spark, write_archive(pages))
    same_digest = header_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.sha1("payload"))
    return records.select(
        "page_id",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(same_digest, F.sha1("payload")).alias("payload_digest"),
        header_field("WARC-Type").alias("record_type"),
        F.regexp_extract(header_field("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1)
        .cast("long")
        .alias("refers_to"),
    )
