"""The query on near duplicates. SQL cannot say it; tests hold it against brute force."""

from __future__ import annotations

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.near_dedup import near_classes


@llm_query()
def op7_near_dedup(spark, sf_dir):
    """Every document with its class of near duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs)
