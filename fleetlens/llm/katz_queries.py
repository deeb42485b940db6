"""The query on language-model scores. SQL cannot say it; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.katz import score_texts


@llm_query()
def op4_katz_backoff(spark, sf_dir):
    """Every document scored by a model of four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True))
    return score_texts(docs, learned).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )
