"""The query on toxicity. SQL cannot say it; tests hold it against held-out labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.toxicity import score, train


@llm_query()
def op8_toxicity(spark, sf_dir):
    """Every document scored by a model that learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf_dir, "labels").filter(fold != 0)
    model = train(docs, labels.select("doc_id", "toxic"))
    return (
        docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(True)))
        .withColumn("score", score(F.col("text"), model))
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
