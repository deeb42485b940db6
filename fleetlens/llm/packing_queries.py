"""The query on packing. SQL has no tokenizer; tests hold it against a plain packing check."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.packing import pack

CAPACITY, END_ID = 4096, 2


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@llm_query()
def op2_packing(spark, sf_dir):
    """Every document cut and packed into sequences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_path, END_ID, CAPACITY, content=F.crc32).select(
        "doc_id",
        "start",
        "length",
        F.col("content").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
