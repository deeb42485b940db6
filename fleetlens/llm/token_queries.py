"""The query on token counts. SQL has no tokenizer; tests hold it against the library on whole texts."""

from __future__ import annotations

from fleetlens.llm.catalog import llm_query, table
from fleetlens.llm.packing_queries import tokenizer_path
from fleetlens.llm.token_counts import count_tokens


@llm_query()
def op13_token_counts(spark, sf_dir):
    """The tokens of every document, and whether they are more than 2048."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_path, limit=2048)
