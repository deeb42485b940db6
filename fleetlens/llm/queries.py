"""All queries of this subpackage; importing the modules registers them."""

from fleetlens.llm import chat_queries, collocation_queries, decontaminate_queries, katz_queries, line_queries, near_queries, packing_queries, quality_queries, run_queries, token_queries, toxicity_queries, url_queries, warc_queries  # noqa: F401
from fleetlens.llm.catalog import QUERIES

__all__ = ["QUERIES"]
