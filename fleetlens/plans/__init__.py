"""Registered queries. Importing the modules fills the catalog."""

from fleetlens.plans import disk_queries, log_queries, report_queries, secret_queries, stream_queries  # noqa: F401
from fleetlens.plans.catalog import CATALOG

__all__ = ["CATALOG"]
