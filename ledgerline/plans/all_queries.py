"""All queries of the reports, by name."""

from __future__ import annotations

from ledgerline.plans import conversation_queries, counter_queries, more_queries, report_queries, source_queries, usage_queries  # noqa: F401  each module registers its queries
from ledgerline.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
