"""Queries over the driver's tables, by name."""

from __future__ import annotations

from tessella.plans import evidence_queries, model_queries, relational_queries, selection_queries, statistics_queries, text_queries

FLAGSHIP = "feature_association_fdr"
_PARTS = (relational_queries, statistics_queries, selection_queries, text_queries, evidence_queries, model_queries)


def queries() -> dict:
    """Queries by name."""
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by name."""
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
