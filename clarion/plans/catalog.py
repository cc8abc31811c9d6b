"""Every registered query with its SQL equivalent."""

from __future__ import annotations

from clarion.plans import evaluation_queries, evidence_queries, rule_queries, source_queries, text_queries

_MODULES = (evidence_queries, text_queries, evaluation_queries, source_queries, rule_queries)


def queries() -> dict:
    return {f.__name__: f for m in _MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
