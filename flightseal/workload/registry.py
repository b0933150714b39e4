"""All registered queries."""

from __future__ import annotations

from . import audit_queries, detector_queries, feature_queries, ingest_queries, model_queries, sampling_queries, scoring_queries

_MODULES = (ingest_queries, audit_queries, feature_queries, sampling_queries, scoring_queries, detector_queries, model_queries)


def queries() -> dict:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
