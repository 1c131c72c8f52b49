"""Registry of the telemetry queries and their SQL oracles."""

from __future__ import annotations

from .plans import analysis_queries, decision_queries, extra_queries, model_queries, quality_queries, signal_queries  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["flt1_tier1_qc"](spark, sf_dir)
