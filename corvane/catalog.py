"""Registered queries of the engine and the DuckDB SQL that states the same results."""

from __future__ import annotations

from corvane.plans import evaluating, extracting, graphs, ingesting, memory, recalling, relational, retrieval  # noqa: F401  they register their queries
from corvane.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
