"""Operators for preparing training data, and their registered queries."""

from orthant.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
