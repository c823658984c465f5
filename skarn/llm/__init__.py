"""Operators of a training-data pipeline. Nothing outside this package imports it but the entry file."""

from skarn.llm.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
