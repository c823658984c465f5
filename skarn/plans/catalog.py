"""All queries of the governance, retrieval and graph operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.plans import governance, parity, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**governance.QUERIES, **retrieval.QUERIES, **parity.QUERIES}
ORACLE_SQL: dict[str, str] = {**governance.ORACLE_SQL, **retrieval.ORACLE_SQL, **parity.ORACLE_SQL}
