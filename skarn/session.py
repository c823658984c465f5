"""Session settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins and skew at run time; UTC keeps timestamps comparable.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local(cores: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that is there."""
    n = cores or os.cpu_count() or 1
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(n), "spark.ui.enabled": "false", "spark.driver.memory": "8g"} | extra
    spark = SparkSession.builder.master(f"local[{n}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def env(name: str, default, choices: tuple[str, ...] | None = None):
    """Setting P40: an environment value in the type of its default; the default if it is absent or invalid."""
    raw = os.environ.get(name, "").strip()
    if not raw:
        return default
    if isinstance(default, bool):
        return raw.lower() in ("1", "true", "yes", "on")
    if choices:
        return raw.lower() if raw.lower() in choices else default
    try:
        return type(default)(raw)
    except ValueError:
        return default
