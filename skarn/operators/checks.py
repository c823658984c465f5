"""Governance checks: freshness, coherence of two sources, value domains, licences, schema drift, registers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import columns as C


def freshness(rows: DataFrame, ts: str, targets: DataFrame, key: str, now: Column) -> DataFrame:
    """Newest ts of each target against its threshold ('Nh' or 'Nd').

    targets has (key, threshold). Status is 'stale' beyond the threshold and where there is no row
    or only null times, 'ahead' for a time after now, else 'ok'.
    """
    newest = rows.groupBy(key).agg(F.max(C.as_timestamp(ts)).alias("newest"))
    out = targets.join(newest, key, "left").withColumn("lag_s", ((F.unix_micros(now) - F.unix_micros(F.col("newest"))) / 1_000_000).cast("long"))
    limit = C.threshold_seconds("threshold")
    status = F.when(F.col("newest").isNull(), "stale").when(F.col("lag_s") < 0, "ahead").when(F.col("lag_s") > limit, "stale").otherwise("ok")
    return out.select(key, "threshold", "newest", "lag_s", C.lag_text("lag_s").alias("lag"), status.alias("status"))


def require_targets(targets: DataFrame, catalogue: DataFrame, on: Sequence[str]) -> DataFrame:
    """The targets, or an error naming those that the catalogue lacks."""
    missing = targets.join(catalogue, list(on), "left_anti").select(*on)
    names = [tuple(r) for r in missing.orderBy(*on).limit(20).collect()]
    if names:
        raise LookupError(f"not in any contract: {names}")
    return targets


def daily_counts(rows: DataFrame, key: str, ts: str, since: Column) -> DataFrame:
    """Rows by key and day from `since` on; shards are partitions, whose counts Spark merges."""
    return rows.filter(F.col(ts) >= since).groupBy(F.col(key).alias("key"), F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of both sides as a percentage of the right side's; 0 for an empty right side."""
    a, b = left.select("key").distinct(), right.select("key").distinct()
    n = b.join(a.withColumn("both", F.lit(1)), "key", "left").agg(F.count(F.lit(1)).alias("right_keys"), F.count("both").alias("common_keys"))
    return n.withColumn("coverage_pct", F.when(F.col("right_keys") == 0, 0.0).otherwise(F.round(100.0 * F.col("common_keys") / F.col("right_keys"), 4)))


def deviations(left: DataFrame, right: DataFrame, tolerance_pct: float) -> DataFrame:
    """Keys and days of both sides whose counts differ by more than the tolerance; 0 against 0 is skipped."""
    both = left.withColumnRenamed("n", "left_n").join(right.withColumnRenamed("n", "right_n"), ["key", "day"]).filter("greatest(left_n, right_n) > 0")
    pct = 100.0 * F.abs(F.col("left_n") - F.col("right_n")) / F.greatest("left_n", "right_n")
    return both.withColumn("deviation_pct", F.round(pct, 4)).filter(pct > tolerance_pct)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Count and share of each value; null is a value and sorts last."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share_pct", F.round(100.0 * F.col("n") / F.col("total"), 4)).orderBy(F.asc_nulls_last("value"))


def outside_domain(rows: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Counts of the non-null values that aren't in the domain."""
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(domain))).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def licence_report(rows: DataFrame, column: str) -> DataFrame:
    """Licences with label, exposure and whether the code is in the domain; null means excluded."""
    out = distribution(rows, column)
    return out.select("value", C.licence_label("value").alias("label"), "n", "share_pct", C.exposable("value").alias("exposed"), (F.col("value").isNull() | F.col("value").isin(0, 1, 2, 3)).alias("in_domain"))


def schema_drift(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared (object, column, type) against actual columns.

    Status: absent_table, absent_column, family_mismatch; objects without drift give no row.
    """
    tables = actual.select("object").distinct().withColumn("there", F.lit(True))
    found = declared.join(tables, "object", "left").join(actual.withColumnRenamed("type", "actual_type"), ["object", "column"], "left")
    status = F.when(F.col("there").isNull(), "absent_table").when(F.col("actual_type").isNull(), "absent_column").when(C.type_family("type") != C.type_family("actual_type"), "family_mismatch")
    return found.select("object", "column", "type", "actual_type", status.alias("status")).filter("status IS NOT NULL")


def frame_columns(frames: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(object, column, type) of DataFrames, as a catalogue of actual columns."""
    return [(name, f.name, f.dataType.simpleString()) for name, df in frames.items() for f in df.schema.fields]


def register_gaps(inventory: DataFrame, declared: DataFrame, dead: str = "mort") -> DataFrame:
    """Names flagged in the inventory but not declared ('missing'), and the reverse ('extra').

    inventory: (name, status, flagged); declared: (name). An extra name whose inventory status is
    dead is 'tolerated'. Every pair of sides is a set: repeated names count once.
    """
    a = inventory.groupBy("name").agg(F.max(F.when(C.flagged("flagged"), 1).otherwise(0)).alias("flag"), F.max(F.when(F.col("status") == dead, 1).otherwise(0)).alias("dead"))
    b = declared.select("name").distinct().withColumn("declared", F.lit(1))
    both = a.join(b, "name", "full_outer")
    kind = F.when((F.col("flag") == 1) & F.col("declared").isNull(), "missing").when((F.col("declared") == 1) & (F.coalesce("flag", F.lit(0)) == 0), F.when(F.col("dead") == 1, "tolerated").otherwise("extra"))
    return both.select("name", kind.alias("kind")).filter("kind IS NOT NULL")


def treatment_tables(treatments: DataFrame) -> DataFrame:
    """Number of distinct tables over all treatments, each of which has an array `tables`."""
    return treatments.select(F.explode("tables").alias("t")).agg(F.countDistinct("t").alias("n_tables"))


def incomplete(expected: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected keys that aren't present."""
    return expected.select(*on).distinct().join(present.select(*on).distinct(), list(on), "left_anti")


def unindexed(rows: DataFrame, column: str, partitions: Sequence[str]) -> bool:
    """Whether a probe by this column would read everything: it is neither a partition column nor in the footers."""
    return column not in partitions and dict(rows.dtypes).get(column, "") not in ("bigint", "int", "date", "timestamp", "timestamp_ntz", "double", "float")
