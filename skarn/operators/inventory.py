"""Volumetry, reconciliation of registers with reality, growth, lineage of pipelines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import columns as C
from skarn.plans.scratch import discard, keep


def volume_rollup(stats: DataFrame) -> DataFrame:
    """Bytes and rows by (system, database), by system, and in all, in one pass.

    level is 0 for (system, database), 1 for a system, 3 for everything.
    """
    return stats.rollup("system", "database").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("tables"), F.sum("row_estimate").alias("rows"), F.sum("total_bytes").alias("bytes"))


def largest(stats: DataFrame, n: int = 20) -> DataFrame:
    """The n largest tables, ties by name; a top-k, not a sort."""
    return stats.orderBy(F.desc("total_bytes"), "system", "database", "table").limit(n)


def status_tally(statuses: DataFrame) -> DataFrame:
    """Rows of each system and status."""
    return statuses.groupBy("system", "status").agg(F.count(F.lit(1)).alias("n"))


def hypertables_and_plain(hyper: DataFrame, plain: DataFrame) -> DataFrame:
    """Hypertables, then the plain tables that are neither their chunks nor hypertables themselves."""
    rest = plain.filter(~F.col("table").startswith("_hyper_")).join(hyper.select("database", "table"), ["database", "table"], "left_anti")
    return hyper.unionByName(rest, allowMissingColumns=True)


def patterns(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """Distinct naming templates (name, scheme, pattern); the scheme is what stands before '://'."""
    rows = [(n, n.split("://", 1)[0] if "://" in n else "", C.template_regex(n)) for n in sorted(set(names))]
    return spark.createDataFrame(rows, "name string, scheme string, pattern string")


def reconcile(actual: DataFrame, referenced: DataFrame) -> dict[str, DataFrame]:
    """Matched and orphan actual names, and ghosts among the referenced templates.

    actual has (name), referenced is what patterns() gives. The scheme makes an equi key of the
    regex join, so that Spark hashes by it and tests only patterns of the same system. An actual
    name counts once however many templates it matches. Names are kept with their rows; ghosts are
    unique by name.
    """
    a = actual.withColumn("scheme", F.when(F.col("name").contains("://"), F.split_part("name", F.lit("://"), F.lit(1))).otherwise(""))
    r = referenced.withColumnRenamed("name", "template").withColumnRenamed("scheme", "r_scheme")
    met = keep(a.join(r, (F.col("scheme") == F.col("r_scheme")) & F.expr("name rlike pattern")).select("name", "template").distinct(), "reconcile")
    hit = met.select("name").distinct()
    return {
        "matched": actual.join(hit, "name", "left_semi"),
        "orphans": actual.join(hit, "name", "left_anti"),
        "ghosts": referenced.join(met.select(F.col("template").alias("name")).distinct(), "name", "left_anti").select("name").distinct(),
    }


def reconcile_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """A10: how many are matched, ghosts and orphans."""
    out = None
    for kind in ("matched", "ghosts", "orphans"):
        n = parts[kind].agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of bytes and rows between two snapshots; absent on a side counts as 0 and is named."""
    keys = ["system", "database", "table"]
    b = after.select(*keys, F.col("total_bytes").alias("bytes_after"), F.col("row_estimate").alias("rows_after"))
    a = before.select(*keys, F.col("total_bytes").alias("bytes_before"), F.col("row_estimate").alias("rows_before"))
    out = a.join(b, keys, "full_outer")
    change = F.when(F.col("bytes_before").isNull(), "new").when(F.col("bytes_after").isNull(), "gone").otherwise("kept")
    diff = lambda c: F.coalesce(f"{c}_after", F.lit(0)) - F.coalesce(f"{c}_before", F.lit(0))
    return out.select(*keys, change.alias("change"), diff("bytes").alias("bytes"), diff("rows").alias("rows"))


def pipeline_edges(pipelines: DataFrame) -> DataFrame:
    """Dataset edges (src, dst, pipeline) from each input to each output of a pipeline."""
    return pipelines.select(F.col("id").alias("pipeline"), F.explode("inputs").alias("src"), "outputs").select("pipeline", "src", F.explode("outputs").alias("dst")).select("src", "dst", "pipeline")


def lineage_closure(edges: DataFrame, start: Iterable[str]) -> DataFrame:
    """(name, depth) of everything downstream of the datasets, by the fewest steps.

    Each step joins the frontier with the edges; it ends when nothing is new, cycles included.
    """
    spark = edges.sparkSession
    pairs = keep(edges.select("src", "dst").distinct(), "lineage-edges")
    seen = keep(spark.createDataFrame([(s, 0) for s in sorted(set(start))], "name string, depth int"), "lineage")
    front, d = seen, 0
    while True:
        d += 1
        new = front.join(pairs, front["name"] == pairs["src"]).select(F.col("dst").alias("name")).distinct().join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(d))
        front = keep(new, "lineage-step")
        if front.isEmpty():
            return seen.filter("depth > 0")
        last, seen = seen, keep(seen.unionByName(front), "lineage")
        discard(last)


def register_breakdown(pipelines: DataFrame) -> DataFrame:
    """Pipelines by status and domain with all subtotals."""
    return pipelines.cube("status", "domain").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))
