"""Quality rules declared in contracts: parsed on the driver, checked in one pass over each table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import columns as C


@dataclass(frozen=True)
class Rule:
    """One rule. kind: range, set, required, unique, freshness, completeness or documented."""

    contract: str
    object: str
    column: str
    kind: str
    lo: float | None = None
    hi: float | None = None
    members: tuple = ()
    severity: str = "error"
    columns: tuple[str, ...] = field(default=())
    threshold: str | None = None


def rules_of(contract: Mapping) -> list[Rule]:
    """The rules of a parsed contract; Q07 flags become rules; a missing severity is 'error' (Q08)."""
    out, cid = [], str(contract.get("id", "")).split(":")[-1]
    for obj in contract.get("schema") or []:
        name = obj.get("physicalName") or obj.get("name", "")
        keys = []
        for prop in obj.get("properties") or []:
            col = prop.get("name", "")
            if prop.get("primaryKey"):
                keys.append(col)
            if prop.get("required") or prop.get("primaryKey"):
                out.append(Rule(cid, name, col, "required"))
            if prop.get("unique"):
                out.append(Rule(cid, name, col, "unique", columns=(col,)))
            out += [r for q in prop.get("quality") or [] if (r := _quality(cid, name, col, q))]
        out += [r for q in obj.get("quality") or [] if (r := _quality(cid, name, "", q, tuple(keys)))]
    return out


def _quality(cid: str, obj: str, col: str, q: Mapping, keys: tuple[str, ...] = ()) -> Rule | None:
    kind, severity = q.get("rule") or q.get("type"), q.get("severity") or "error"
    if "mustBeIn" in q:
        return Rule(cid, obj, col, "set", members=tuple(q["mustBeIn"]), severity=severity)
    between = q.get("mustBeBetween")
    lo = between[0] if between else q.get("mustBeGreaterOrEqualTo", q.get("mustBeGreaterThanOrEqualTo"))
    hi = between[1] if between else q.get("mustBeLessOrEqualTo", q.get("mustBeLessThanOrEqualTo"))
    if lo is not None or hi is not None:
        return Rule(cid, obj, col, "range", lo, hi, severity=severity)
    if kind == "uniqueness":
        return Rule(cid, obj, col, "unique", severity=severity, columns=(col,) if col else keys)
    limit = q.get("threshold") or q.get("mustBeLessThan")
    return Rule(cid, obj, col, kind, severity=severity, columns=(col,) if col else keys, threshold=str(limit) if limit is not None and kind == "freshness" else None) if kind in ("freshness", "completeness", "documented") else None


def _violated(r: Rule):
    c = F.col(r.column)
    if r.kind == "range":
        bad = F.lit(False)
        bad = bad | (c < r.lo) if r.lo is not None else bad
        return bad | (c > r.hi) if r.hi is not None else bad
    return ~c.isin(list(r.members)) if r.kind == "set" else c.isNull()


def check_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Q01, Q02, Q07: rows and violations of each range, set and required rule, in one aggregate over one scan.

    Bounds are inclusive; nulls pass range and set rules.
    """
    rules = [r for r in rules if r.kind in ("range", "set", "required")]
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, column string, severity string, n_rows long, violations long")
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.coalesce(_violated(r), F.lit(False))).alias(f"v{i}") for i, r in enumerate(rules)))
    items = [F.struct(F.lit(r.kind).alias("rule"), F.lit(r.column).alias("column"), F.lit(r.severity).alias("severity"), F.col(f"v{i}").alias("violations")) for i, r in enumerate(rules)]
    return sums.select("n_rows", F.explode(F.array(*items)).alias("r")).select("r.rule", "r.column", "r.severity", "n_rows", "r.violations")


def run(tables: Mapping[str, DataFrame], rules: Sequence[Rule], expected: Mapping[str, DataFrame] | None = None, now: Column | None = None) -> DataFrame:
    """Q01-Q08: one row for each rule: (object, column, rule, severity, n_rows, violations, status).

    Range, set and required rules of a table share one scan. A unique rule counts the rows that are
    beyond the first of their key. A freshness rule compares the newest value of its column with `now`
    and violates once beyond its threshold, or without any value. A completeness rule counts the keys of
    expected[object] that the table lacks. status is 'ok', 'violated', 'no table', or 'documented' for what isn't executable.
    """
    spec = "object string, column string, rule string, severity string, n_rows long, violations long, status string"
    spark, parts = SparkSession.active(), []
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.object, []).append(r)

    def row(df: DataFrame, r: Rule, bad: Column) -> DataFrame:
        name = r.column or ",".join(r.columns)
        return df.select(F.lit(r.object).alias("object"), F.lit(name).alias("column"), F.lit(r.kind).alias("rule"), F.lit(r.severity).alias("severity"), "n_rows", bad.alias("violations"))

    for obj, own in by.items():
        df = tables.get(obj)
        if df is None:
            parts.append(spark.createDataFrame([(obj, r.column or ",".join(r.columns), r.kind, r.severity, None, None, "no table") for r in own], spec))
            continue
        done = check_rows(df, own).select(F.lit(obj).alias("object"), "column", "rule", "severity", "n_rows", "violations")
        for r in own:
            if r.kind == "unique" and r.columns:
                n = df.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad"))
                done = done.unionByName(row(n, r, F.col("bad")))
            elif r.kind == "freshness" and r.threshold and now is not None:
                n = df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(C.as_timestamp(r.column)).alias("newest"))
                late = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("newest")) > C.threshold_seconds(F.lit(r.threshold)) * 1_000_000
                done = done.unionByName(row(n, r, F.coalesce(late, F.lit(True)).cast("long")))
            elif r.kind == "completeness" and expected and obj in expected:
                keys = list(r.columns) or [r.column]
                missing = expected[obj].select(*keys).distinct().join(df.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("bad"))
                done = done.unionByName(row(missing.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n_rows")))), r, F.col("bad")))  # one row each
        status = F.when(F.col("violations") > 0, "violated").otherwise("ok")
        parts.append(done.withColumn("status", status))
        ran = [r for r in own if r.kind in ("range", "set", "required") or (r.kind == "unique" and r.columns) or (r.kind == "freshness" and r.threshold and now is not None) or (r.kind == "completeness" and expected and obj in expected)]
        rest = [(obj, r.column or ",".join(r.columns), r.kind, r.severity, None, None, "documented") for r in own if r not in ran]
        if rest:
            parts.append(spark.createDataFrame(rest, spec))
    out = spark.createDataFrame([], spec)
    for part in parts:
        out = out.unionByName(part)
    return out


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q03: keys that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def clean(df: DataFrame, rules: Sequence[Rule], as_null: bool = False) -> DataFrame:
    """Q11: without the rows that violate a range or set rule, or with the offending values set to null."""
    for r in rules:
        if r.kind in ("range", "set"):
            bad = F.coalesce(_violated(r), F.lit(False))
            df = df.withColumn(r.column, F.when(~bad, F.col(r.column))) if as_null else df.filter(~bad)
    return df


def documented(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Q06, Q08: every rule as a row, executable or for information."""
    rows = [(r.contract, r.object, r.column, r.kind, None if r.lo is None else float(r.lo), None if r.hi is None else float(r.hi), [str(m) for m in r.members], r.severity) for r in rules]
    return spark.createDataFrame(rows, "contract string, object string, column string, rule string, lo double, hi double, in_set array<string>, severity string")


def changelog(spark: SparkSession, contracts: Sequence[Mapping]) -> DataFrame:
    """Q10: the entries of sources' changelogs with the fields they add and deprecate."""
    rows = []
    for c in contracts:
        props = {p.get("property"): p.get("value") for p in c.get("customProperties") or []}
        for e in props.get("changelog") or []:
            rows.append((str(c.get("id", "")).split(":")[-1], str(e.get("version", "")), str(e.get("date", "")), e.get("type"), e.get("severity"), list(e.get("added_fields") or []), list(e.get("deprecated_fields") or [])))
    return spark.createDataFrame(rows, "contract string, version string, date string, type string, severity string, added array<string>, deprecated array<string>")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Q10: fields (name, type) between two versions: removed is breaking, retyped too, added is not."""
    a, b = before.select("name", F.col("type").alias("old")), after.select("name", F.col("type").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "retyped")
    out = a.join(b, "name", "full_outer").select("name", "old", "new", kind.alias("kind")).filter("kind IS NOT NULL")
    return out.withColumn("severity", F.when(F.col("kind") == "added", "non-breaking").otherwise("breaking"))
