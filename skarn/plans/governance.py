"""Queries of the governance, inventory, contract, lineage and climate operators over the supplied tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import columns as C
from skarn.operators import checks, climate, contracts, inventory, lineage

NOW = datetime.datetime(2024, 1, 31)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dual_source(spark: SparkSession, d: str) -> DataFrame:
    """orders placed and lines shipped as two feeds of status and day."""
    since = F.lit("1996-01-01").cast("timestamp")
    left = checks.daily_counts(read(spark, d, "orders"), "o_orderstatus", "o_orderdate", since)
    right = checks.daily_counts(read(spark, d, "lineitem"), "l_linestatus", "l_shipdate", since)
    return checks.deviations(left, right, 60.0)


def dual_source_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Customers with urgent orders among all customers."""
    left = read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"))
    return checks.coverage(left, read(spark, d, "customer").select(F.col("c_custkey").alias("key")))


TARGETS = [("click", "36h"), ("error", "2h"), ("login", "40d"), ("purchase", "24 h"), ("signup", "1d"), ("view", "12h"), ("absent", "2h")]


def freshness(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame(TARGETS, "event_type string, threshold string")
    out = checks.freshness(read(spark, d, "events"), "ts", targets, "event_type", F.lit(NOW))
    return out.select("event_type", "threshold", "newest", "lag_s", "lag", "status")


def domain_distribution(spark: SparkSession, d: str) -> DataFrame:
    return checks.distribution(read(spark, d, "orders"), "o_orderstatus")


def domain_violation(spark: SparkSession, d: str) -> DataFrame:
    return checks.outside_domain(read(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


def licences(spark: SparkSession, d: str) -> DataFrame:
    code = F.nullif(F.pmod(F.col("o_orderkey"), F.lit(6)), F.lit(5)).cast("int")
    return checks.licence_report(read(spark, d, "orders").select(code.alias("licence")), "licence")


LINE_RULES = [
    contracts.Rule("c", "lineitem", "l_discount", "range", 0.0, 0.08),
    contracts.Rule("c", "lineitem", "l_tax", "range", 0.0, 0.06, severity="warning"),
    contracts.Rule("c", "lineitem", "l_quantity", "range", 1.0, 45.0),
    contracts.Rule("c", "lineitem", "l_returnflag", "set", members=("A", "N")),
    contracts.Rule("c", "lineitem", "l_shipdate", "required"),
]


def range_rules(spark: SparkSession, d: str) -> DataFrame:
    return contracts.check_rows(read(spark, d, "lineitem"), LINE_RULES)


def uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return contracts.duplicates(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def sentinel_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = contracts.clean(read(spark, d, "lineitem"), LINE_RULES[:3])
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def completeness(spark: SparkSession, d: str) -> DataFrame:
    present = read(spark, d, "orders").filter("o_orderdate < timestamp '1996-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return checks.incomplete(read(spark, d, "customer"), present, ["c_custkey"])


def _stats(spark: SparkSession, d: str, lines: str = "true") -> DataFrame:
    rows = read(spark, d, "lineitem").filter(lines).groupBy("l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string").alias("table"))
    return rows.agg(F.count(F.lit(1)).alias("row_estimate"), F.sum(F.col("l_quantity").cast("long") * 1024).alias("total_bytes")).withColumnsRenamed({"l_returnflag": "system", "l_linestatus": "database"})


def volumetry(spark: SparkSession, d: str) -> DataFrame:
    out = inventory.volume_rollup(_stats(spark, d))
    return out.select("system", "database", "level", "tables", "rows", "bytes", C.gib("bytes").alias("gib"))


def top_tables(spark: SparkSession, d: str) -> DataFrame:
    return inventory.largest(_stats(spark, d), 20).select("system", "database", "table", "total_bytes")


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


def volume_growth(spark: SparkSession, d: str) -> DataFrame:
    """Volumes of what was shipped before two dates, and only discounted lines later."""
    return inventory.growth(_stats(spark, d, "l_shipdate < timestamp '1996-01-01'"), _stats(spark, d, "l_shipdate < timestamp '1998-01-01' AND l_returnflag <> 'R'"))


TEMPLATES = ["brand://Brand#{1-3}1", "brand://Brand#{dd}", "brand://Brand#5", "name://ghost_{AAAA}_{MM}", "brand://Brand_{AAAA}"]


def _templated(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    p = read(spark, d, "part")
    actual = p.select(F.concat(F.lit("brand://"), "p_brand").alias("name")).union(p.select(F.concat(F.lit("name://"), "p_name"))).distinct()
    return inventory.reconcile(actual, inventory.patterns(spark, TEMPLATES))


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    parts = _templated(spark, d)
    out = None
    for kind, df in parts.items():
        df = df.select(F.lit(kind).alias("kind"), "name")
        out = df if out is None else out.unionByName(df)
    return out


def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    return inventory.reconcile_counts(_templated(spark, d))


def register_diff(spark: SparkSession, d: str) -> DataFrame:
    """customers as the inventory, flagged if in debt; those with urgent orders as the declaration."""
    status = F.when(F.col("c_mktsegment") == "MACHINERY", "mort").otherwise("actif")
    inv = read(spark, d, "customer").select(F.col("c_custkey").alias("name"), status.alias("status"), (F.col("c_acctbal") < 0).alias("flagged"))
    return checks.register_gaps(inv, read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("name")))


def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    """Q09: declared columns of three tables against what is there."""
    frames = {"orders": read(spark, d, "orders"), "part": read(spark, d, "part")}
    actual = spark.createDataFrame(checks.frame_columns(frames), "object string, column string, type string")
    declared = spark.createDataFrame(DECLARED, "object string, column string, type string")
    return checks.schema_drift(declared, actual)


DECLARED = [("orders", "o_orderkey", "BIGINT(20)"), ("orders", "o_totalprice", "varchar(10)"), ("orders", "o_comment", "text"), ("part", "p_size", "INT"), ("part", "p_name", "JSON"), ("ghost", "x", "int")]


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What is walked, and what the index knows, from whole tables: documents, against labelled ones and pages."""
    docs = read(spark, d, "documents")
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    walked = docs.select(key.alias("key"), F.col("source").alias("repo"), C.content_hash("text").alias("sha"))
    old = F.when(F.col("toxic") == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    known = docs.join(read(spark, d, "labels").select("doc_id", "quality", "toxic").dropDuplicates(["doc_id"]), "doc_id")
    indexed = known.select(key.alias("key"), F.col("source").alias("repo"), C.content_hash(old).alias("sha"), F.when(F.col("quality") == 0, "v1").otherwise("v2").alias("embed_ver"))
    gone = read(spark, d, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("key"), F.when(F.col("page_id") % 2 == 0, "src0").otherwise("elsewhere").alias("repo"), C.content_hash("html").alias("sha"), F.lit("v2").alias("embed_ver"))
    return walked, indexed.unionByName(gone)


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    """what a run has to index and to delete."""
    from skarn.operators.retrieval import changes

    todo, drop = changes(*snapshots(spark, d), "v2")
    return todo.select(F.lit("index").alias("action"), "key").unionByName(drop.select(F.lit("delete").alias("action"), "key"))


def lineage_enrich(spark: SparkSession, d: str) -> DataFrame:
    """events as runs of jobs, filled from declarations."""
    e = read(spark, d, "events")
    runs = e.select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("job_name"), F.when(F.col("event_id") % 2 == 0, F.array(F.concat(F.lit("own"), F.col("user_id").cast("string")))).otherwise(F.array().cast("array<string>")).alias("inputs"), F.lit(None).cast("array<string>").alias("outputs"), C.json_fields(F.when(F.col("event_id") % 4 == 1, "[1]").otherwise(F.col("props")), "k string, v string").isNotNull().alias("has_props"))
    jobs = spark.createDataFrame([("click", ["raw"], ["c1", "c2"]), ("purchase", ["cart"], ["sales"]), ("view", None, ["pages"])], "job_name string, inputs array<string>, outputs array<string>")
    out = lineage.enrich(runs, jobs)
    return out.select("run_id", "job_name", "has_props", F.array_join("inputs", ",").alias("inputs"), F.array_join(F.coalesce("outputs", F.array()), ",").alias("outputs"))


def daily_extremes(spark: SparkSession, d: str) -> DataFrame:
    out = climate.daily_extremes(read(spark, d, "events"), "user_id", "ts", "value")
    return out.select("station", "date", F.round("tn", 6).alias("tn"), F.round("tx", 6).alias("tx"), F.round("tntxm", 6).alias("tntxm"))


def monthly_extremes(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)"))  # exact means
    out = climate.monthly_extremes(o, "o_orderpriority", "o_orderdate", "o_totalprice")
    return out.withColumns({c: F.col(c).cast("double") for c in ("tnn", "txx", "tmm")})


def absolute_records(spark: SparkSession, d: str) -> DataFrame:
    return climate.absolute_records(read(spark, d, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice")


def record_events(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumn("month", F.month("o_orderdate"))
    return climate.record_events(o, ["o_orderpriority", "month"], "o_orderdate", "o_totalprice")


def baseline_mean(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(12,2)"))  # exact means
    return climate.baseline(o, "o_orderpriority", "o_orderdate", "o_totalprice", 1995, 2001).withColumn("mean", F.col("mean").cast("double"))


def national_indicator(spark: SparkSession, d: str) -> DataFrame:
    stations = [1, 2, 3, 5, 8, 13, 21]
    out = climate.national_indicator(climate.daily_extremes(read(spark, d, "events"), "user_id", "ts", "value"), stations)
    return out.withColumn("indicator", F.round("indicator", 6))


def national_indicator_all(spark: SparkSession, d: str) -> DataFrame:
    """A23 over all stations."""
    return climate.national_indicator(climate.daily_extremes(read(spark, d, "events"), "user_id", "ts", "value")).withColumn("indicator", F.round("indicator", 6))


def first_dates(spark: SparkSession, d: str) -> DataFrame:
    return climate.first_dates(read(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


def rain_by_type(spark: SparkSession, d: str) -> DataFrame:
    out = climate.rain_by_department(read(spark, d, "events"), "ts", "event_type", "value", ["click", "purchase", "view"])
    return out.select("date", *(F.round(c, 4).alias(c) for c in ("click", "purchase", "view")))


def pressure_change(spark: SparkSession, d: str) -> DataFrame:
    hourly = read(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return climate.pressure_change(hourly, "event_type", "h", "n").select("event_type", "h", "n", "change")


def since_midnight(spark: SparkSession, d: str) -> DataFrame:
    out = climate.rain_since_midnight(read(spark, d, "events"), "user_id", "ts", "value")
    return out.select("event_id", F.round("since_midnight", 4).alias("since_midnight"))


def validity_join(spark: SparkSession, d: str) -> DataFrame:
    """orders with the validity period of their priority that holds at their date."""
    o = read(spark, d, "orders")
    years = spark.createDataFrame([(y,) for y in range(1995, 2001)], "y int")
    start, end = F.make_date("y", F.lit(1), F.lit(1)).cast("timestamp"), F.when(F.col("y") < 2000, F.make_timestamp("y", F.lit(12), F.lit(30), F.lit(0), F.lit(0), F.lit(0)))
    history = o.select("o_orderpriority").distinct().crossJoin(F.broadcast(years)).select("o_orderpriority", start.cast("timestamp_ntz").alias("begins"), end.cast("timestamp_ntz").alias("ends"), F.col("y").alias("version"))
    history = history.filter("NOT (o_orderpriority = '5-LOW' AND version = 1997)")
    out = climate.valid_at(o.withColumn("at", F.col("o_orderdate").cast("timestamp_ntz")), "at", history, "o_orderpriority", "begins", "ends")
    return out.select("o_orderkey", F.col("h_version").alias("version"))


def as_of(spark: SparkSession, d: str) -> DataFrame:
    """J14 as of: the last urgent order's price of the same status at each order's date."""
    o = read(spark, d, "orders")
    history = o.filter("o_orderpriority = '1-URGENT'").groupBy("o_orderstatus", "o_orderdate").agg(F.max("o_totalprice").alias("urgent"))
    out = climate.as_of(o.select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderdate", history, "o_orderstatus", "o_orderdate", "urgent")
    return out.select("o_orderkey", "urgent")


def priority_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return climate.prefer(o.filter("o_orderstatus = 'F'"), o.withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


def shard_expansion(spark: SparkSession, d: str) -> DataFrame:
    """rows of each monthly shard that an order's next 40 days touch."""
    o = read(spark, d, "orders")
    names = C.month_names("orders", F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 40))
    return o.select(F.explode(names).alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """days with urgent orders and days with pending ones."""
    o = read(spark, d, "orders").withColumn("k", F.to_date("o_orderdate"))
    s, c = o.filter("o_orderpriority = '1-URGENT'").select("k"), o.filter("o_orderstatus = 'P'").select("k")
    parts = {"only_left": s.distinct().exceptAll(c.distinct()), "only_right": c.distinct().exceptAll(s.distinct()), "both": s.intersect(c), "any": s.union(c).distinct()}
    out = None
    for op, df in parts.items():
        df = df.select(F.lit(op).alias("op"), "k")
        out = df if out is None else out.unionByName(df)
    return out


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    s = e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), "n")


def register_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("domain"))
    return inventory.register_breakdown(rows)


def recent_feed(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last 120 minutes before a time, one for each key, with their age."""
    now = F.lit(datetime.datetime(2024, 1, 15, 12)).cast("timestamp")
    e = read(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp")).filter(C.recent("t", now))
    key = C.dedup_key("user_id", "event_type")
    return e.groupBy(key.alias("key")).agg(F.min(C.age_minutes("t", now)).alias("age_min"))


QUERIES = {
    "F01_dual_source_coherence": dual_source, "F01b_dual_source_coverage": dual_source_coverage, "F02_freshness_by_target": freshness, "F03_domain_distribution": domain_distribution, "F03b_domain_violation": domain_violation,
    "F03c_licences": licences, "F04_range_rules_single_pass": range_rules, "F05_uniqueness": uniqueness, "Q11_sentinel_clean": sentinel_clean, "F06_completeness_anti": completeness, "F07_volumetry_rollup": volumetry,
    "F08_topk": top_orders, "O01_top_tables": top_tables, "J18_growth": volume_growth, "F09_reconcile_theta": reconcile, "A10_reconcile_counts": reconcile_counts, "F10_register_diff": register_diff, "Q09_schema_drift": schema_drift,
    "F11_incremental_diff": incremental_diff, "F12_lineage_enrich": lineage_enrich, "F13_daily_extremes": daily_extremes, "F14_monthly_dated_extremes": monthly_extremes, "A21_absolute_records": absolute_records, "F15_record_events": record_events,
    "F16_baseline_mean": baseline_mean, "A23_national_indicator": national_indicator, "A23_all_stations": national_indicator_all, "A24_first_dates": first_dates, "A25_pivot": rain_by_type, "W06_pressure_change": pressure_change, "W07_since_midnight": since_midnight,
    "F17_temporal_validity_join": validity_join, "J14_as_of": as_of, "F18_priority_fallback": priority_fallback, "F19_shard_expansion": shard_expansion, "F30_set_ops": set_ops, "F31_tumbling": tumbling, "F31b_sessions": sessions,
    "A26_register_cube": register_cube, "P41_recent_feed": recent_feed,
}

_DAILY = "SELECT {1} AS key, CAST({2} AS DATE) AS day, count(*) AS n FROM {0} WHERE {2} >= TIMESTAMP '1996-01-01' GROUP BY ALL"
_STATS = "SELECT l_returnflag AS system, l_linestatus AS database, CAST(l_suppkey AS VARCHAR) AS tbl, count(*) AS row_estimate, CAST(sum(CAST(trunc(l_quantity) AS BIGINT) * 1024) AS BIGINT) AS total_bytes FROM lineitem WHERE {} GROUP BY ALL"
_NAMES = "WITH a AS (SELECT 'brand://' || p_brand AS name FROM part UNION SELECT 'name://' || p_name FROM part), r(name, pattern) AS (VALUES {}), hit AS (SELECT a.name AS a, r.name AS r FROM a JOIN r ON regexp_matches(a.name, r.pattern)) "
_NAMES = _NAMES.format(", ".join(f"('{t}', '{C.template_regex(t)}')" for t in TEMPLATES))
_LAG = "date_diff('microsecond', newest, TIMESTAMP '2024-01-31') // 1000000"
#: Half-up mean of cents at 6 decimals, in integers.
_MEAN = "((2 * CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) * 100 AS BIGINT) * 10000 + count(*)) // (2 * count(*)))::DOUBLE / 1000000.0::DOUBLE"
_EXTREMES = "min({v}) AS tnn, CAST(arg_min(CAST(o_orderdate AS DATE), (o_totalprice, o_orderdate)) AS DATE) AS tnn_date, max({v}) AS txx, CAST(arg_max(CAST(o_orderdate AS DATE), (o_totalprice, -epoch(o_orderdate))) AS DATE) AS txx_date".format(v="o_totalprice")

SNAPSHOTS = """w AS (SELECT source || '/' || doc_id AS key, source AS repo, sha256(text) AS sha FROM documents),
    k AS (SELECT doc_id, any_value(quality) AS quality, any_value(toxic) AS toxic FROM labels GROUP BY 1),
    x AS (SELECT source || '/' || doc_id AS key, source AS repo, sha256(CASE WHEN toxic = 1 THEN text || 'x' ELSE text END) AS sha, CASE WHEN quality = 0 THEN 'v1' ELSE 'v2' END AS embed_ver FROM documents JOIN k USING (doc_id)
      UNION ALL SELECT 'page/' || page_id, CASE WHEN page_id % 2 = 0 THEN 'src0' ELSE 'elsewhere' END, sha256(html), 'v2' FROM pages),
    t AS (SELECT w.*, x.key IS NOT NULL AS old FROM w LEFT JOIN x USING (key) WHERE w.sha IS DISTINCT FROM x.sha OR x.embed_ver IS DISTINCT FROM 'v2'),
    g AS (SELECT key FROM t WHERE old UNION SELECT key FROM x WHERE key NOT IN (SELECT key FROM w) AND repo IN (SELECT repo FROM w))"""
_FAMILY = "CASE WHEN regexp_matches(lower({0}), '^(bigint|int)') THEN 'int' WHEN regexp_matches(lower({0}), '^(double)') THEN 'float' WHEN regexp_matches(lower({0}), '^(varchar|text|string)') THEN 'text' ELSE '?' || lower({0}) END"

ORACLE_SQL = {
    "F01_dual_source_coherence": f"WITH a AS ({_DAILY.format('orders', 'o_orderstatus', 'o_orderdate')}), b AS ({_DAILY.format('lineitem', 'l_linestatus', 'l_shipdate')}) SELECT key, day, a.n AS left_n, b.n AS right_n, round(100.0 * abs(a.n - b.n) / greatest(a.n, b.n), 4)::DOUBLE AS deviation_pct FROM a JOIN b USING (key, day) WHERE 100.0 * abs(a.n - b.n) / greatest(a.n, b.n) > 60",
    "F01b_dual_source_coverage": "WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT c_custkey AS key FROM customer) SELECT count(*) AS right_keys, count(a.key) AS common_keys, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0 * count(a.key)::DOUBLE / count(*), 4) END AS coverage_pct FROM b LEFT JOIN a USING (key)",
    "F02_freshness_by_target": f"""WITH t(event_type, threshold) AS (VALUES {", ".join(map(str, TARGETS))}), m AS (SELECT event_type, max(ts) AS newest FROM events GROUP BY 1),
        j AS (SELECT t.*, newest, {_LAG} AS lag_s, CAST(regexp_extract(threshold, '^([0-9]+)', 1) AS BIGINT) * CASE WHEN threshold LIKE '%h' THEN 3600 ELSE 86400 END AS lim FROM t LEFT JOIN m USING (event_type))
        SELECT event_type, threshold, newest, lag_s, CASE WHEN lag_s < 0 THEN 'ahead' WHEN lag_s >= 86400 THEN (lag_s // 86400) || 'j ' || ((lag_s % 86400) // 3600) || 'h' ELSE (lag_s // 3600) || 'h' || lpad(CAST((lag_s % 3600) // 60 AS VARCHAR), 2, '0') END AS lag,
        CASE WHEN newest IS NULL THEN 'stale' WHEN lag_s < 0 THEN 'ahead' WHEN lag_s > lim THEN 'stale' ELSE 'ok' END AS status FROM j""",
    "F03_domain_distribution": "SELECT o_orderstatus AS value, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total, round(100.0 * count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share_pct FROM orders GROUP BY 1",
    "F03b_domain_violation": "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1",
    "F03c_licences": "WITH l AS (SELECT CAST(nullif(o_orderkey % 6, 5) AS INTEGER) AS value FROM orders) SELECT value, CASE value WHEN 0 THEN 'open' WHEN 1 THEN 'commercial' WHEN 2 THEN 'non-commercial' WHEN 3 THEN 'never' ELSE CASE WHEN value IS NULL THEN 'none' ELSE 'unknown' END END AS label, count(*) AS n, round(100.0 * count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share_pct, coalesce(value <> 3, false) AS exposed, value IS NULL OR value IN (0, 1, 2, 3) AS in_domain FROM l GROUP BY value",
    "F04_range_rules_single_pass": """WITH s AS (SELECT count(*) AS n_rows, count(*) FILTER (l_discount < 0 OR l_discount > 0.08) AS a, count(*) FILTER (l_tax < 0 OR l_tax > 0.06) AS b, count(*) FILTER (l_quantity < 1 OR l_quantity > 45) AS c, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS d, count(*) FILTER (l_shipdate IS NULL) AS e FROM lineitem)
        SELECT 'range' AS rule, 'l_discount' AS column, 'error' AS severity, n_rows, a AS violations FROM s UNION ALL SELECT 'range', 'l_tax', 'warning', n_rows, b FROM s UNION ALL SELECT 'range', 'l_quantity', 'error', n_rows, c FROM s UNION ALL SELECT 'set', 'l_returnflag', 'error', n_rows, d FROM s UNION ALL SELECT 'required', 'l_shipdate', 'error', n_rows, e FROM s""",
    "F05_uniqueness": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "Q11_sentinel_clean": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_discount BETWEEN 0 AND 0.08 AND l_tax BETWEEN 0 AND 0.06 AND l_quantity BETWEEN 1 AND 45 GROUP BY 1",
    "F06_completeness_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')",
    "F07_volumetry_rollup": f"WITH s AS ({_STATS.format('true')}) SELECT system, database, CAST(grouping(system, database) AS INTEGER) AS level, count(*) AS tables, CAST(sum(row_estimate) AS BIGINT) AS rows, CAST(sum(total_bytes) AS BIGINT) AS bytes, round(sum(total_bytes)::DOUBLE / 1073741824.0, 2) AS gib FROM s GROUP BY ROLLUP (system, database)",
    "F08_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "O01_top_tables": f'WITH s AS ({_STATS.format("true")}) SELECT system, database, tbl AS "table", total_bytes FROM s ORDER BY total_bytes DESC, system, database, tbl LIMIT 20',
    "J18_growth": f"""WITH a AS ({_STATS.format("l_shipdate < TIMESTAMP '1996-01-01'")}), b AS ({_STATS.format("l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag <> 'R'")})
        SELECT system, database, tbl AS "table", CASE WHEN a.total_bytes IS NULL THEN 'new' WHEN b.total_bytes IS NULL THEN 'gone' ELSE 'kept' END AS change, coalesce(b.total_bytes, 0) - coalesce(a.total_bytes, 0) AS bytes, coalesce(b.row_estimate, 0) - coalesce(a.row_estimate, 0) AS rows FROM a FULL JOIN b USING (system, database, tbl)""",
    "F09_reconcile_theta": _NAMES + "SELECT 'matched' AS kind, name FROM a WHERE name IN (SELECT a FROM hit) UNION ALL SELECT 'orphans', name FROM a WHERE name NOT IN (SELECT a FROM hit) UNION ALL SELECT 'ghosts', name FROM r WHERE name NOT IN (SELECT r FROM hit)",
    "A10_reconcile_counts": _NAMES + "SELECT 'matched' AS kind, count(*) AS n FROM a WHERE name IN (SELECT a FROM hit) UNION ALL SELECT 'orphans', count(*) FROM a WHERE name NOT IN (SELECT a FROM hit) UNION ALL SELECT 'ghosts', count(*) FROM r WHERE name NOT IN (SELECT r FROM hit)",
    "F10_register_diff": """WITH i AS (SELECT c_custkey AS name, c_acctbal < 0 AS flag, c_mktsegment = 'MACHINERY' AS dead FROM customer), c AS (SELECT DISTINCT o_custkey AS name, true AS dec FROM orders WHERE o_orderpriority = '1-URGENT'),
        j AS (SELECT name, CASE WHEN flag AND dec IS NULL THEN 'missing' WHEN dec AND NOT coalesce(flag, false) THEN CASE WHEN dead THEN 'tolerated' ELSE 'extra' END END AS kind FROM i FULL JOIN c USING (name)) SELECT * FROM j WHERE kind IS NOT NULL""",
    "F11_incremental_diff": f"WITH {SNAPSHOTS} SELECT 'index' AS action, key FROM t UNION ALL SELECT 'delete', key FROM g",
    "F12_lineage_enrich": "SELECT CAST(event_id AS VARCHAR) AS run_id, event_id % 4 <> 1 AND json_type(props) = 'OBJECT' AS has_props, event_type AS job_name, CASE WHEN event_id % 2 = 0 THEN 'own' || user_id ELSE CASE event_type WHEN 'click' THEN 'raw' WHEN 'purchase' THEN 'cart' ELSE '' END END AS inputs, CASE event_type WHEN 'click' THEN 'c1,c2' WHEN 'purchase' THEN 'sales' WHEN 'view' THEN 'pages' ELSE '' END AS outputs FROM events",
    "F13_daily_extremes": "SELECT user_id AS station, CAST(ts AS DATE) AS date, round(min(value), 6) AS tn, round(max(value), 6) AS tx, round((min(value) + max(value)) / 2, 6) AS tntxm FROM events GROUP BY ALL",
    "F14_monthly_dated_extremes": f"SELECT o_orderpriority AS station, strftime(o_orderdate, '%Y-%m') AS month, {_EXTREMES}, {_MEAN} AS tmm FROM orders GROUP BY 1, 2",
    "A21_absolute_records": f"SELECT o_orderpriority AS station, CAST(month(o_orderdate) AS INTEGER) AS month, {_EXTREMES} FROM orders GROUP BY 1, 2",
    "F15_record_events": """WITH d AS (SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS record_value FROM orders GROUP BY ALL),
        p AS (SELECT *, max(record_value) OVER (PARTITION BY o_orderpriority, month ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_record_value FROM d) SELECT * FROM p WHERE record_value > previous_record_value""",
    "F16_baseline_mean": f"SELECT o_orderpriority AS station, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, count(*) AS sample_count, {_MEAN} AS mean FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY ALL",
    "A23_national_indicator": "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, (min(value) + max(value)) / 2 AS m FROM events WHERE user_id IN (1, 2, 3, 5, 8, 13, 21) GROUP BY ALL) SELECT date, round(avg(m), 6) AS indicator, count(*) AS stations, count(*) < 7 AS is_fictive FROM d GROUP BY date",
    "A23_all_stations": "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, (min(value) + max(value)) / 2 AS m FROM events GROUP BY ALL) SELECT date, round(avg(m), 6) AS indicator, count(*) AS stations, false AS is_fictive FROM d GROUP BY date",
    "A24_first_dates": "SELECT o_custkey AS station, min(CAST(o_orderdate AS DATE)) AS first_date FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1",
    "A25_pivot": "SELECT CAST(ts AS DATE) AS date, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase, round(sum(value) FILTER (event_type = 'view'), 4) AS \"view\" FROM events GROUP BY 1",
    "W06_pressure_change": "WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL) SELECT a.event_type, a.h, a.n, a.n - b.n AS change FROM h a LEFT JOIN h b ON a.event_type = b.event_type AND b.h = a.h - INTERVAL 3 HOUR",
    "W07_since_midnight": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts), 4) AS since_midnight FROM events",
    "F17_temporal_validity_join": """WITH h AS (SELECT p AS pr, y, make_timestamp(y, 1, 1, 0, 0, 0) AS a, CASE WHEN y < 2000 THEN make_timestamp(y, 12, 30, 0, 0, 0) END AS b FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT unnest(range(1995, 2001)) AS y) WHERE NOT (p = '5-LOW' AND y = 1997))
        SELECT o_orderkey, CAST(y AS INTEGER) AS version FROM orders LEFT JOIN h ON o_orderpriority = pr AND o_orderdate >= a AND (b IS NULL OR o_orderdate <= b)""",
    "J14_as_of": "WITH u AS (SELECT o_orderstatus AS s, o_orderdate AS t, max(o_totalprice) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL) SELECT o_orderkey, urgent FROM orders ASOF LEFT JOIN u ON o_orderstatus = s AND o_orderdate >= t",
    "F18_priority_fallback": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS o_totalprice, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS INTEGER) AS priority FROM orders",
    "F19_shard_expansion": "SELECT 'orders_' || strftime(m, '%Y_%m') AS shard, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', CAST(o_orderdate AS DATE) + 40), INTERVAL 1 MONTH)) AS m FROM orders) GROUP BY 1",
    "F30_set_ops": """WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS k FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS k FROM orders WHERE o_orderstatus = 'P')
        SELECT 'only_left' AS op, k FROM (SELECT k FROM s EXCEPT SELECT k FROM c) UNION ALL SELECT 'only_right', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'both', k FROM (SELECT k FROM s INTERSECT SELECT k FROM c) UNION ALL SELECT 'any', k FROM (SELECT k FROM s UNION SELECT k FROM c)""",
    "F31_tumbling": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "F31b_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, s",
    "A26_register_cube": "SELECT o_orderstatus AS status, o_orderpriority AS domain, CAST(grouping(o_orderstatus, o_orderpriority) AS INTEGER) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "P41_recent_feed": "SELECT md5(user_id || '|' || event_type) AS key, CAST(min(date_diff('microsecond', ts, TIMESTAMP '2024-01-15 12:00:00') // 60000000) AS INTEGER) AS age_min FROM events WHERE ts > TIMESTAMP '2024-01-15 10:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1",
    "Q09_schema_drift": f"""WITH d(object, "column", type) AS (VALUES {", ".join(map(str, DECLARED))}), a AS (SELECT table_name AS object, column_name AS "column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE lower(data_type) END AS actual_type FROM information_schema.columns WHERE table_name IN ('orders', 'part')),
        j AS (SELECT d.*, actual_type, CASE WHEN object NOT IN (SELECT object FROM a) THEN 'absent_table' WHEN actual_type IS NULL THEN 'absent_column' WHEN {_FAMILY.format('type')} <> {_FAMILY.format('actual_type')} THEN 'family_mismatch' END AS status FROM d LEFT JOIN a USING (object, "column")) SELECT * FROM j WHERE status IS NOT NULL""",
}
