"""Queries of the operators that work on registers, files, code and index rows, over such rows made from the supplied tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import columns as C
from skarn.operators import checks, chunking, climate, contracts, graph, inventory, lineage
from skarn.operators import retrieval as R
from skarn.plans.governance import NOW, SNAPSHOTS, read, snapshots
from skarn.plans.scratch import shared_dir
from skarn.sources import files as files_
from skarn.sources import registers, reports, tables

TODAY = datetime.date(2026, 6, 17)
FILES = 10_000  # sources that a task reads


def _fp(c: Column | str) -> Column:
    """md5 of a text, so that results stay small."""
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def template_names(spark: SparkSession, d: str) -> DataFrame:
    """Physical names of templates on each order's day."""
    t = F.when(F.col("o_orderstatus") == "F", "obs_{AAAA}{MM} (archive)").when(F.col("o_orderstatus") == "O", "day_d{1|2|3}").otherwise("x_{HH}_{MM}")
    o = read(spark, d, "orders").withColumn("t", t)
    return o.select("o_orderkey", C.concrete_name("t", "o_orderdate").alias("name"), C.concrete_or_null("t", "o_orderdate").alias("testable"))


def names(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts as tables and as code."""
    p = read(spark, d, "part").withColumn("path", F.replace("p_type", F.lit(" "), F.lit("/"))).withColumn("ns", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(""))
    first = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name"))
    second = F.when(F.col("p_size") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand"))
    p = p.withColumn("first", first).withColumn("second", second)
    return p.select("p_partkey", C.qualified("p_brand", F.lit("db"), F.concat(F.when(F.col("p_size") % 2 == 0, "public.").otherwise(""), "p_name")).alias("qualified"), C.subsystem("p_brand", "path").alias("subsystem"), C.node_id("p_brand", "path", "p_size", "p_name").alias("node"), C.full_name("ns", "p_name").alias("full_name"), C.entry_label("first", "second").alias("label"))


_HOST, _PATH = r"^https?://([^/?#]+)", r"^https?://[^/?#]+/([^?#]*)"


def links(spark: SparkSession, d: str) -> DataFrame:
    """pages' hosts as git remotes."""
    p = read(spark, d, "pages").select("page_id", F.regexp_extract("url", _HOST, 1).alias("h"), F.regexp_extract("url", _PATH, 1).alias("p"))
    k = F.col("page_id") % 4
    remote = F.when(k == 0, F.concat(F.lit("git@"), "h", F.lit(":"), "p", F.lit(".git"))).when(k == 1, F.concat(F.lit("https://me@"), "h", F.lit("/"), "p", F.lit(".git"))).when(k == 2, F.concat(F.lit("ssh://git@"), "h", F.lit(":22/"), "p")).otherwise(F.concat(F.lit("ftp://"), "h"))
    p = p.withColumn("remote", remote).withColumn("base", C.web_base("remote"))
    ref = F.when(F.col("page_id") % 5 == 0, "").otherwise("main")
    return p.select("page_id", "base", C.permalink("base", ref, F.lit("a/b.py"), F.col("page_id"), F.col("page_id") + 2).alias("link"), C.source_class("remote", {"example.com": "com", "example.net": "net"}).alias("class"))


def _as_files(spark: SparkSession, d: str) -> DataFrame:
    k, j = F.col("doc_id") % 5, F.col("doc_id") % 7
    ext = F.when(k == 0, ".min.js").when(k == 1, ".py").when(k == 2, ".MD").when(k == 3, ".toml").otherwise("")
    folder = F.when(j == 0, "vendor/").when(j == 1, "a/node_modules/").otherwise("src/")
    return read(spark, d, "documents").withColumn("path", F.concat(folder, "lang", F.col("doc_id").cast("string"), ext))


def file_filters(spark: SparkSession, d: str) -> DataFrame:
    """What a walk says of each document as a file."""
    raw = F.col("text").cast("binary")
    return _as_files(spark, d).select("doc_id", C.excluded("path", ["vendor"], ["*.MD"]).alias("excluded"), C.is_binary(raw).alias("is_binary"), C.minified("path", "text").alias("minified"), files_.language(F.col("path")).alias("language"), C.content_hash(raw).alias("sha"), _fp(C.decode_lenient(raw)).alias("decoded"), _fp(C.clip("text", 100)).alias("clipped"))


def supported_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files that have a code graph."""
    rows = _as_files(spark, d).withColumn("lang", files_.language(F.col("path")))
    return files_.supported(rows).select("doc_id", "lang")


def first_files(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 files by key, which is the feature."""
    return files_.first_files(_as_files(spark, d).select(F.concat(F.col("source"), F.lit("/"), "path").alias("key")), 25)


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as chunks with their structural context."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("repo"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("turn"), F.col("turn").cast("string"))).alias("symbol"), (F.col("turn") + 1).alias("start_line"), (F.col("turn") + 3).alias("end_line"), F.lit(100).alias("chunks"), "text")
    out = chunking.contextualise(c.withColumn("key", F.concat("repo", F.lit("/"), "path")))
    return out.select("conv_id", "turn", "context", _fp("contextualized").alias("contextualized"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Numbered turns of each conversation while they fit."""
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("chunk"), F.coalesce("text", F.lit("")).alias("text"))
    return chunking.listing(c, 2000).select("key", _fp("listing").alias("listing"))


def statuses(spark: SparkSession, d: str) -> DataFrame:
    """Age, penalty and flag of labelled documents."""
    rows = read(spark, d, "labels").withColumn("status", F.when(F.col("quality") == 0, "mort").when(F.col("toxic") == 1, "douteux").otherwise("actif"))
    last = F.when(F.col("doc_id") % 11 == 0, "unknown").otherwise(F.date_format(F.date_sub(F.lit(TODAY), (F.col("doc_id") % 2000).cast("int")), "yyyy-MM-dd"))
    rows, today = rows.withColumn("last", last), F.lit(TODAY)
    return rows.select("doc_id", F.round(C.age_years("last", today), 6).alias("age"), C.rank_penalty("status", "last", today).alias("penalty"), C.display_flag("status", "last", today).alias("flag"))


def units(spark: SparkSession, d: str) -> DataFrame:
    """Units, and distances between customers placed by their numbers."""
    c = read(spark, d, "customer")
    lat, lon = F.col("c_nationkey") * 3.0 - 40, (F.col("c_custkey") % 180).cast("double")
    return c.select("c_custkey", *(F.round(C.convert("c_acctbal", a, b), 5).alias(n) for n, a, b in (("celsius", "K", "C"), ("kmh", "m/s", "km/h"), ("hpa", "Pa", "hPa"), ("wh", "J/cm2", "Wh/m2"), ("cm", "m", "cm"))), F.round(C.haversine_km(lat, lon, F.lit(48.85), F.lit(2.35)), 4).alias("km"))


def packed_fields(spark: SparkSession, d: str) -> DataFrame:
    """Packed fields and JSON, some of it broken, of events."""
    k = F.col("event_id") % 6
    props = F.when(k == 0, "abc").when(k == 1, "[1]").when(k == 2, '{"k": 1').otherwise(F.col("props"))
    e = read(spark, d, "events").withColumn("p", props).withColumn("f", C.json_fields("p", "k int"))
    parts = C.packed(F.concat("event_type", F.lit(" @ "), F.col("user_id").cast("string"), F.lit("@@ x")))
    return e.select("event_id", F.array_join(parts, "|").alias("parts"), F.col("f.k").alias("k"), F.col("f").isNotNull().alias("is_object"))


def filters(spark: SparkSession, d: str) -> DataFrame:
    """Rows of documents, lines and events by the filters of a search, of tiers and of retention."""
    docs = read(spark, d, "documents").withColumn("repo", F.col("source")).filter(C.search_filter(["src0", "src3"], "en")).agg(F.lit("searched").alias("kind"), F.count(F.lit(1)).alias("n"))
    tiers = read(spark, d, "lineitem").groupBy(C.tier(F.col("l_discount") * 10).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kept = read(spark, d, "events").filter(C.retained("ts", F.lit(NOW).cast("timestamp_ntz"), 20)).agg(F.lit("retained").alias("kind"), F.count(F.lit(1)).alias("n"))
    return docs.unionByName(tiers).unionByName(kept)


def status_tally(spark: SparkSession, d: str) -> DataFrame:
    """A09."""
    return inventory.status_tally(read(spark, d, "orders").select(F.col("o_orderpriority").alias("system"), F.col("o_orderstatus").alias("status")))


def treatment_tables(spark: SparkSession, d: str) -> DataFrame:
    """Customers as treatments of the parts they ordered."""
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("tables"))
    return checks.treatment_tables(t)


def last_commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the log of their customers."""
    return files_.last_commits(read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("path"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")))


def status_map(spark: SparkSession, d: str) -> DataFrame:
    """The last status of each customer and priority."""
    return files_.status_map(read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderpriority").alias("script"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("status")))


def link_stations(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers as historic and live stations, some under a new number."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("num"), F.col("c_acctbal").alias("old_value"))
    s = read(spark, d, "supplier").select(F.concat(F.lit(" "), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("live"), F.col("s_acctbal").alias("value"))
    remap = read(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("old_id"), (F.col("n_nationkey") + 40).alias("new_id"))
    return climate.link_stations(c, s, "num", "live", remap).select("station", "num", "old_value", "value")


def closure(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pipelines from their number's dataset to those of twice it and three times it and one."""
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(name(F.col("p_partkey"))).alias("inputs"), F.array(name(F.col("p_partkey") * 2), name(F.col("p_partkey") * 3 + 1)).alias("outputs"))
    return inventory.lineage_closure(inventory.pipeline_edges(p), ["d1"])


def required_targets(spark: SparkSession, d: str) -> DataFrame:
    """Nations of customers, all of which the catalogue of nations has."""
    wanted = read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return checks.require_targets(wanted, read(spark, d, "nation"), ["n_nationkey"])


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """Documents with what their labels and sources say."""
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("repo"))
    known = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("last_commit"), F.when(F.col("toxic") == 1, "douteux").alias("status"))
    repos = read(spark, d, "documents").filter("lang = 'fr'").select(F.col("source").alias("repo")).distinct().withColumn("source", F.upper("repo"))
    return R.attach_metadata(docs, known, repos).select("key", "repo", "last_commit", "status", "source")


def hypertables(spark: SparkSession, d: str) -> DataFrame:
    """brands' first names as hypertables, all parts as plain tables, some of them chunks."""
    p = read(spark, d, "part")
    hyper = p.groupBy(F.col("p_brand").alias("database")).agg(F.min("p_name").alias("table")).withColumn("chunks", F.lit(1))
    plain = p.select(F.col("p_brand").alias("database"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("_hyper_"), "p_name")).otherwise(F.col("p_name")).alias("table"))
    return inventory.hypertables_and_plain(hyper, plain)


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 1, F.concat(F.lit("## "), x)).otherwise(x))
    return read(spark, d, "documents").select(F.col("source").alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("markdown").alias("lang"), F.concat(F.lit("# doc\n"), F.array_join(lines, "\n")).alias("text"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a title and headings as Markdown."""
    return chunking.chunk_files(_markdown(spark, d), "docs", 1 << 30).select("path", "chunk", "start_line", "end_line", _fp("text").alias("fingerprint"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Regions as registers of their nations."""
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.concat(F.lit("  - name: "), "n_name", F.lit("\n    key: "), F.col("n_nationkey").cast("string"))
    text = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))).alias("es")).select(F.lit("r").alias("repo"), F.concat(F.lit("inventory/"), "r_name", F.lit(".yaml")).alias("path"), F.lit("yaml").alias("lang"), F.concat(F.lit("# nations\ntables:\n"), F.array_join(F.transform("es", lambda x: x["e"]), "\n")).alias("text"))
    return chunking.chunk_files(text, "docs").select("path", "chunk", "start_line", "end_line", "text")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """A Python file for each part: a class under that of half its number, and a function that calls the next one's.

    The table is small for the work its files make, so its keys are spread over tasks by their number, not by bytes.
    """
    parts = read(spark, d, "part").select("p_partkey")
    n = parts.count()
    parts = parts.repartition(max(1, n // FILES, min(spark.sparkContext.defaultParallelism, n // 50)), "p_partkey")
    k = F.col("p_partkey").cast("string")
    base = F.when(F.col("p_partkey") > 1, F.concat(F.lit("(C"), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit(")"))).otherwise("")
    text = F.concat(F.lit("class C"), k, base, F.lit(":\n    def own"), k, F.lit("(self):\n        return self.own1()\n\ndef f"), k, F.lit("(x):\n    return f"), (F.col("p_partkey") + 1).cast("string"), F.lit("(x)\n"))
    return parts.select(F.lit("r").alias("repo"), F.concat(F.lit("p"), k, F.lit(".py")).alias("path"), F.lit("python").alias("lang"), text.alias("text"))


def code_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of the parts' sources."""
    return graph.nodes_of(graph.extract(_sources(spark, d))).select("id", "name", "kind", "start_line", "end_line")


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the parts' sources, up their class hierarchy and by name."""
    return graph.resolve(graph.extract(_sources(spark, d)))[1].select("src", "dst", "conf")


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A chunk for each definition of the parts' sources."""
    return chunking.chunk_files(_sources(spark, d)).select("path", "chunk", "chunks", "start_line", "end_line", _fp("text").alias("fingerprint"))


def enclosing(spark: SparkSession, d: str) -> DataFrame:
    """The declaration in force at each line of the parts' sources."""
    f = _sources(spark, d)
    lines = f.select(F.concat("repo", F.lit("/"), "path").alias("key"), F.posexplode(F.split("text", "\n")).alias("n", "line")).select("key", (F.col("n") + 1).alias("start_line"))
    return chunking.enclosing_symbols(f, lines).select("key", "start_line", "symbol")


def blocked(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts with too many definitions, or too many calls by lines."""
    p = read(spark, d, "part")
    nodes = p.select(F.col("p_name").alias("name"), F.lit("function").alias("kind"))
    calls = read(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("callee"))
    return graph.blocked_names(nodes, calls, 30, 500)


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    q = F.concat("p_brand", F.lit("."), "p_name")
    return p.select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), q.alias("qname"), q.alias("fqn"), F.col("p_brand").alias("repo"), F.concat("p_type", F.lit(".py")).alias("path"), F.lit("python").alias("lang"), F.lit("function").alias("kind"), F.col("p_size").alias("start_line"), F.lit(0.0).alias("centrality"), F.lit(None).cast("array<string>").alias("bases"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """What three ways to name parts resolve to."""
    nodes = _symbols(spark, d)
    low = nodes.agg(F.min("name").alias("name"), F.min("qname").alias("q"), F.min("path").alias("path")).first()
    asked = {"name": low["name"], "full": low["q"], "case": low["q"].upper(), "file": low["path"]}
    out = None
    for how, symbol in asked.items():
        rows, scope = graph.roots_of(nodes, symbol)
        rows = rows.select(F.lit(how).alias("how"), F.lit(scope).alias("scope"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def impact_result(spark: SparkSession, d: str) -> DataFrame:
    """The impact of part 1 within two steps of the orders' graph, by tier, cut at 40 as the feature has it."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    edges = graph.dedup_edges(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.round(F.col("l_quantity") / 50, 2).alias("conf")))
    ids = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")).union(read(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))))
    nodes = ids.select("id", F.col("id").alias("name"), F.col("id").alias("qname"), F.col("id").alias("fqn"), F.substring("id", 1, 1).alias("repo"), F.lit("x").alias("path"), F.lit("sql").alias("lang"), F.lit("function").alias("kind"), F.lit(1).alias("start_line"), F.lit(0.0).alias("centrality"), F.lit(None).cast("array<string>").alias("bases"))
    out = graph.impact(nodes, edges, "p1")
    rows = [(r["id"], r["tier"], r["subsystem"], r["depth"], out["truncated"]) for r in out["impacted"]]
    return spark.createDataFrame(rows, "id string, tier string, subsystem string, depth int, truncated boolean")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """The index after a run, which knew the labelled documents, some as they were, and pages that are gone."""
    walked, indexed = snapshots(spark, d)
    todo, drop = R.changes(walked, indexed, "v2")
    return R.upsert(indexed, todo.withColumn("embed_ver", F.lit("v2")), drop).select("key", "repo", "sha", "embed_ver")


CONTRACT = {
    "id": "urn:c:shop",
    "schema": [
        {"name": "lineitem", "properties": [
            {"name": "l_orderkey", "primaryKey": True}, {"name": "l_linenumber", "primaryKey": True}, {"name": "l_tax", "quality": [{"mustBeBetween": [0, 0.06], "severity": "warning"}]},
            {"name": "l_returnflag", "quality": [{"mustBeIn": ["A", "N"]}]},
        ], "quality": [{"rule": "uniqueness"}, {"rule": "documented"}]},
        {"name": "events", "properties": [{"name": "event_id", "unique": True, "required": True}, {"name": "ts", "quality": [{"rule": "freshness", "threshold": "36h", "severity": "critical"}]}]},
        {"name": "orders", "properties": [{"name": "o_custkey", "quality": [{"rule": "completeness"}]}]},
        {"name": "ghost", "properties": [{"name": "x", "required": True}]},
    ],
}


def contract_run(spark: SparkSession, d: str) -> DataFrame:
    """Q01-Q08: every rule of a contract, one row each."""
    got = {t: read(spark, d, t) for t in ("lineitem", "events", "orders")}
    expected = {"orders": read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))}
    return contracts.run(got, contracts.rules_of(CONTRACT), expected, F.lit(NOW))


def documented_rules(spark: SparkSession, d: str) -> DataFrame:
    """Q06, Q08: the contract's rules as rows, one for each nation that signs it."""
    rules = contracts.documented(spark, contracts.rules_of(CONTRACT)).groupBy("object", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))
    return read(spark, d, "nation").agg(F.count(F.lit(1)).alias("signers")).crossJoin(rules)


def field_diff(spark: SparkSession, d: str) -> DataFrame:
    """Q10: the columns of customers and suppliers as two versions of one schema."""
    fields = lambda t: spark.createDataFrame([(n.split("_", 1)[1], k) for n, k in read(spark, d, t).dtypes], "name string, type string")
    return contracts.schema_diff(fields("customer"), fields("supplier"))


def stored_table(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders appended to those of low priority, then without those that are pending, as a versioned table."""
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority", "o_orderstatus")
    tables.append(o.filter("o_orderpriority = '5-LOW'"), path)
    tables.append(o.filter("o_orderpriority = '1-URGENT'"), path)
    tables.delete_keys(spark, path, o.filter("o_orderstatus = 'P'").select("key"))
    return tables.open_table(spark, path)


def csv_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Volumes written as a CSV inventory and scanned again."""
    path = f"{shared_dir(spark)}/inventory-{uuid.uuid4().hex}"
    stats = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("database"), F.col("l_suppkey").cast("string").alias("table")).agg(F.count(F.lit(1)).alias("row_estimate"), F.sum(F.col("l_quantity").cast("long")).alias("data_bytes"))
    reports.write_inventory_csv(stats.withColumn("index_bytes", F.lit(0).cast("long")).withColumn("total_bytes", F.col("data_bytes")).withColumn("extra", F.lit(None).cast("string")), path)
    return registers.inventory_csv(spark, path).select("system", "database", "table", "row_estimate", "data_bytes", "total_bytes")


def _run_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "START").when(F.col("event_id") % 7 == 1, "FAIL").otherwise("COMPLETE")
    run = F.struct(F.floor(F.col("event_id") / 2).cast("string").alias("runId"))
    at = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    value = F.to_json(F.struct(kind.alias("eventType"), at.alias("eventTime"), run.alias("run"), F.struct(F.lit("ns").alias("namespace"), F.lit("job").alias("name")).alias("job")))
    return e.select("event_id", F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(value).alias("value"))


def run_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of run events, a tenth of them broken."""
    out = lineage.events_frame(_run_events(spark, d))
    return out.groupBy("eventType", F.col("corrupt").isNotNull().alias("is_corrupt")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run.runId").alias("runs"))


def paired_runs(spark: SparkSession, d: str) -> DataFrame:
    """Survey 2.11: START with COMPLETE or FAIL of each run, in batch; a test holds the stream against it."""
    out = lineage.pair_runs(lineage.events_frame(_run_events(spark, d)).filter("corrupt IS NULL"))
    return out.select("run_id", "state", F.round("seconds", 3).alias("seconds"))


def fused(spark: SparkSession, d: str) -> DataFrame:
    """The dearest and the newest orders of all, fused by rank; top lists are the feature."""
    o = read(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    a = R.ranked(o.orderBy(F.desc("o_totalprice"), "id").limit(200), [F.desc("o_totalprice"), "id"])
    b = R.ranked(o.orderBy(F.desc("o_orderdate"), "id").limit(200), [F.desc("o_orderdate"), "id"])
    return R.rrf(a, b, 50).select("id", F.round("score", 9).alias("score"))


QUERIES = {
    "P07_P08_template_names": template_names, "P13_P34_names": names, "P27_P29_links": links, "P03_P23_file_filters": file_filters, "S13_supported_files": supported_files, "O06_first_files": first_files, "P20_P21_contexts": contexts,
    "P22_listings": listings, "P24_P26_statuses": statuses, "P36_P37_units": units, "P38_P39_packed_fields": packed_fields, "P02_P30_P42_filters": filters, "A09_status_tally": status_tally, "A11_treatment_tables": treatment_tables,
    "A18_last_commits": last_commits, "J09_status_map": status_map, "J16_link_stations": link_stations, "J19_closure": closure, "J07_required_targets": required_targets, "J08_metadata": metadata, "S06_O08_hypertables": hypertables,
    "T03_sections": sections, "T04_entries": entries, "G03_code_nodes": code_nodes, "G06_G07_code_edges": code_edges, "T06_code_chunks": code_chunks, "P19_W04_enclosing": enclosing, "A12_G05_blocked": blocked, "G11_symbols": symbols,
    "G15_impact": impact_result, "T10_upsert": upserted, "Q04_Q08_contract": contract_run, "Q06_documented": documented_rules, "Q10_field_diff": field_diff, "K07_K08_stored_table": stored_table, "K01_S04_csv_inventory": csv_inventory,
    "P44_run_events": run_events, "P44_paired_runs": paired_runs, "J13_rank_fusion": fused,
}

_FILES = "f AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'a/node_modules/' ELSE 'src/' END || lang || doc_id || CASE doc_id % 5 WHEN 0 THEN '.min.js' WHEN 1 THEN '.py' WHEN 2 THEN '.MD' WHEN 3 THEN '.toml' ELSE '' END AS path FROM documents)"
_MINIFIED = "(doc_id % 5 = 0 OR doc_id % 7 IN (0, 1) OR len(list_filter(string_split(text, chr(10))[1:50], lambda x: length(x) > 2000)) > 0)"
_LANG = "CASE doc_id % 5 WHEN 0 THEN 'js' WHEN 1 THEN 'python' WHEN 2 THEN 'markdown' WHEN 3 THEN 'toml' ELSE 'text' END"
_SYMBOLS = "n AS (SELECT 'n' || p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS q, p_type || '.py' AS path FROM part), low AS (SELECT min(name) AS name, min(q) AS q, min(path) AS path FROM n)"
_RUNS = "e AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'START' WHEN event_id % 7 = 1 THEN 'FAIL' ELSE 'COMPLETE' END AS kind, event_id // 2 AS run, event_id % 10 = 3 AS bad FROM events)"

ORACLE_SQL = {
    "P07_P08_template_names": """WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'obs_' || strftime(o_orderdate, '%Y%m') WHEN 'O' THEN 'day_d' || least((day(o_orderdate) - 1) // 10 + 1, 3) ELSE 'x_{HH}_' || strftime(o_orderdate, '%m') END AS name FROM orders)
        SELECT o_orderkey, name, CASE WHEN name NOT LIKE '%{%' THEN name END AS testable FROM t""",
    "P13_P34_names": """SELECT p_partkey, p_brand || '://db/' || p_name AS qualified, p_brand || '/' || string_split(p_type, ' ')[1] AS subsystem, p_brand || '/' || replace(p_type, ' ', '/') || ':' || p_size || ':' || p_name AS node,
        CASE WHEN p_size % 3 = 0 THEN p_brand || '\\' || p_name ELSE p_name END AS full_name, CASE WHEN p_size % 2 <> 0 THEN p_name WHEN p_size % 5 <> 0 THEN p_brand ELSE '?' END AS label FROM part""",
    "P27_P29_links": f"""WITH p AS (SELECT page_id, regexp_extract(url, '{_HOST}', 1) AS h, regexp_extract(url, '{_PATH}', 1) AS p FROM pages),
        c AS (SELECT *, page_id % 4 AS k, CASE WHEN page_id % 4 = 2 THEN regexp_replace(p, '(\\.git)?/?$', '') ELSE p END AS path FROM p),
        b AS (SELECT *, CASE WHEN k = 3 OR path = '' THEN '' ELSE 'https://' || h || '/' || path END AS base FROM c)
        SELECT page_id, base, CASE WHEN base = '' OR page_id % 5 = 0 THEN '' ELSE base || '/-/blob/main/a/b.py#L' || page_id || '-' || (page_id + 2) END AS link,
        CASE WHEN contains(h, 'example.com') THEN 'com' WHEN contains(h, 'example.net') THEN 'net' ELSE 'other' END AS class FROM b""",
    "P03_P23_file_filters": f"""WITH {_FILES} SELECT doc_id, doc_id % 7 = 0 OR doc_id % 5 = 2 AS excluded, contains(text[:1024], chr(0)) AS is_binary, {_MINIFIED} AS minified, {_LANG} AS language, sha256(text) AS sha,
        CASE WHEN regexp_matches(text, '\\S') THEN md5(text) END AS decoded, md5(text[:100]) AS clipped FROM f""",
    "S13_supported_files": f"WITH {_FILES} SELECT doc_id, {_LANG} AS lang FROM f WHERE doc_id % 5 IN (0, 1) AND trim(text, ' ') <> '' AND NOT {_MINIFIED}",
    "O06_first_files": f"WITH {_FILES} SELECT source || '/' || path AS key FROM f ORDER BY 1 LIMIT 25",
    "P20_P21_contexts": """WITH c AS (SELECT *, '[repo ' || role || ' | file c' || conv_id || CASE WHEN turn % 2 = 0 THEN '' ELSE ' | in turn' || turn END || ' | lines ' || (turn + 1) || '-' || (turn + 3) || '/100]' AS context FROM conversations)
        SELECT conv_id, turn, context, md5(context || chr(10) || chr(10) || text) AS contextualized FROM c""",
    "P22_listings": """WITH l AS (SELECT CAST(conv_id AS VARCHAR) AS key, turn, '[' || turn || '] ' || coalesce(text, '') AS line FROM conversations), s AS (SELECT *, sum(length(line)) OVER (PARTITION BY key ORDER BY turn ROWS UNBOUNDED PRECEDING) AS so_far FROM l)
        SELECT key, md5(string_agg(line, chr(10) ORDER BY turn)) AS listing FROM s WHERE so_far <= 2000 GROUP BY key""",
    "P24_P26_statuses": """WITH s AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'mort' WHEN toxic = 1 THEN 'douteux' ELSE 'actif' END AS status, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 2000) / 365.25::DOUBLE END AS y FROM labels)
        SELECT doc_id, round(y, 6) AS age, CASE status WHEN 'mort' THEN 100 WHEN 'douteux' THEN 2 ELSE -1 END::DOUBLE + CASE WHEN y < 1 THEN -1 WHEN y > 3 THEN 2 WHEN y > 2 THEN 1 ELSE 0 END AS penalty, status || CASE WHEN y > 2 THEN ' ~' || CAST(floor(y) AS BIGINT) || 'a' ELSE '' END AS flag FROM s""",
    "P36_P37_units": """WITH c AS (SELECT *, radians(c_nationkey * 3.0::DOUBLE - 40) AS a, radians((c_custkey % 180)::DOUBLE) AS o, radians(48.85::DOUBLE) AS b, radians(2.35::DOUBLE) AS q FROM customer)
        SELECT c_custkey, round(c_acctbal - 273.15::DOUBLE, 5) AS celsius, round(c_acctbal * 3.6::DOUBLE, 5) AS kmh, round(c_acctbal * 0.01::DOUBLE, 5) AS hpa, round(c_acctbal * (10000.0::DOUBLE / 3600.0::DOUBLE), 5) AS wh, round(c_acctbal * 100.0::DOUBLE, 5) AS cm,
        round(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin((q - o) / 2), 2))), 4) AS km FROM c""",
    "P38_P39_packed_fields": """SELECT event_id, event_type || '|' || user_id || '|x' AS parts, CASE WHEN event_id % 6 > 2 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, event_id % 6 > 2 AND json_type(props) = 'OBJECT' AS is_object FROM events""",
    "P02_P30_P42_filters": """SELECT 'searched' AS kind, count(*) AS n FROM documents WHERE source IN ('src0', 'src3') AND lang = 'en' UNION ALL SELECT CASE WHEN l_discount * 10 >= 0.8 THEN 'certain' WHEN l_discount * 10 >= 0.5 THEN 'probable' ELSE 'incertain' END, count(*) FROM lineitem GROUP BY 1
        UNION ALL SELECT 'retained', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY""",
    "A09_status_tally": "SELECT o_orderpriority AS system, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL",
    "A11_treatment_tables": "SELECT count(DISTINCT l_suppkey) AS n_tables FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "A18_last_commits": "SELECT CAST(o_custkey AS VARCHAR) AS path, strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d') AS last_commit FROM orders GROUP BY o_custkey",
    "J09_status_map": "SELECT o_custkey || '/' || o_orderpriority AS key, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "J16_link_stations": "WITH c AS (SELECT c_custkey AS num, c_acctbal AS old_value, coalesce(n_nationkey + 40, c_custkey) AS id FROM customer LEFT JOIN nation ON c_custkey = n_nationkey + 1) SELECT lpad(CAST(id AS VARCHAR), 8, '0') AS station, num, old_value, s_acctbal AS value FROM c JOIN supplier ON id = s_suppkey",
    "J19_closure": "WITH RECURSIVE c(k, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT unnest([k * 2, k * 3 + 1]), depth + 1 FROM c JOIN part ON p_partkey = k) SELECT 'd' || k AS name, CAST(min(depth) AS INTEGER) AS depth FROM c WHERE k <> 1 GROUP BY k",
    "J07_required_targets": "SELECT DISTINCT c_nationkey AS n_nationkey FROM customer",
    "J08_metadata": """WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS key, coalesce('q' || quality, '') AS last_commit, CASE WHEN toxic = 1 THEN 'douteux' ELSE '' END AS status FROM labels), r AS (SELECT DISTINCT source AS repo FROM documents WHERE lang = 'fr')
        SELECT CAST(doc_id AS VARCHAR) AS key, d.source AS repo, coalesce(last_commit, '') AS last_commit, coalesce(status, '') AS status, coalesce(upper(r.repo), '') AS source FROM documents d LEFT JOIN l ON l.key = CAST(doc_id AS VARCHAR) LEFT JOIN r ON r.repo = d.source""",
    "S06_O08_hypertables": """WITH h AS (SELECT p_brand AS database, min(p_name) AS tbl FROM part GROUP BY 1) SELECT database, tbl AS "table", 1 AS chunks FROM h
        UNION ALL SELECT p_brand, p_name, NULL FROM part WHERE p_size % 4 <> 0 AND (p_brand, p_name) NOT IN (SELECT (database, tbl) FROM h)""",
    "T03_sections": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
        m AS (SELECT doc_id, n + 1 AS n, CASE WHEN n % 4 = 2 THEN '## ' || t ELSE t END AS t FROM l UNION ALL SELECT doc_id, 1, '# doc' FROM documents),
        h AS (SELECT *, sum((regexp_matches(t, '^#{1,4}\\s'))::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM m),
        g AS (SELECT doc_id, s, CAST(min(n) AS INTEGER) AS start_line, CAST(max(n) AS INTEGER) AS end_line, trim(string_agg(t, chr(10) ORDER BY n), chr(10)) AS body FROM h GROUP BY doc_id, s)
        SELECT doc_id || '.md' AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk, start_line, end_line, md5(body) AS fingerprint FROM g WHERE regexp_matches(body, '\\S')""",
    "T04_entries": """WITH e AS (SELECT r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT 'inventory/' || r_name || '.yaml' AS path, CAST(i AS INTEGER) AS chunk, CAST(3 + 2 * i AS INTEGER) AS start_line, CAST(4 + 2 * i AS INTEGER) AS end_line,
        '# inventory/' || r_name || '.yaml | tables: ' || n_name || chr(10) || '  - name: ' || n_name || chr(10) || '    key: ' || n_nationkey AS text FROM e""",
    "G03_code_nodes": """SELECT 'r/p' || p_partkey || '.py:1:C' || p_partkey AS id, 'C' || p_partkey AS name, 'class' AS kind, 1 AS start_line, 3 AS end_line FROM part
        UNION ALL SELECT 'r/p' || p_partkey || '.py:2:C' || p_partkey || '.own' || p_partkey, 'own' || p_partkey, 'method', 2, 3 FROM part UNION ALL SELECT 'r/p' || p_partkey || '.py:5:f' || p_partkey, 'f' || p_partkey, 'function', 5, 6 FROM part""",
    "G06_G07_code_edges": """SELECT 'r/p' || p_partkey || '.py:2:C' || p_partkey || '.own' || p_partkey AS src, 'r/p1.py:2:C1.own1' AS dst, 0.95::DOUBLE AS conf FROM part WHERE p_partkey > 1
        UNION ALL SELECT 'r/p' || a.p_partkey || '.py:5:f' || a.p_partkey, 'r/p' || b.p_partkey || '.py:5:f' || b.p_partkey, 0.9 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
        UNION ALL SELECT 'r/p0.py:2:C0.own0', 'r/p1.py:2:C1.own1', 0.6 FROM part WHERE p_partkey = 0 AND (SELECT count(*) FROM part) <= 200""",
    "T06_code_chunks": """WITH t AS (SELECT p_partkey AS k, 'class C' || p_partkey || CASE WHEN p_partkey > 1 THEN '(C' || (p_partkey // 2) || ')' ELSE '' END || ':' || chr(10) || '    def own' || p_partkey || '(self):' || chr(10) || '        return self.own1()' AS a, 'def f' || p_partkey || '(x):' || chr(10) || '    return f' || (p_partkey + 1) || '(x)' AS b FROM part)
        SELECT 'p' || k || '.py' AS path, 0 AS chunk, 2 AS chunks, 1 AS start_line, 3 AS end_line, md5(a) AS fingerprint FROM t UNION ALL SELECT 'p' || k || '.py', 1, 2, 4, 6, md5(b) FROM t""",
    "P19_W04_enclosing": "SELECT 'r/p' || p_partkey || '.py' AS key, CAST(n AS INTEGER) AS start_line, CASE WHEN n = 1 THEN 'C' WHEN n < 5 THEN 'own' ELSE 'f' END || p_partkey AS symbol FROM part, (SELECT unnest(range(1, 8)) AS n)",
    "A12_G05_blocked": "SELECT p_name AS name FROM part GROUP BY 1 HAVING count(*) > 30 UNION SELECT p_type FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) > 500",
    "G11_symbols": f"""WITH {_SYMBOLS} SELECT 'name' AS how, 'symbol' AS scope, id FROM n JOIN low ON n.name = low.name UNION ALL SELECT 'full', 'symbol', id FROM n JOIN low ON n.q = low.q
        UNION ALL SELECT 'case', 'symbol', id FROM n JOIN low ON lower(n.q) = lower(low.q) UNION ALL SELECT 'file', 'file', id FROM n JOIN low ON ends_with(n.path, low.path)""",
    "G15_impact": """WITH raw AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, max(round(l_quantity / 50, 2)) AS conf FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
        r AS (SELECT src AS id, CASE WHEN conf >= 0.8 THEN 'certain' WHEN conf >= 0.5 THEN 'probable' ELSE 'incertain' END AS tier FROM raw WHERE dst = 'p1')
        SELECT id, tier, 'c/x' AS subsystem, 1 AS depth, (SELECT count(*) FROM r) > 40 AS truncated FROM r ORDER BY CASE tier WHEN 'certain' THEN 0 WHEN 'probable' THEN 1 ELSE 2 END, id LIMIT 40""",
    "T10_upsert": f"WITH {SNAPSHOTS} SELECT key, repo, sha, embed_ver FROM x WHERE key NOT IN (SELECT key FROM g) UNION ALL SELECT key, repo, sha, 'v2' FROM t",
    "Q04_Q08_contract": """WITH l AS (SELECT count(*) AS n, count(*) FILTER (l_tax < 0 OR l_tax > 0.06) AS tax, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS flag, count(*) FILTER (l_orderkey IS NULL) AS k, count(*) FILTER (l_linenumber IS NULL) AS ln, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS twice FROM lineitem),
        e AS (SELECT count(*) AS n, count(*) FILTER (event_id IS NULL) AS miss, count(*) - count(DISTINCT event_id) AS twice, (TIMESTAMP '2024-01-31' - max(ts) > INTERVAL 36 HOUR)::INT AS late FROM events),
        o AS (SELECT (SELECT count(*) FROM orders) AS n, count(*) AS miss FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)),
        r AS (SELECT 'lineitem' AS object, 'l_orderkey' AS column, 'required' AS rule, 'error' AS severity, n AS n_rows, k AS violations FROM l UNION ALL SELECT 'lineitem', 'l_linenumber', 'required', 'error', n, ln FROM l UNION ALL SELECT 'lineitem', 'l_tax', 'range', 'warning', n, tax FROM l
          UNION ALL SELECT 'lineitem', 'l_returnflag', 'set', 'error', n, flag FROM l UNION ALL SELECT 'lineitem', 'l_orderkey,l_linenumber', 'unique', 'error', n, twice FROM l UNION ALL SELECT 'events', 'event_id', 'required', 'error', n, miss FROM e
          UNION ALL SELECT 'events', 'event_id', 'unique', 'error', n, twice FROM e UNION ALL SELECT 'events', 'ts', 'freshness', 'critical', n, late FROM e UNION ALL SELECT 'orders', 'o_custkey', 'completeness', 'error', n, miss FROM o)
        SELECT *, CASE WHEN violations > 0 THEN 'violated' ELSE 'ok' END AS status FROM r UNION ALL SELECT 'lineitem', 'l_orderkey,l_linenumber', 'documented', 'error', NULL, NULL, 'documented' UNION ALL SELECT 'ghost', 'x', 'required', 'error', NULL, NULL, 'no table'""",
    "Q06_documented": """SELECT (SELECT count(*) FROM nation) AS signers, * FROM (VALUES ('lineitem', 'required', 'error', 2::BIGINT), ('lineitem', 'range', 'warning', 1), ('lineitem', 'set', 'error', 1), ('lineitem', 'unique', 'error', 1), ('lineitem', 'documented', 'error', 1),
        ('events', 'required', 'error', 1), ('events', 'unique', 'error', 1), ('events', 'freshness', 'critical', 1), ('orders', 'completeness', 'error', 1), ('ghost', 'required', 'error', 1)) t(object, rule, severity, n)""",
    "Q10_field_diff": """WITH f AS (SELECT table_name AS t, regexp_extract(column_name, '^[^_]*_(.*)$', 1) AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS type FROM information_schema.columns WHERE table_name IN ('customer', 'supplier')),
        a AS (SELECT name, type AS old FROM f WHERE t = 'customer'), b AS (SELECT name, type AS new FROM f WHERE t = 'supplier'), j AS (SELECT name, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'retyped' END AS kind FROM a FULL JOIN b USING (name))
        SELECT *, CASE WHEN kind = 'added' THEN 'non-breaking' ELSE 'breaking' END AS severity FROM j WHERE kind IS NOT NULL""",
    "K07_K08_stored_table": "SELECT o_orderkey AS key, o_orderpriority, o_orderstatus FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT') AND o_orderstatus <> 'P'",
    "K01_S04_csv_inventory": """SELECT l_returnflag AS system, l_linestatus AS database, CAST(l_suppkey AS VARCHAR) AS "table", count(*) AS row_estimate, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS data_bytes, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS total_bytes FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey""",
    "P44_run_events": f"WITH {_RUNS} SELECT CASE WHEN NOT bad THEN kind END AS \"eventType\", bad AS is_corrupt, count(*) AS n, count(DISTINCT CASE WHEN NOT bad THEN run END) AS runs FROM e GROUP BY ALL",
    "P44_paired_runs": f"""WITH {_RUNS}, p AS (SELECT run, max(CASE WHEN kind <> 'START' THEN kind END) AS k, min(CASE WHEN kind = 'START' THEN date_trunc('millisecond', ts) END) AS a, max(CASE WHEN kind <> 'START' THEN date_trunc('millisecond', ts) END) AS b FROM e WHERE NOT bad GROUP BY run)
        SELECT CAST(run AS VARCHAR) AS run_id, coalesce(k, 'open') AS state, round(date_diff('microsecond', a, b) / 1000000.0::DOUBLE, 3) AS seconds FROM p""",
    "J13_rank_fusion": """WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 200), b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders QUALIFY r <= 200),
        f AS (SELECT id, coalesce(1::DOUBLE / (60 + a.r), 0) + coalesce(1::DOUBLE / (60 + b.r), 0) AS s FROM a FULL JOIN b USING (id)) SELECT id, round(s, 9) AS score FROM f ORDER BY s DESC, id LIMIT 50""",
}
