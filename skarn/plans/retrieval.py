"""Queries of the retrieval and graph operators over the supplied tables."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import chunking, graph
from skarn.operators import retrieval as R
from skarn.plans.governance import read

K = 20
TODAY = datetime.date(2026, 6, 17)
WORDS = "the and that thing eau der"
#: A fixed query vector; the oracle gets the same literals.
QUERY = [round(float(x), 4) for x in np.random.default_rng(11).standard_normal(64)]


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    out = R.vector_search(read(spark, d, "embeddings"), QUERY, K, id_="vec_id", vector="embedding")
    return out.select("vec_id", F.round("distance", 5).alias("distance"))


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    out = R.vector_search(read(spark, d, "embeddings"), QUERY, K, F.col("label").isin(1, 3, 5), "vec_id", "embedding")
    return out.select("vec_id", "label", F.round("distance", 5).alias("distance"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(read(spark, d, "documents"), WORDS, K, id_="doc_id", text="text").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    """All documents and all vectors, joined where they have the same number."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("contextualized"), F.col("source").alias("repo"), "lang").join(e, "id", "full_outer")


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid_search(_index(spark, d), WORDS, QUERY, K, pool=60).select("id", "rank", "text_rank", F.round("score", 8).alias("score"))


def meta_rerank(spark: SparkSession, d: str) -> DataFrame:
    """the longest documents, reranked by a status and a date taken from their labels."""
    docs = read(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(3 * K)
    status = F.when(F.col("quality") == 0, "mort").when(F.col("toxic") == 1, "douteux").when(F.col("quality") == 1, "actif").otherwise("")
    rows = R.ranked(docs, [F.desc("n_chars"), "doc_id"]).join(read(spark, d, "labels"), "doc_id", "left")
    rows = rows.withColumn("status", status).withColumn("last_commit", F.date_format(F.date_sub(F.lit(TODAY), (F.col("doc_id") % 1500).cast("int")), "yyyy-MM-dd"))
    return R.meta_rerank(rows, K, F.lit(TODAY)).select("doc_id", "rank", "status", F.round("place", 4).alias("place"))


def dry_run(spark: SparkSession, d: str) -> DataFrame:
    return R.dry_run_cost(read(spark, d, "documents")).select("chunks", "chars", "tokens", F.round("usd", 8).alias("usd"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.paragraphs(read(spark, d, "documents"))
    return out.select("doc_id", "part", "start_line", F.md5(F.col("text").cast("binary")).alias("fingerprint"))


def char_windows(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "lang", "text")
    return chunking.chunk_files(files, "windows").select("key", "chunk", "start_line", "end_line", F.length("text").alias("chars"))


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and the parts they ordered as a graph; confidence from the quantity of a line."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    raw = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.round(F.col("l_quantity") / 50, 2).alias("conf"))
    nodes = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).union(read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    return nodes, graph.dedup_edges(raw)


def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)[1]


def fan_in(spark: SparkSession, d: str) -> DataFrame:
    return graph.fan_in(_edges(spark, d)[1])


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _edges(spark, d)
    rows = nodes.join(graph.fan_in(edges), "id", "left").fillna(0, ["fan_in"])
    rows = rows.select("id", "fan_in", F.lit("function").alias("kind"), F.substring("id", 1, 1).alias("repo"), F.lit("x").alias("path"), F.lit("sql").alias("lang"), F.lit(0.0).alias("centrality"))
    return graph.hotspots(rows, "fan_in", 20).select("id", "fan_in", "subsystem")


def impact(spark: SparkSession, d: str) -> DataFrame:
    """who is within two steps of three parts, both ways, over edges of at least 0.5."""
    _, edges = _edges(spark, d)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "conf"))
    seeds = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "id string")
    return graph.reach(both, seeds, "callers", 2, 0.5)


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(*_edges(spark, d))


def build_stats(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _edges(spark, d)
    return graph.build_stats(nodes.withColumn("fqn", F.col("id")), edges)


def resolve_all(spark: SparkSession, d: str) -> DataFrame:
    """Every part a definition in its brand, every line a call of its part's name from there, by graph.resolve and its limits."""
    p = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("repo"), F.lit("part").alias("path"), F.lit("sql").alias("lang"), F.lit("").alias("ns"), F.col("p_name").alias("name"))
    defs = p.withColumns({"fact": F.lit("def"), "qname": F.col("name"), "kind": F.lit("function"), "start_line": F.col("p_partkey").cast("int"), "end_line": F.col("p_partkey").cast("int")})
    calls = read(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("repo", "path", "lang", "ns", F.lit("call").alias("fact"), F.col("name").alias("callee"), F.lit("member").alias("rkind"), F.lit("").alias("caller"))
    facts = defs.drop("p_partkey").unionByName(calls, allowMissingColumns=True)
    missing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in graph.FACTS.split(", ") if c.split()[0] not in facts.columns}
    return graph.resolve(facts.withColumns(missing))[1].select("src", "dst", "conf")


QUERIES = {
    "F20_vector_topk": vector_topk, "T11_filtered_vector_topk": vector_topk_filtered, "F21_bm25_topk": bm25_topk, "F22_hybrid_rrf": hybrid, "F23_meta_rerank": meta_rerank, "A17_dry_run_cost": dry_run, "F24_sections": paragraphs, "F25_char_windows": char_windows,
    "F26_edge_dedup": edge_dedup, "A13_fan_in": fan_in, "O02_hotspots": hotspots, "F27_bfs_impact": impact, "F28_pagerank": pagerank, "A16_build_stats": build_stats, "F29_G04_cascade": resolve_all,
}

_Q = "[" + ", ".join(map(str, QUERY)) + "]"
_DIST = f"1 - list_sum(list_transform(list_zip(embedding, {_Q}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({_Q}, lambda x: x::DOUBLE * x::DOUBLE))))"


def _bm25(docs: str) -> str:
    wanted = ", ".join(f"'{w}'" for w in sorted(set(WORDS.split())))
    return f"""bt AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM ({docs})),
    bl AS (SELECT id, len(t) AS length, list_filter(t, lambda x: x IN ({wanted})) AS t FROM bt), bs AS (SELECT count(*) AS n, avg(length) AS avg_length FROM bl),
    btf AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, length, unnest(t) AS term FROM bl) GROUP BY ALL), bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY 1),
    bm AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 9) AS score FROM btf JOIN bdf USING (term), bs GROUP BY id)"""


_RAW = "raw AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, max(round(l_quantity / 50, 2)) AS conf FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
_NODES = "nodes AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'p' || p_partkey FROM part)"


def _pagerank_sql(iterations: int = 20) -> str:
    """Unrolled: each step is a materialised CTE."""
    ctes = [_RAW, _NODES, "w AS MATERIALIZED (SELECT src, dst, conf / sum(conf) OVER (PARTITION BY src) AS weight FROM raw)", "n AS (SELECT count(*) AS n FROM nodes)", "r0 AS MATERIALIZED (SELECT id, id NOT IN (SELECT src FROM raw) AS dangling, 1.0::DOUBLE / n AS r FROM nodes, n)"]
    for i in range(1, iterations + 1):
        ctes.append(f"r{i} AS MATERIALIZED (SELECT r.id, dangling, 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE dangling) / n + 0.85::DOUBLE * coalesce(m.x, 0) AS r FROM r{i - 1} r CROSS JOIN n LEFT JOIN (SELECT dst AS id, sum(r * weight) AS x FROM r{i - 1} JOIN w ON id = src GROUP BY dst) m ON r.id = m.id)")
    return f"WITH {', '.join(ctes)} SELECT id, round(r, 7) AS centrality FROM r{iterations}"


ORACLE_SQL = {
    "F20_vector_topk": f"SELECT vec_id, round({_DIST}, 5) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT {K}",
    "T11_filtered_vector_topk": f"SELECT vec_id, label, round({_DIST}, 5) AS distance FROM embeddings WHERE label IN (1, 3, 5) ORDER BY {_DIST}, vec_id LIMIT {K}",
    "F21_bm25_topk": f"WITH {_bm25('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT {K}",
    "F22_hybrid_rrf": f"""WITH i AS (SELECT coalesce(doc_id, vec_id) AS id, coalesce(text, '') AS text, embedding FROM documents FULL JOIN embeddings ON doc_id = vec_id), {_bm25("SELECT id, text FROM i")},
        a AS (SELECT id, row_number() OVER (ORDER BY dd, id) AS rank FROM (SELECT id, {_DIST} AS dd FROM i WHERE embedding IS NOT NULL ORDER BY dd, id LIMIT 60)), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS text_rank FROM (SELECT * FROM bm ORDER BY score DESC, id LIMIT 60)),
        f AS (SELECT id, CAST(rank AS INTEGER) AS rank, CAST(text_rank AS INTEGER) AS text_rank, coalesce(1::DOUBLE / (60 + rank), 0) + coalesce(1::DOUBLE / (60 + text_rank), 0) AS s FROM a FULL JOIN b USING (id)) SELECT id, rank, text_rank, round(s, 8) AS score FROM f ORDER BY s DESC, id LIMIT {K}""",
    "F23_meta_rerank": f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT {3 * K}),
        s AS (SELECT d.doc_id, rank, CASE WHEN quality = 0 THEN 'mort' WHEN toxic = 1 THEN 'douteux' WHEN quality = 1 THEN 'actif' ELSE '' END AS status, (d.doc_id % 1500) / 365.25::DOUBLE AS y FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
        p AS (SELECT *, rank - 1 + CASE status WHEN 'mort' THEN 100 WHEN 'douteux' THEN 2 WHEN 'actif' THEN -1 ELSE 0 END + CASE WHEN y < 1 THEN -1 WHEN y > 3 THEN 2 WHEN y > 2 THEN 1 ELSE 0 END AS place FROM s)
        SELECT doc_id, CAST(rank AS INTEGER) AS rank, status, round(place, 4)::DOUBLE AS place FROM p ORDER BY place, rank LIMIT {K}""",
    "A17_dry_run_cost": "SELECT count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens, round((sum(length(text)) // 4)::DOUBLE * 0.15 / 1000000.0, 8) AS usd FROM documents",
    "F24_sections": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS part, CAST(n AS INTEGER) AS start_line, md5(t) AS fingerprint FROM l WHERE trim(t, ' ') <> ''",
    "F26_edge_dedup": f"WITH {_RAW} SELECT * FROM raw",
    "A13_fan_in": f"WITH {_RAW} SELECT dst AS id, count(*) AS fan_in FROM raw GROUP BY 1",
    "O02_hotspots": f"WITH {_RAW}, {_NODES} SELECT id, count(dst) AS fan_in, left(id, 1) || '/x' AS subsystem FROM nodes LEFT JOIN raw ON id = dst GROUP BY id ORDER BY 2 DESC, id LIMIT 20",
    "F27_bfs_impact": f"""WITH {_RAW}, b AS (SELECT * FROM (SELECT src AS a, dst AS b, conf FROM raw UNION ALL SELECT dst, src, conf FROM raw) WHERE conf >= 0.5), l0(id, depth, path) AS (VALUES ('p1', 0, 1.0::DOUBLE), ('p2', 0, 1.0), ('p3', 0, 1.0)),
        l1 AS (SELECT id, min(depth) AS depth, max(path) AS path FROM (SELECT * FROM l0 UNION ALL SELECT b.b, 1, least(path, conf) FROM l0 JOIN b ON id = a) GROUP BY id),
        l2 AS (SELECT id, min(depth) AS depth, max(path) AS path FROM (SELECT * FROM l1 UNION ALL SELECT b.b, 2, least(path, conf) FROM l1 JOIN b ON id = a WHERE depth = 1) GROUP BY id) SELECT id, CAST(depth AS INTEGER) AS depth, path AS conf FROM l2 WHERE depth > 0""",
    "F28_pagerank": _pagerank_sql(),
    "A16_build_stats": f"WITH {_RAW}, {_NODES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT id) FROM nodes) AS fqns, count(*) AS edges, count(*) FILTER (conf >= 0.7) AS strong FROM raw",
    "F29_G04_cascade": """WITH calls AS (SELECT p_name AS name, p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), defs AS (SELECT p_name AS name, p_brand AS brand, p_brand || '/part:' || p_partkey || ':' || p_name AS dst FROM part),
        blocked AS (SELECT name FROM defs GROUP BY 1 HAVING count(*) > 6 UNION SELECT name FROM calls GROUP BY 1 HAVING sum(n) > 200), one AS (SELECT name, brand, min(dst) AS dst FROM defs GROUP BY ALL HAVING count(*) = 1), hom AS (SELECT name, dst, count(*) OVER (PARTITION BY name) AS h FROM defs),
        f AS (SELECT name, brand, dst, 6 AS step, 0.9::DOUBLE AS conf FROM calls JOIN one USING (name, brand) UNION ALL SELECT calls.name, brand, dst, CASE WHEN h = 1 THEN 8 ELSE 9 END, CASE WHEN h = 1 THEN 0.6 ELSE 0.35 END::DOUBLE FROM calls JOIN hom ON calls.name = hom.name WHERE calls.name NOT IN (SELECT name FROM blocked)),
        best AS (SELECT * FROM f QUALIFY step = min(step) OVER (PARTITION BY name, brand))
        SELECT brand || '/part:1:<module>' AS src, dst, max(conf) AS conf FROM best GROUP BY ALL""",
}
