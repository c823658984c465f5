import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skarn.functions import columns as C
from skarn.operators import checks, chunking, climate, contracts, graph, inventory
from skarn.operators import retrieval as R


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


# ---------------------------------------------------------------- scalar functions


def test_names_and_thresholds(spark):
    d = F.lit("2024-03-31").cast("date")
    r = one(spark, a=C.concrete_name(F.lit("t_{AAAA}_{MM}_d{1|2|3} (three a month)"), d), b=C.concrete_or_null(F.lit("t_{dd}"), d), c=C.threshold_seconds(F.lit("36 h")), e=C.lag_text(F.lit(90_000)), f=C.lag_text(F.lit(-1)), g=C.lag_text(F.lit(3_660)), m=C.month_names("p", F.lit("2023-12-31").cast("date"), d))
    assert (r.a, r.b, r.c, r.e, r.f, r.g, r.m) == ("t_2024_03_d3", None, 129_600, "1j 1h", "ahead", "1h01", ["p_2023_12", "p_2024_01", "p_2024_02", "p_2024_03"])
    with pytest.raises(Exception, match="invalid threshold"):
        one(spark, a=C.threshold_seconds(F.lit("soon")))


def test_paths(spark):
    rows = spark.createDataFrame([("a/vendor/x.py",), ("vendor",), ("a/b/skip_1.py",), ("lock.json",), ("a/b.py",)], "p string")
    got = [r.x for r in rows.select(C.excluded("p", ["vendor"], ["skip_*", "lock.json", "a/*[!y]"]).alias("x")).collect()]
    assert got == [True, False, True, True, False]
    r = one(spark, a=C.web_base(F.lit("git@hub.example:o/r.git")), b=C.web_base(F.lit("https://u:p@h/x/y.git")), c=C.web_base(F.lit("/local")), d=C.permalink(F.lit("https://github.com/o/r"), F.lit("main"), F.lit("p"), F.lit(1), F.lit(2)), e=C.permalink(F.lit("https://x/o"), F.lit("main"), F.lit("p"), F.lit(1), F.lit(2)), f=C.permalink(F.lit(""), F.lit("m"), F.lit("p"), F.lit(1), F.lit(2)))
    assert tuple(r) == ("https://hub.example/o/r", "https://h/x/y", "", "https://github.com/o/r/blob/main/p#L1-L2", "https://x/o/-/blob/main/p#L1-2", "")


def test_values(spark):
    today = F.lit("2026-06-17").cast("date")
    r = one(spark, k=C.convert(F.lit(300.0), "K", "C"), h=C.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), p=C.packed(F.lit("a@ @b")), n=C.packed(F.lit(None).cast("string")), y=C.age_years(F.lit("bad"), today), q=C.rank_penalty(F.lit("mort"), F.lit(None).cast("string"), today), s=C.rank_penalty(F.lit("actif"), F.lit("2026-01-01"), today), f=C.display_flag(F.lit("douteux"), F.lit("2020-01-01"), today), t=C.tier(F.lit(0.5)), g=C.type_family(F.lit("VARCHAR(9)")), u=C.type_family(F.lit("Weird")))
    assert abs(r.k - 26.85) < 1e-9 and abs(r.h - np.pi * 6371) < 1e-6
    assert (r.p, r.n, r.y, r.q, r.s, r.f, r.t, r.g, r.u) == (["a", "b"], [], None, 100.0, -2.0, "douteux ~6a", "probable", "text", "?weird")
    with pytest.raises(KeyError):
        C.convert(F.lit(1), "K", "hPa")
    lic = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,)], "c int").select(C.exposable("c"), C.exportable("c", True), C.exportable("c", False)).collect()
    assert [tuple(x) for x in lic] == [(True, True, True), (True, True, True), (True, False, True), (False, False, False), (False, False, False)]


# ---------------------------------------------------------------- governance


def test_freshness_and_targets(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-09 23:00:00"), ("c", None), ("d", "2024-01-11 00:00:00")], "k string, ts string")
    targets = spark.createDataFrame([(k, "2h") for k in "abcde"], "k string, threshold string")
    got = {r.k: r.status for r in checks.freshness(rows, "ts", targets, "k", F.lit("2024-01-10").cast("timestamp")).collect()}
    assert got == {"a": "stale", "b": "ok", "c": "stale", "d": "ahead", "e": "stale"}
    with pytest.raises(LookupError):
        checks.require_targets(targets, targets.filter("k <> 'e'"), ["k"])
    assert checks.require_targets(targets, targets, ["k"]) is targets


def test_coherence(spark):
    left = spark.createDataFrame([("a", 1, 10), ("b", 1, 9), ("c", 1, 0), ("x", 1, 5)], "key string, day int, n int")
    right = spark.createDataFrame([("a", 1, 9), ("b", 1, 10), ("c", 1, 0), ("y", 1, 5)], "key string, day int, n int")
    assert checks.deviations(left, right, 10.0).count() == 0 and checks.deviations(left, right, 9.9).count() == 2
    assert checks.coverage(left, right).first().coverage_pct == 75.0 and checks.coverage(left, right.limit(0)).first().coverage_pct == 0.0


def test_reconcile_cases(spark):
    def run(referenced, actual):
        parts = inventory.reconcile(spark.createDataFrame([(a,) for a in actual], "name string"), inventory.patterns(spark, referenced))
        return {k: sorted(r["name"] for r in v.collect()) for k, v in parts.items()}

    assert run(["m://d/live", "m://d/dead"], ["m://d/live", "m://d/new"]) == {"matched": ["m://d/live"], "orphans": ["m://d/new"], "ghosts": ["m://d/dead"]}
    assert run(["m://b_{AAAA}/t_{MM}_d{1-3}"], ["m://b_2024/t_01_d1", "m://b_2023/t_12_d3"])["matched"] == ["m://b_2023/t_12_d3", "m://b_2024/t_01_d1"]
    assert run(["m://d/a.b"], ["m://d/axb", "t://d/a.b"]) == {"matched": [], "orphans": ["m://d/axb", "t://d/a.b"], "ghosts": ["m://d/a.b"]}
    assert run(["m://d/{AAAA}", "m://d/20{MM}"], ["m://d/2024"])["matched"] == ["m://d/2024"]


def test_lineage_closure(spark):
    p = spark.createDataFrame([("1", ["a"], ["b"]), ("2", ["b"], ["c", "a"]), ("3", ["z"], ["y"])], "id string, inputs array<string>, outputs array<string>")
    got = inventory.lineage_closure(inventory.pipeline_edges(p), ["a"])
    assert sorted(map(tuple, got.collect())) == [("b", 1), ("c", 2)]


def test_contract_rules(spark):
    c = {"id": "urn:x:c", "schema": [{"name": "t", "properties": [{"name": "k", "primaryKey": True}, {"name": "v", "quality": [{"mustBeBetween": [0, 10], "severity": "warning"}, {"mustBeIn": [1, 2]}]}, {"name": "w", "unique": True}], "quality": [{"rule": "uniqueness"}, {"rule": "freshness"}]}]}
    rules = contracts.rules_of(c)
    assert [(r.kind, r.column, r.severity) for r in rules] == [("required", "k", "error"), ("range", "v", "warning"), ("set", "v", "error"), ("unique", "w", "error"), ("unique", "", "error"), ("freshness", "", "error")]
    df = spark.createDataFrame([(None, 0), (1, 10), (2, 11), (3, None)], "k int, v int")
    assert [r.violations for r in contracts.check_rows(df, rules).collect()] == [1, 1, 3]
    assert contracts.clean(df, rules[1:2]).count() == 3 and contracts.clean(df, rules[1:2], as_null=True).filter("v IS NULL").count() == 2
    assert contracts.documented(spark, rules).count() == 6
    a = spark.createDataFrame([("x", "int"), ("y", "int")], "name string, type string")
    b = spark.createDataFrame([("x", "text"), ("z", "int")], "name string, type string")
    assert sorted((r["name"], r.kind, r.severity) for r in contracts.schema_diff(a, b).collect()) == [("x", "retyped", "breaking"), ("y", "removed", "breaking"), ("z", "added", "non-breaking")]


def test_climate(spark):
    rows = spark.createDataFrame([("s", "2024-01-01", 5.0), ("s", "2024-01-02", 5.0), ("s", "2024-01-03", 7.0), ("s", "2024-01-04", None), ("s", "2024-01-05", 8.0)], "st string, d string, v double")
    m = climate.monthly_extremes(rows, "st", "d", "v").first()
    assert (str(m.tnn_date), m.txx, str(m.txx_date), m.tmm) == ("2024-01-01", 8.0, "2024-01-05", 6.25)
    assert [(str(r.date), r.previous_record_value) for r in climate.record_events(rows, ["st"], "d", "v").orderBy("date").collect()] == [("2024-01-03", 5.0), ("2024-01-05", 7.0)]
    live = spark.createDataFrame([("123", 1)], "id string, x int")
    old = spark.createDataFrame([(99, 2)], "num int, y int")
    assert climate.link_stations(old, live, "num", "id", spark.createDataFrame([("99", "123")], "old_id string, new_id string")).first().station == "00000123"


# ---------------------------------------------------------------- text


def test_windows():
    text = "".join(f"line {i:02d}\n" for i in range(100))
    got = chunking.windows(text, 80, 24)
    assert got[0].start_line == 1 and got[-1].end_line == 100 and all(len(c.text) <= 80 for c in got)
    assert all(b.start_line <= a.end_line and b.start_line > a.start_line for a, b in zip(got, got[1:], strict=False))
    wide = chunking.windows("a\n" + "x" * 5000 + "\nb\n", 1000, 0)
    assert sum(c.start_line == 2 for c in wide) >= 5 and max(len(c.text) for c in wide) <= 1000
    assert chunking.windows("", 10, 0) == []


def test_structured_files():
    md = "intro\n# A\ntext\n## B\nmore\n"
    assert [c.start_line for c in chunking.sections(md)] == [1, 2, 4]
    yaml = "v: 1\nitems:\n  - id: one\n    x: 1\n  - id: two\n"
    got = chunking.structured("inventory/r.yaml", yaml)
    assert [c.text.split("\n")[0] for c in got] == ["# inventory/r.yaml | items: one", "# inventory/r.yaml | items: two"] and got[0].start_line == 3
    assert len(chunking.structured("contracts/c.yaml", yaml)) == 1 and chunking.structured("a.md", " \n") == []
    code = "import os\n\n# note\ndef a():\n    pass\n\nclass B:\n    pass\n\ndef c():\n    pass\n"
    parts = chunking.definitions(code, "python")
    assert len(parts) == 4 and all(x.end_line < y.start_line for x, y in zip(parts, parts[1:], strict=False)) and "# note" in parts[1].text
    assert len(chunking.definitions("a\nb\n", "ncl")) == 1 and chunking.definitions("", "php") == []


def test_context(spark):
    files = spark.createDataFrame([("r", "a.py", "python", "def f():\n    x\n" * 3)], "repo string, path string, lang string, text string")
    chunks = chunking.chunk_files(files, "windows", 20, 0)
    named = chunking.enclosing_symbols(files, chunks)
    assert {r.symbol for r in named.collect()} == {"f"}
    assert chunking.contextualise(named).first().contextualized.startswith("[repo r | file a.py | in f | lines 1-")
    said = chunking.contextualise(named, "llm", lambda pdf: pd.Series(["own", None] + [" "] * (len(pdf) - 2), index=pdf.index)).orderBy("chunk").collect()
    assert said[0].context == "own" and said[1].context.startswith("[repo r")

    def broken(pdf):
        raise RuntimeError

    assert all(r.context.startswith("[repo") for r in chunking.contextualise(named, "llm", broken).collect())
    assert chunking.contextualise(named, "off").first().contextualized == named.first().text
    assert chunking.listing(chunks, 30).count() == 1


def test_batches_and_embedding():
    assert np.bincount(chunking.batches([30] * 5, 64, 100)).tolist() == [3, 2]
    assert np.bincount(chunking.batches([10, 500, 10], 64, 100)).tolist() == [1, 1, 1]
    calls = []

    def embedder(texts):
        calls.append([len(t) for t in texts])
        return np.ones((len(texts), 2))

    assert R.embed_texts(["x" * 30] * 5 + ["y" * 9000], embedder, 64, 100, 50).shape == (6, 2) and calls == [[30, 30, 30], [30, 30], [50]]
    tries, waits = [], []

    def limited(texts):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("429")
        return np.zeros((1, 1))

    assert R.with_retry(limited, lambda e: "429" in str(e), sleep=waits.append)(["a"]).shape == (1, 1) and waits == [1, 2]
    with pytest.raises(ValueError):
        R.with_retry(lambda t: (_ for _ in ()).throw(ValueError("no")), lambda e: False)(["a"])


def test_search(spark):
    rows = [("1", "r1", "py", "alpha beta", [1.0, 0.0, 0.0]), ("2", "r1", "js", "gamma delta", [0.0, 1.0, 0.0]), ("3", "r'2", "py", "epsilon needle", [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, repo string, lang string, text string, vector array<float>").withColumn("contextualized", F.col("text"))
    assert R.vector_search(df, [0.9, 0.1, 0.0], 1).first().id == "1"
    assert R.vector_search(df, [0.9, 0.1, 0.0], 3, C.search_filter(["r'2"])).first().id == "3"
    assert R.hybrid_search(df, "needle", [1.0, 1.0, 1.0], 3).first().id == "3"
    assert R.hybrid_search(df, "needle", [1.0, 0.2, 0.1], 1, hybrid=False).first().id == "1"
    embed = lambda texts: np.array([[1.0, 1.0, 1.0] for _ in texts])
    found = R.search(df, "find it", 2, embed, rewrite=lambda q: "needle", rerank=lambda q, hits: [1, 1, 9])
    assert found.count() == 2 and R.search(df, "needle", 2, embed).first().id == "3"
    assert R.search(df, "needle", 2, embed, rewrite=lambda q: 1 / 0, rerank=lambda q, h: 1 / 0).first().id == "3"
    assert R.reorder(3, [2, 2, 7, 0]) == [2, 0, 1]
    ranked = spark.createDataFrame([(1, "mort", "2026-01-01"), (2, "", None), (3, "actif", "2026-06-01")], "rank int, status string, last_commit string")
    assert [r["rank"] for r in R.meta_rerank(ranked, 3, F.lit("2026-06-17").cast("date")).collect()] == [3, 2, 1]
    meta = R.attach_metadata(df.withColumn("key", F.col("id")), spark.createDataFrame([("1", "d", "s")], "key string, last_commit string, status string"), spark.createDataFrame([("r1", "hub")], "repo string, source string"))
    assert sorted((r.id, r.status, r.source) for r in meta.collect()) == [("1", "s", "hub"), ("2", "", "hub"), ("3", "", "")]


# ---------------------------------------------------------------- code graph


def built(spark, sources, **k):
    files = spark.createDataFrame([("r", p, "python", t) for p, t in sources.items()], "repo string, path string, lang string, text string")
    nodes, edges = graph.resolve(graph.extract(files), **k)
    names = {r.id: r.qname for r in nodes.collect()}
    return nodes, edges, {(names[e.src], names[e.dst]): e.conf for e in edges.collect()}


def test_cascade(spark):
    _, edges, got = built(spark, {
        "a.py": "class Base:\n    def up(self): pass\nclass A(Base):\n    def up(self):\n        super().up()\n    def m(self):\n        self.up()\n        self.n()\n    def n(self): pass\ndef free():\n    helper()\n",
        "pkg/b.py": "from .c import thing as t\ndef helper(): pass\ndef use():\n    t()\n    x.lonely()\nuse()\n",
        "pkg/c.py": "def thing(): pass\ndef lonely(): pass\ndef twin(): pass\n", "d.py": "def twin(): pass\ndef call():\n    y.twin2()\n", "e.py": "def go():\n    twin()\n", "bad.py": "def (",
    })
    assert got["A.up", "Base.up"] == 0.35 and got["A.m", "A.n"] == 0.95 and got["A.m", "A.up"] == 0.95
    # Without a namespace the unique full name is the bare name.
    assert got["free", "helper"] == 0.90 and got["use", "thing"] == 0.95 and got["use", "lonely"] == 0.60 and got["<module>", "use"] == 0.90
    ids = {e.dst for e in edges.collect() if e.src.endswith(":go") and e.conf == 0.35}
    assert ids == {"r/pkg/c.py:3:twin", "r/d.py:1:twin"}  # every homonym


def test_blocked_names(spark):
    calls = "def target(): pass\n" + "".join(f"def c{i}():\n    z.target()\n" for i in range(5))
    _, _, got = built(spark, {"a.py": "def target(): pass\n", "b.py": calls.replace("def target(): pass\n", "")}, frequency=3)
    assert not any(dst == "target" for _, dst in got)


def test_impact(spark):
    nodes, edges, _ = built(spark, {"m.py": "def c(): pass\ndef b():\n    c()\ndef a():\n    b()\nclass K:\n    def f(self): c()\n"})
    nodes = graph.with_metrics(nodes, edges)
    by = lambda r: {x["qname"]: x["depth"] for x in r["impacted"]}
    assert by(graph.impact(nodes, edges, "c")) == {"b": 1, "K.f": 1, "a": 2} and by(graph.impact(nodes, edges, "c", depth=1)) == {"b": 1, "K.f": 1}
    assert by(graph.impact(nodes, edges, "a", "callees")) == {"b": 1, "c": 2} and by(graph.impact(nodes, edges, "K", "callees")) == {"c": 1}
    cut = graph.impact(nodes, edges, "c", max_nodes=1)
    assert cut["truncated"] and sum(cut["tiers"].values()) == 1
    nothing = graph.impact(nodes, edges, "zzz")
    assert nothing["roots"] == [] and nothing["impacted"] == []
    whole = graph.impact(nodes, edges, "m.py")
    assert whole["scope"] == "file" and len(whole["roots"]) == 5
    assert graph.hotspots(nodes, "fan_in", 1).first().qname == "c" and graph.hotspots(nodes, top=0).count() == 1


def test_pagerank_equals_plain_loops(spark):
    ids, raw = list("abcde"), [("a", "b", 0.9), ("a", "c", 0.3), ("b", "c", 0.5), ("c", "a", 1.0), ("d", "c", 0.4)]
    rank = {i: 1 / 5 for i in ids}
    out = {i: sum(c for s, _, c in raw if s == i) for i in ids}
    for _ in range(20):
        loose = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.15 / 5 + 0.85 * (loose / 5 + sum(rank[s] * c / out[s] for s, t, c in raw if t == i)) for i in ids}
    got = graph.pagerank(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(raw, "src string, dst string, conf double"))
    assert {r.id: r.centrality for r in got.collect()} == {i: round(v, 7) for i, v in rank.items()}


def test_two_strong_paths_raise_confidence(spark):
    e = spark.createDataFrame([("x", "s", 0.4), ("y", "s", 0.9), ("x", "y", 0.8)], "src string, dst string, conf double")
    got = {r.id: (r.depth, r.conf) for r in graph.reach(e, spark.createDataFrame([("s",)], "id string")).collect()}
    assert got == {"x": (1, 0.8), "y": (1, 0.9)}
    assert graph.reach(e, spark.createDataFrame([("s",)], "id string"), min_confidence=0.95).isEmpty()


def test_json_fields_of_what_is_no_object(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "[1]"), (3, '{"k": 1'), (4, '{"k": 1}'), (5, ' {"z": 2}'), (6, None), (7, "")], "i int, t string")
    got = {r.i: r.f for r in rows.select("i", C.json_fields("t", "k int").alias("f")).collect()}
    assert got[4].k == 1 and got[5].k is None and got[5] is not None and all(got[i] is None for i in (1, 2, 3, 6, 7))


def test_closure_and_hierarchy_go_to_the_end(spark):
    from skarn.operators import graph, inventory

    edges = spark.range(30).selectExpr("concat('d', id) AS src", "concat('d', id + 1) AS dst").union(spark.createDataFrame([("d30", "d5")], "src string, dst string"))
    got = {r.name: r.depth for r in inventory.lineage_closure(edges, ["d0"]).collect()}
    assert got == {f"d{i}": i for i in range(1, 31)}
    text = "class A0:\n    def up(self): pass\n" + "".join(f"class A{i}(A{i - 1}): pass\n" for i in range(1, 13)) + "class Z(A12):\n    def m(self):\n        self.up()\n"
    files = spark.createDataFrame([("r", "a.py", "python", text)], "repo string, path string, lang string, text string")
    assert [(e.conf, e.dst) for e in graph.resolve(graph.extract(files))[1].collect()] == [(0.95, "r/a.py:2:A0.up")]


def counted(monkeypatch):
    """(name, rows) of each table that graph keeps from now on."""
    kept, keep = [], graph.keep

    def count(df, name):
        out = keep(df, name)
        kept.append((name, out.count()))
        return out

    monkeypatch.setattr(graph, "keep", count)
    return kept


def test_files_are_parsed_once_by_many_tasks(spark, sf_dir):
    from skarn.plans import parity

    files = parity._sources(spark, sf_dir)
    assert files.rdd.getNumPartitions() > 1  # the table has one row group
    plan = graph.nodes_of(graph.extract(files))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "MapInArrow" not in plan


def test_a_deep_hierarchy_is_climbed_in_few_steps_and_rows(spark, monkeypatch):
    n = 40
    text = "class A0:\n    def up(self): pass\n" + "".join(f"class A{i}(A{i - 1}):\n    def m{i}(self):\n        self.up()\n" for i in range(1, n))
    kept = counted(monkeypatch)
    _, _, got = built(spark, {"a.py": text})
    assert got == {(f"A{i}.m{i}", "A0.up"): 0.95 for i in range(1, n)}
    assert len(kept) <= 25 and sum(rows for _, rows in kept) <= 20 * n  # a row for each class and each above it would be n * n / 2, in n tables


def test_first_methods_equal_a_depth_first_walk(spark):
    """Several classes above one, diamonds, and classes that come back to themselves."""
    import random

    rng = random.Random(5)
    up, methods, asked = [], {}, []
    for world in range(30):
        n, loops = rng.randint(3, 8), world % 3 == 0
        name = lambda i, w=world: f"w{w}c{i}"
        for i in range(n):
            above = rng.sample(range(n) if loops else range(i), min(rng.randint(0, 3), n if loops else i))
            up += [(name(i), pos, name(a)) for pos, a in enumerate(above)]
            methods |= {(name(i), m): f"{name(i)}.{m}" for m in "xy" if rng.random() < 0.2}
            asked += [(name(i), m, rng.random() < 0.5) for m in "xy" if rng.random() < 0.8]
    over = {}
    for c, _, a in sorted(up):
        over.setdefault(c, []).append(a)

    def walk(c, m, path, parent=False):
        if not parent and (c, m) in methods:
            return methods[c, m]
        return next((got for a in over.get(c, []) if a not in path and (got := walk(a, m, [*path, a]))), None)

    frames = spark.createDataFrame(asked, "class string, callee string, parent boolean"), spark.createDataFrame([(*k, v) for k, v in methods.items()], "class string, callee string, dst string")
    rows = graph.first_methods(*frames, spark.createDataFrame(up, "class string, pos int, above string")).collect()
    got = {(r["class"], r.callee): r for r in rows}
    for c, m, parent in asked:
        r = got.get((c, m))
        assert (r and r.dst) == walk(c, m, [c]) and (not parent or (r and r.parent_dst) == walk(c, m, [c], True)), (c, m)


def ranked(ids, raw, iterations):
    rank, out = {i: 1 / len(ids) for i in ids}, {i: sum(c for s, _, c in raw if s == i) for i in ids}
    for _ in range(iterations):
        loose = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.15 / len(ids) + 0.85 * (loose / len(ids) + sum(rank[s] * c / out[s] for s, t, c in raw if t == i and s in rank)) for i in ids}
    return rank


def test_pagerank_moves_only_what_moves(spark, monkeypatch):
    """Twenty steps over customers and parts are one pass over the edges; over a graph with loops, few steps and many are as plain loops have them."""
    frames = lambda ids, raw: (spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(raw, "src string, dst string, conf double"))
    same = lambda got, want: {r.id: round(r.centrality, 12) for r in got.collect()} == {i: round(v, 12) for i, v in want.items()}
    kept = counted(monkeypatch)
    ids = [*(f"c{i}" for i in range(6)), *(f"p{i}" for i in range(5))]
    raw = [(f"c{i}", f"p{j}", (i + j) / 10) for i in range(5) for j in range(4) if (i + j) % 3]
    assert same(graph.pagerank(*frames(ids, raw), digits=None), ranked(ids, raw, 20))
    assert [name for name, _ in kept].count("rank") == 1
    loops = [*raw, ("p0", "c5", 0.3), ("c5", "p0", 0.8), ("p1", "c1", 0.5), ("p1", "elsewhere", 0.5), ("elsewhere", "c1", 0.5)]
    for iterations in (0, 1, 2, 7):
        assert same(graph.pagerank(*frames(ids, loops), iterations=iterations, digits=None), ranked(ids, loops, iterations)), iterations
