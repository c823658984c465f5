"""Code graph: extraction, cascade resolution of calls, PageRank, bounded impact, hotspots."""

from __future__ import annotations

import ast
import posixpath
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions import columns as C
from skarn.operators import braces
from skarn.plans.scratch import keep

MODULE = "<module>"
HIERARCHY, STATIC, IMPORTED, LOCAL, UNIQUE, MEMBER, AMBIGUOUS = 0.95, 0.90, 0.95, 0.90, 0.75, 0.60, 0.35
STRONG = 0.70
MAX_FANOUT, MAX_FREQUENCY = 6, 200
SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", "/__init__.py", "/index.ts", "/index.js")
FACTS = (
    "repo string, path string, lang string, ns string, fact string, name string, qname string, kind string, start_line int, end_line int, bases array<string>, "
    "callee string, rkind string, rclass string, caller string, class string, alias string, rel string, fqn string"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
BATCH = 10_000  # facts that are handed over at once


def relative_module(module: str, level: int, file_dir: str) -> str:
    """Path of a relative import; one dot is the file's own directory."""
    base = file_dir
    for _ in range(level - 1):
        base = posixpath.dirname(base)
    return posixpath.normpath(posixpath.join(base, module.replace(".", "/"))) if module else base


def _receiver(fn: ast.expr) -> tuple[str, str, str]:
    """(callee, receiver kind, receiver class) of a called expression; super() is a member like any other."""
    if isinstance(fn, ast.Attribute):
        base = fn.value
        if isinstance(base, ast.Name) and base.id == "self":
            return fn.attr, "this", ""
        return fn.attr, "member", ""
    return (fn.id, "free", "") if isinstance(fn, ast.Name) else ("", "free", "")


def facts_of(text: str, path: str = "", lang: str = "python") -> list[dict]:
    """Definitions, calls and imports of a file; nothing for another language or if it can't be parsed."""
    if lang in ("php", "ts", "js"):
        return braces.read(text, path, lang)
    if lang != "python":
        return []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[dict] = []

    def visit(node: ast.AST, stack: list[str], classes: list[str]) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            qname = ".".join([*stack, node.name])
            is_class = isinstance(node, ast.ClassDef)
            bases = [b.id if isinstance(b, ast.Name) else b.attr for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))] if is_class else None
            out.append({"fact": "def", "name": node.name, "qname": qname, "kind": "class" if is_class else "method" if stack and classes and classes[-1] == ".".join(stack) else "function", "start_line": node.lineno, "end_line": node.end_lineno, "bases": bases})
            stack = [*stack, node.name]
            classes = [*classes, qname] if is_class else classes
        elif isinstance(node, ast.Call):
            callee, rkind, rclass = _receiver(node.func)
            if callee:
                out.append({"fact": "call", "callee": callee, "rkind": rkind, "rclass": rclass, "caller": ".".join(stack), "class": classes[-1] if classes else "", "start_line": node.lineno})
        elif isinstance(node, ast.ImportFrom) and node.level and node in tree.body:
            rel = relative_module(node.module or "", node.level, posixpath.dirname(path))
            out.extend({"fact": "import", "alias": a.asname or a.name, "name": a.name, "rel": rel} for a in node.names)
        for child in ast.iter_child_nodes(node):
            visit(child, stack, classes)

    try:
        visit(tree, [], [])
    except RecursionError:
        return []
    return out


def extract(files: DataFrame) -> DataFrame:
    """Facts of (repo, path, lang, text) for Python, PHP, TypeScript and JavaScript; other languages give none.

    The facts are written once: those who read them do so many times, and each time all files would be parsed.
    A file is one task's work, so as many tasks parse as `files` has partitions.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in FACTS.split(", "))])
        rows = []
        for batch in batches:
            for repo, path, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend({"repo": repo, "path": path, "lang": lang, "ns": "", **f} for f in facts_of(text or "", path, lang))
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return keep(files.filter("lang IN ('python', 'php', 'ts', 'js')").select("repo", "path", "lang", "text").mapInArrow(go, FACTS), "graph-facts")


def nodes_of(facts: DataFrame) -> DataFrame:
    """Definitions as nodes, and a module node for each file with calls outside any definition."""
    cols = ["name", "qname", "repo", "path", "lang", "ns", "kind", "start_line", "end_line", "bases"]
    defs = facts.filter("fact = 'def'").select(*cols)
    calls = facts.filter("fact = 'call' AND caller = ''").select("repo", "path", "lang", "ns").distinct()
    modules = calls.select(F.lit(MODULE).alias("name"), F.lit(MODULE).alias("qname"), "repo", "path", "lang", "ns", F.lit("module").alias("kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("array<string>").alias("bases"))
    return defs.unionByName(modules).withColumn("id", C.node_id("repo", "path", "start_line", "qname")).withColumn("fqn", C.full_name("ns", "qname"))


def blocked_names(nodes: DataFrame, calls: DataFrame, fanout: int = MAX_FANOUT, frequency: int = MAX_FREQUENCY) -> DataFrame:
    """Names with too many definitions or calls."""
    many = nodes.filter("kind <> 'module'").groupBy("name").count().filter(F.col("count") > fanout).select("name")
    often = calls.groupBy(F.col("callee").alias("name")).count().filter(F.col("count") > frequency).select("name")
    return many.union(often).distinct()


def _only(df: DataFrame, key: list[str], col: str) -> DataFrame:
    """(key, col) where the key has exactly one row."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min(col).alias(col)).filter("__n = 1").drop("__n")


def _classes(nodes: DataFrame) -> DataFrame:
    """One class for each full name of a language, the last by id; its bases and methods count."""
    rows = nodes.filter(F.col("kind").isin(*braces.CLASS_KINDS)).select("lang", "fqn", F.struct("id", "ns", "name", "repo", "path", "bases").alias("c"))
    return rows.groupBy("lang", "fqn").agg(F.max_by("c", "c.id").alias("c")).select("lang", "fqn", F.col("c.id").alias("class"), "c.ns", "c.name", "c.repo", "c.path", "c.bases")


def _class_lookup(asked: DataFrame, classes: DataFrame, imports: DataFrame, name: str, out: str) -> DataFrame:
    """Asked (repo, path, lang, ns, and a name) with the class it means, if any.

    The full name under which the file imports it, else the name in its own namespace, else the name as
    a full name, else the only class of the language with that last name.
    """
    known = classes.select("lang", "fqn", "class")
    imported = imports.filter("fqn IS NOT NULL").groupBy("repo", "path", F.col("callee").alias(name)).agg(F.max("fqn").alias("fqn"))
    rows = asked.join(imported.join(known.withColumnRenamed("class", "__imported_class"), "fqn").drop("fqn"), ["repo", "path", "lang", name], "left")
    for stage, key in [("ns", C.full_name("ns", name)), ("own", F.col(name))]:
        rows = rows.withColumn("fqn", key).join(known.withColumnRenamed("class", f"__{stage}_class"), ["lang", "fqn"], "left").drop("fqn")
    last = _only(classes.withColumn("last", F.regexp_extract("fqn", r"([^.\\\\]*)$", 1)), ["lang", "last"], "class").select("lang", F.col("last").alias(name), F.col("class").alias("__last_class"))
    rows = rows.join(last, ["lang", name], "left")
    return rows.withColumn(out, F.coalesce("__imported_class", "__ns_class", "__own_class", "__last_class")).drop("__imported_class", "__ns_class", "__own_class", "__last_class")


def _imports(facts: DataFrame) -> DataFrame:
    return facts.filter("fact = 'import'").select("repo", "path", F.col("alias").alias("callee"), F.col("name").alias("original"), F.regexp_replace("rel", "^/+", "").alias("rel"), "fqn")


def bases_of(classes: DataFrame, imports: DataFrame) -> DataFrame:
    """(class, pos, above): the classes right above each class, in the order it names them."""
    bases = classes.select("class", "repo", "path", "ns", "lang", F.posexplode("bases").alias("pos", "base"))
    return _class_lookup(bases, classes, imports, "base", "above").select("class", "pos", "above").filter("above <> class")


def _walked(asked: DataFrame, methods: DataFrame, up: DataFrame) -> DataFrame:
    """first_methods() by all paths above each class asked, for hierarchies that come back to themselves."""
    above = front = asked.select("class").distinct().select("class", F.col("class").alias("ancestor"), F.array().cast("array<int>").alias("order"), F.array("class").alias("path"))
    while True:
        step = front.alias("f").join(up.withColumnRenamed("class", "at"), F.col("f.ancestor") == F.col("at")).filter(~F.array_contains("path", F.col("above")))
        front = keep(step.select("f.class", F.col("above").alias("ancestor"), F.concat("order", F.array("pos")).alias("order"), F.concat("path", F.array("above")).alias("path")), "graph-up")
        if front.isEmpty():
            break
        above = above.unionByName(front)
    reach = asked.select("class", "callee").distinct().join(above.drop("path"), "class").join(methods.withColumnRenamed("class", "ancestor"), ["ancestor", "callee"])
    return reach.groupBy("class", "callee").agg(F.min_by("dst", "order").alias("dst"), F.min_by("dst", F.when(F.size("order") > 0, F.col("order"))).alias("parent_dst"))


def _decided(asked: DataFrame, methods: DataFrame, up: DataFrame) -> DataFrame:
    """(class, callee, dst, todo): the method that a callee means in each class asked and in those above that matter.

    First the asked are followed up to where a class has the method, each class and callee once. Then rounds settle
    them: one without a method of its own takes that of the first above that has any, and one with a single class
    above skips to what is above that, so a chain of n classes takes log n rounds. What no round can settle,
    since its classes come back to themselves, keeps a `todo`; for the rest that is empty and dst null if there is none.
    """
    key, none = ["class", "callee"], F.array().cast("array<struct<pos:int,above:string>>")
    new = keep(asked.select(*key).distinct().join(methods, key, "left"), "graph-asked")
    every = new
    while True:
        higher = new.filter("dst IS NULL").join(up, "class").select(F.col("above").alias("class"), "callee").distinct()
        new = keep(higher.join(every.select(*key), key, "left_anti").join(methods, key, "left"), "graph-asked")
        if new.isEmpty():
            break
        every = every.unionByName(new)
    todo = up.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("pos", "above"))).alias("todo"))
    open_ = keep(every.filter("dst IS NULL").join(todo, "class", "left").withColumn("todo", F.coalesce("todo", none)), "graph-open")
    settled = every.filter("dst IS NOT NULL").withColumn("todo", none).unionByName(open_.filter("size(todo) = 0"))
    open_ = open_.filter("size(todo) > 0")
    left = open_.count()
    while left:
        only = F.when(F.size("todo") == 1, F.col("todo")[0]["above"])
        found = settled.select("class", "callee", "dst", F.lit(True).alias("done"), F.lit(None).cast("string").alias("next")).unionByName(open_.select("class", "callee", "dst", F.lit(False).alias("done"), only.alias("next")))
        asks = open_.select("class", "callee", F.inline("todo"))
        seen = asks.join(found.withColumnRenamed("class", "above").withColumnRenamed("dst", "to"), ["above", "callee"])
        entry = F.when(~F.col("done") | F.col("to").isNotNull(), F.struct("pos", F.coalesce("next", "above").alias("above"), "to"))
        rows = seen.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("all")).withColumn("dst", F.get("all", F.lit(0))["to"])
        step = keep(rows.select(*key, "dst", F.when(F.col("dst").isNotNull(), none).otherwise(F.transform("all", lambda x: F.struct(x["pos"].alias("pos"), x["above"].alias("above")))).alias("todo")), "graph-open")
        settled = settled.unionByName(step.filter("size(todo) = 0"))
        open_, before = step.filter("size(todo) > 0"), left
        left = open_.count()
        if left == before:  # without a way back to itself, at least one would have been settled
            break
    return settled.unionByName(open_)


def first_methods(asked: DataFrame, methods: DataFrame, up: DataFrame) -> DataFrame:
    """(class, callee, dst, parent_dst) for asked (class, callee, parent): the first of `methods` (class, callee, dst)
    on a depth-first walk of `up` (class, pos, above), from the class and, if `parent`, from the classes above it.

    A path never comes back to a class on it, so it ends. Only what is asked is looked up, and a class that many inherit from once.
    """
    key = ["class", "callee"]
    asked = asked.groupBy(*key).agg(F.max("parent").alias("parent"))
    up = up.filter("above <> class")
    over = asked.filter("parent").join(up, "class").select("class", "callee", "pos", "above")
    got = keep(_decided(asked.select(*key).unionByName(over.select(F.col("above").alias("class"), "callee")), methods, up), "graph-decided")
    state = got.select(*key, "dst", (F.size("todo") > 0).alias("open"))
    above = over.join(state.withColumnRenamed("class", "above").withColumnRenamed("dst", "to"), ["above", "callee"])
    above = above.groupBy(*key).agg(F.min_by(F.struct("to", "open"), F.when(F.col("open") | F.col("to").isNotNull(), F.col("pos"))).alias("p"))
    rows = asked.join(state, key).join(above, key, "left").select(*key, "dst", F.col("p.to").alias("parent_dst"), (F.col("open") | F.coalesce(F.col("p.open") | (F.col("p.to") == F.col("dst")), F.lit(False))).alias("open"))
    rows = keep(rows, "graph-first")  # open: undecided, or a class above came back to the method of the class itself
    again = rows.filter("open").select(*key)
    if again.isEmpty():
        return rows.drop("open")
    return rows.filter("NOT open").drop("open").unionByName(_walked(again, methods, up))


def resolve(facts: DataFrame, fanout: int = MAX_FANOUT, frequency: int = MAX_FREQUENCY) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (src, dst, conf) by the cascade; the first step that gives a call an edge counts.

    Each step is an equi join that adds candidates with its number; a call keeps the candidates of
    its smallest step. An imported name that has exactly one full name stops there even if it is
    the caller itself. Blocked names stop before the steps over the whole project.
    """
    nodes = keep(nodes_of(facts), "graph-nodes")
    calls = facts.filter("fact = 'call'").select("repo", "path", "lang", "ns", "callee", "rkind", "rclass", "caller", "class", "start_line")
    own = nodes.groupBy("repo", "path", "qname").agg(F.max("id").alias("src"))
    calls = calls.withColumn("qname", F.when(F.col("caller") == "", F.lit(MODULE)).otherwise(F.col("caller"))).join(own, ["repo", "path", "qname"], "left")
    calls = keep(calls.filter("src IS NOT NULL").withColumn("call", F.monotonically_increasing_id()), "graph-calls")
    methods = nodes.filter("kind IN ('method', 'function') AND contains(qname, '.')").select("repo", "path", F.expr("left(qname, length(qname) - length(name) - 1)").alias("class_q"), F.col("name").alias("callee"), F.col("id").alias("dst"))
    imports = _imports(facts)
    tops = keep(_classes(nodes), "graph-classes")
    up = keep(bases_of(tops, imports), "graph-bases")
    classes = tops.select(F.col("class").alias("id"))
    own_class = nodes.filter(F.col("kind").isin(*braces.CLASS_KINDS)).select("repo", "path", F.col("qname").alias("class_q"), "lang", "fqn").dropDuplicates(["repo", "path", "class_q"])
    kept = nodes.join(classes, "id", "left_semi").select("id", "repo", "path", "lang", "fqn", "ns", "name", "qname")
    class_id = own_class.join(kept.select("lang", "fqn", F.col("id").alias("cls")), ["lang", "fqn"]).select("repo", "path", "class_q", "cls")
    methods = methods.join(kept.select("repo", "path", F.col("qname").alias("class_q"), F.col("id").alias("cls")), ["repo", "path", "class_q"]).groupBy("cls", "callee").agg(F.max("dst").alias("dst"))
    methods = keep(methods.withColumnRenamed("cls", "class"), "graph-methods")
    mine = calls.filter("rkind IN ('this', 'self', 'parent') AND class <> ''").join(class_id.withColumnRenamed("class_q", "class_name"), (calls["repo"] == class_id["repo"]) & (calls["path"] == class_id["path"]) & (calls["class"] == F.col("class_name"))).select("call", "src", "rkind", calls["callee"], F.col("cls").alias("class"))
    mine = keep(mine, "graph-mine")
    made = _class_lookup(calls.filter("rkind IN ('static', 'new') AND rclass <> ''").drop("class"), kept.withColumnRenamed("id", "class"), imports, "rclass", "class").filter("class IS NOT NULL")
    made = keep(made.withColumn("callee", F.when(F.col("rkind") == "new", "__construct").otherwise(F.col("callee"))).select("call", "src", "rkind", "callee", "class"), "graph-made")
    asked = mine.select("class", "callee", (F.col("rkind") == "parent").alias("parent")).unionByName(made.select("class", "callee", F.lit(False).alias("parent")))
    first = first_methods(asked, methods, up)
    mine = mine.join(first, ["class", "callee"]).withColumn("to", F.when(F.col("rkind") == "parent", F.col("parent_dst")).otherwise(F.col("dst")))
    steps = [mine.filter("to IS NOT NULL AND to <> src").select("call", "src", F.col("to").alias("dst"), F.lit(1).alias("step"), F.lit(HIERARCHY).alias("conf"))]
    real = nodes.filter("kind <> 'module'")
    made = made.join(first.select("class", "callee", F.col("dst").alias("method")), ["class", "callee"], "left")
    made = made.withColumn("dst", F.coalesce("method", F.when(F.col("rkind") == "new", F.col("class"))))
    steps.append(made.filter("dst IS NOT NULL AND dst <> src").select("call", "src", "dst", F.lit(3).alias("step"), F.lit(STATIC).alias("conf")))
    free = calls.filter("rkind = 'free'")
    asked = free.join(imports.groupBy("repo", "path", "callee").agg(F.max(F.struct("original", "rel", "fqn")).alias("i")), ["repo", "path", "callee"]).select("*", "i.*").drop("i")
    one_fqn = _only(real, ["lang", "fqn"], "id").withColumnRenamed("id", "dst")
    steps.append(asked.filter("fqn IS NOT NULL").join(one_fqn, ["lang", "fqn"]).select("call", "src", "dst", F.lit(4).alias("step"), F.lit(IMPORTED).alias("conf")))
    in_file = _only(real, ["repo", "path", "name"], "id").withColumnRenamed("id", "dst")
    tails = F.array(*(F.lit(s) for s in SUFFIXES))
    at = asked.filter("rel IS NOT NULL").select("call", "src", "repo", "rel", F.col("original").alias("name"), F.posexplode(tails).alias("pos", "tail")).withColumn("path", F.concat("rel", "tail"))
    hit = at.join(in_file, ["repo", "path", "name"]).groupBy("call", "src").agg(F.min_by("dst", "pos").alias("dst")).filter("dst <> src")
    steps.append(hit.select("call", "src", "dst", F.lit(5).alias("step"), F.lit(IMPORTED).alias("conf")))
    steps.append(calls.join(in_file.withColumnRenamed("name", "callee"), ["repo", "path", "callee"]).select("call", "src", "dst", F.lit(6).alias("step"), F.lit(LOCAL).alias("conf")))
    blocked = blocked_names(nodes, calls, fanout, frequency).withColumnRenamed("name", "callee")
    open_ = calls.join(blocked, "callee", "left_anti")
    near = open_.filter("rkind = 'free'").withColumn("fqn", C.full_name("ns", "callee")).join(one_fqn, ["lang", "fqn"])
    steps.append(near.select("call", "src", "dst", F.lit(7).alias("step"), F.lit(LOCAL).alias("conf")))
    names = real.select("lang", F.col("name").alias("callee"), F.col("id").alias("dst")).withColumn("homonyms", F.count(F.lit(1)).over(Window.partitionBy("lang", "callee")))
    every = open_.join(names, ["lang", "callee"])
    conf = F.when(F.col("homonyms") > 1, AMBIGUOUS).when(F.col("rkind") == "free", UNIQUE).otherwise(MEMBER)
    steps.append(every.select("call", "src", "dst", F.when(F.col("homonyms") == 1, 8).otherwise(9).alias("step"), conf.alias("conf")))
    found = steps[0]
    for s in steps[1:]:
        found = found.unionByName(s)
    best = found.withColumn("first", F.min("step").over(Window.partitionBy("call"))).filter("step = first")
    return nodes, dedup_edges(best)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair with its highest confidence; no edges of a node to itself."""
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.max("conf").alias("conf"))


def fan_in(edges: DataFrame) -> DataFrame:
    """Callers of each node, of deduplicated edges."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, digits: int | None = 7) -> DataFrame:
    """(id, centrality) after exactly `iterations` steps; edges weigh by confidence over their source's sum.

    A step adds the same base to each node (its mass of nodes without outgoing edges is spread evenly over all) and
    moves ranks along the edges. So the rank is a sum over k of an even rank moved k steps, times a factor that only the
    bases make. These parts are kept, each with the nodes it reaches; one join with the edges makes the next, and once
    no node with outgoing edges is reached, all later parts are zero and no edge is read for them.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id").withColumn("centrality", F.lit(0.0))
    sums = edges.groupBy("src").agg(F.sum("conf").alias("total"))  # combined before the shuffle, so that a hub isn't one task's
    known = edges.join(sums.join(nodes.select(F.col("id").alias("src")), "src", "left_semi"), "src")
    out = keep(known.select("src", "dst", (F.col("conf") / F.col("total")).alias("weight")), "rank-edges")  # one job, so that both readers of the edges share their shuffle
    sources = out.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(1))
    ids = keep(nodes.select("id").distinct().join(sources, "id", "left"), "rank-nodes")
    parts, loose = [], [float(ids.filter("out IS NULL").count())]  # loose: of each part, the mass on nodes without outgoing edges
    moved = out.select(F.col("dst").alias("id"), F.col("weight").alias("v"))
    while len(parts) < iterations:
        part = keep(moved.groupBy("id").agg(F.sum("v").alias("v")).filter("v IS NOT NULL").join(ids, "id"), "rank")
        parts.append(part)
        mass = part.agg(F.sum(F.when(F.col("out").isNull(), F.col("v"))).alias("loose"), F.count("out").alias("front")).first()
        loose.append(mass["loose"] or 0.0)
        if not mass["front"]:
            break
        front = part.filter("out IS NOT NULL").select(F.col("id").alias("src"), "v")
        moved = out.join(front, "src").select(F.col("dst").alias("id"), (F.col("v") * F.col("weight")).alias("v"))
    start, bases = 1.0 / n, []
    for t in range(iterations):  # bases[t]: what step t + 1 adds to each node
        dangling = sum(bases[t - 1 - k] * damping**k * loose[k] for k in range(min(t, len(loose)))) + (start * damping**t * loose[t] if t < len(loose) else 0.0)
        bases.append((1 - damping) / n + damping * dangling / n)
    factor = [*(bases[iterations - 1 - k] * damping**k for k in range(iterations)), start * damping**iterations]
    rank = ids.select("id", F.lit(factor[0]).alias("r"))
    if parts:
        gains = reduce(DataFrame.unionByName, [p.select("id", (F.col("v") * factor[k]).alias("r")) for k, p in enumerate(parts, 1)])
        rank = ids.join(gains.groupBy("id").agg(F.sum("r").alias("r")), "id", "left").select("id", (F.lit(factor[0]) + F.coalesce("r", F.lit(0.0))).alias("r"))
    return rank.select("id", (F.round("r", digits) if digits is not None else F.col("r")).alias("centrality"))


def with_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with fan_in and centrality."""
    return nodes.join(fan_in(edges), "id", "left").join(pagerank(nodes, edges), "id", "left").fillna(0, ["fan_in"]).fillna(0.0, ["centrality"])


def build_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, strong edges, full names."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("fqn").alias("fqns"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("conf") >= STRONG).alias("strong")))


def resolve_symbol(nodes: DataFrame, symbol: str) -> DataFrame:
    """Ids by name, else full name, else path:line, else qualified name in any case; the first that hits."""
    s = symbol.strip()
    real = F.col("kind") != "module"
    head, _, line = s.rpartition(":")
    low, q = s.lower(), F.lower("qname")
    stage = F.when(real & (F.col("name") == s), 1).when(real & (F.col("fqn") == s), 2)
    if head and line.isdigit():
        stage = stage.when(F.col("path").endswith(head) & (F.col("start_line") == int(line)), 3)
    stage = stage.when((q == low) | q.endswith("." + low), 4)
    hits = nodes.withColumn("stage", stage).filter(F.col("stage").isNotNull() & F.lit(s != ""))
    best = F.broadcast(hits.agg(F.min("stage").alias("best")))  # one row
    return hits.join(best, F.col("stage") == F.col("best")).select("id") if s else nodes.filter(F.lit(False)).select("id")


def roots_of(nodes: DataFrame, symbol: str) -> tuple[DataFrame, str]:
    """Roots and whether they are those of a symbol or of a file."""
    roots = keep(resolve_symbol(nodes, symbol), "roots")
    if roots.isEmpty() and ("/" in symbol or symbol.endswith((".php", ".py", ".ts", ".tsx", ".js", ".jsx"))):
        return nodes.filter((F.col("kind") != "module") & F.col("path").endswith(symbol.strip().lstrip("/"))).select("id"), "file"
    return roots, "symbol"


def seeds_of(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots, and the members of those that are classes."""
    classes = nodes.join(roots, "id", "left_semi").filter("kind IN ('class', 'interface', 'trait', 'enum')").select(F.col("repo").alias("r"), F.col("path").alias("p"), F.concat("qname", F.lit(".")).alias("prefix"))
    members = nodes.join(classes, (nodes["repo"] == classes["r"]) & (nodes["path"] == classes["p"]) & F.expr("startswith(qname, prefix)"), "left_semi")
    return roots.union(members.select("id")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "callers", depth: int = 2, min_confidence: float = 0.0) -> DataFrame:
    """(id, depth, conf): first level that reaches a node, and the best of the paths' weakest edges.

    Each level expands the nodes found in the last one with the confidence they have at its end; a node
    that is met again may gain confidence but isn't expanded again. Seeds aren't in the result.
    """
    step = edges.filter(F.col("conf") >= min_confidence)
    step = step.select(F.col("dst").alias("a"), F.col("src").alias("b"), "conf") if direction == "callers" else step.select(F.col("src").alias("a"), F.col("dst").alias("b"), "conf")
    best = seeds.distinct().select("id", F.lit(0).alias("depth"), F.lit(1.0).alias("path"))
    for d in range(1, depth + 1):
        front = best.filter(F.col("depth") == d - 1).select(F.col("id").alias("a"), "path")
        new = front.join(step, "a").select(F.col("b").alias("id"), F.lit(d).alias("depth"), F.least("path", "conf").alias("path"))
        best = keep(best.unionByName(new).groupBy("id").agg(F.min("depth").alias("depth"), F.max("path").alias("path")), "reach")
    return best.filter("depth > 0").select("id", "depth", F.col("path").alias("conf"))


def impact(nodes: DataFrame, edges: DataFrame, symbol: str, direction: str = "callers", depth: int = 2, max_nodes: int = 40, min_confidence: float = 0.0) -> dict:
    """Roots, impacted nodes by tier and centrality, cut at max_nodes, with counts over the cut list."""
    roots, scope = roots_of(nodes, symbol)
    found = reach(edges, seeds_of(nodes, roots), direction, depth, min_confidence)
    rows = nodes.join(found, "id").withColumn("tier", C.tier("conf")).withColumn("subsystem", C.subsystem("repo", "path")).withColumn("confidence", F.round("conf", 2))
    order = F.when(F.col("tier") == "certain", 0).when(F.col("tier") == "probable", 1).otherwise(2)
    more = rows.orderBy(order, F.desc("centrality"), "id").limit(max_nodes + 1).drop("bases").collect()
    impacted, root_rows = more[:max_nodes], nodes.join(roots, "id", "left_semi").collect()
    tally = lambda key: {k: sum(r[key] == k for r in impacted) for k in sorted({r[key] for r in impacted})}
    files = sorted({f"{r['repo']}/{r['path']}" for r in root_rows})
    return {"symbol": symbol, "scope": scope, "roots": root_rows, "impacted": impacted, "truncated": len(more) > max_nodes, "by_subsystem": tally("subsystem"), "tiers": tally("tier"), "ambiguous": (len(files) if scope == "file" else len(root_rows)) > 1}


def hotspots(nodes: DataFrame, by: str = "centrality", top: int = 20, repo: str | None = None, lang: str | None = None, subsystem: str | None = None) -> DataFrame:
    """The nodes with the highest centrality or fan_in, without modules."""
    metric = "fan_in" if by == "fan_in" else "centrality"
    rows = nodes.filter("kind <> 'module'").withColumn("subsystem", C.subsystem("repo", "path"))
    for c, v in (("repo", repo), ("lang", lang), ("subsystem", subsystem)):
        rows = rows.filter(F.col(c) == v) if v else rows
    return rows.withColumn("metric", F.col(metric)).orderBy(F.desc(metric), F.desc("fan_in"), "id").limit(max(1, top))
