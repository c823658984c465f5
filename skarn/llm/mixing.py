"""Operator 3, mixing sources to target weights.

Each document gets a hash-random key (from md5 of seed and doc_id), documents are range-sorted by
key within their source, exclusive prefix sums of token counts are computed over all partitions,
and each source is cut at exactly its budget: total * weight div sum of the weights of the sources
that have tokens. A source with fewer tokens than its budget is repeated in whole epochs, then cut.
The document at the cut gives only the tokens that are still due (`take_tokens`).

Defined cases: a null source is a source of its own; a null text, or one without words, has no
tokens and is never taken; a null doc_id hashes as 'null'; repeated rows each count, ties of key
and doc_id are ordered by token count; a very long text is counted whole and may be cut like any other;
a source of weight 0 gives nothing, and with all weights 0 there are no rows; an empty table, or one
without tokens, gives no rows. Columns other than doc_id, source and text, whatever their names, are
ignored by mix() and kept by mix_documents().
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.llm.common import count_words, n_words, prefix_sums, small, table

SEED = 17
#: Target weights by source; any other source has DEFAULT_WEIGHT.
WEIGHTS: dict[str, int] = {"src0": 6, "src1": 3, "src2": 2}
DEFAULT_WEIGHT = 1


def _key(seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _group() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def _plan(docs: DataFrame, weights: Mapping[str, int], default: int, total: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (g, key, doc_id, n, before), and per source (g, full epochs, rest of the budget)."""
    rows = docs.select(_group().alias("g"), _key(seed).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = count_words(rows, ["g", "key", "doc_id"]).filter("n > 0")
    summed, totals = prefix_sums(rows, "g", ["key", "doc_id", "n"], "n", "mix")
    pairs = [x for s, w in weights.items() for x in (F.lit(f"={s}"), F.lit(int(w)))]
    weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("g")), F.lit(default)) if pairs else F.lit(default)
    # The window without a partition runs over one row for each source.
    all_tokens = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] if total is None else int(total)
    totals = totals.withColumn("w", weight.cast("long")).filter("w > 0")
    totals = totals.withColumn("budget", F.expr(f"CAST((CAST({all_tokens} AS decimal(38,0)) * w) div sum(w) OVER () AS long)"))
    return summed, small(totals.selectExpr("g", "budget div total AS full", "budget % total AS rest"), "mix-budgets")


def mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, default: int = DEFAULT_WEIGHT, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, epoch, n_tokens, take_tokens), a row for each document and epoch that is taken.

    total: tokens of the mixture; by default as many as the documents have.
    """
    rows, budgets = _plan(docs, weights, default, total, seed)
    rows = rows.join(budgets, "g").withColumn("copies", F.col("full") + (F.col("before") < F.col("rest")).cast("long"))
    rows = rows.filter("copies > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, copies - 1)")))
    take = F.when(F.col("epoch") < F.col("full"), F.col("n")).otherwise(F.least(F.col("n"), F.col("rest") - F.col("before")))
    source = F.when(F.col("g") != "null", F.expr("substring(g, 2)"))
    return rows.select("doc_id", source.alias("source"), F.col("epoch").cast("int").alias("epoch"), F.col("n").alias("n_tokens"), take.alias("take_tokens"))


def _first_words(text: Column, k: Column) -> Column:
    """The text up to the end of its k-th word."""
    return F.array_join(F.slice(F.split(text, "(?<=[^ \\t\\n\\r])(?=[ \\t\\n\\r])"), F.lit(1), k.cast("int")), "")


def mix_documents(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, default: int = DEFAULT_WEIGHT, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents of the mixture with the columns of docs, repeated by epoch.

    Texts are not shuffled: a source's cut is one point in the order of keys, so each document is
    compared with its source's cut while it is scanned. Only documents equal to a cut in key, doc_id
    and token count are told apart by a window; the cut one keeps its first due words.
    """
    rows, budgets = _plan(docs, weights, default, total, seed)
    crossing = rows.join(budgets, "g").filter("before < rest AND before + n >= rest").select("g", "key", "doc_id", "n", "rest")
    at = F.struct("key", "doc_id", "n")
    cut = crossing.select("g", at.alias("cut"))
    start = rows.join(small(cut, "mix-cut"), "g").filter(at == F.col("cut")).groupBy("g", "cut").agg(F.min("before").alias("start"))
    plan = small(budgets.join(start, "g", "left").select(*(F.col(c).alias(f"__mix_{c}") for c in ("g", "full", "rest", "cut", "start"))), "mix-plan")
    # The columns are carried in one struct, so that none of their names can clash.
    row = lambda c: F.col("r").getField(c)
    due_text = row("text").rlike("[^ \\t\\n\\r]")
    base = docs.select(_group().alias("__mix_g"), _key(seed).alias("key"), F.col("doc_id").cast("long").alias("id"), F.struct(*(docs[c] for c in docs.columns)).alias("r")).filter(due_text).join(plan, "__mix_g")
    here = F.struct("key", F.col("id").alias("doc_id"))
    cut_at = F.struct(F.col("__mix_cut.key").alias("key"), F.col("__mix_cut.doc_id").alias("doc_id"))
    below = F.when(here == cut_at, n_words(row("text")) < F.col("__mix_cut.n")).otherwise(here < cut_at)  # words are counted at the cut alone
    whole = base.withColumn("copies", F.col("__mix_full") + F.coalesce(below, F.lit(False)).cast("long")).filter("copies > 0").withColumn("e", F.explode(F.expr("sequence(1L, copies)"))).select("r")
    w = Window.partitionBy("__mix_g").orderBy(row("text"))
    part = base.filter(here == cut_at).withColumn("n", n_words(row("text"))).filter("n = __mix_cut.n").withColumn("o", F.row_number().over(w))
    part = part.withColumn("due", F.least(F.expr("__mix_rest - __mix_start - (o - 1) * n"), F.col("n"))).filter("due > 0")
    text = F.when(F.col("due") < F.col("n"), _first_words(row("text"), F.col("due"))).otherwise(row("text"))
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    part = part.select(F.struct(*(new.get(c, row(c)).alias(c) for c in docs.columns)).alias("r"))
    return whole.unionByName(part).select(*(row(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS n,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS k
  FROM documents),
p AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY k, doc_id, n ROWS UNBOUNDED PRECEDING) - n AS before FROM d WHERE n > 0),
t AS (SELECT source, sum(n) AS total, CASE source {" ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())} ELSE {DEFAULT_WEIGHT} END AS w FROM p GROUP BY source),
b AS (SELECT source, total, ((SELECT sum(total) FROM t) * w) // (SELECT sum(w) FROM t) AS budget FROM t),
c AS (SELECT p.*, budget // total AS full_epochs, budget % total AS rest FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, unnest(range(CAST(full_epochs + (before < rest)::INT AS BIGINT))) AS epoch FROM c)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, CAST(n AS BIGINT) AS n_tokens,
  CAST(CASE WHEN epoch < full_epochs THEN n ELSE least(n, rest - before) END AS BIGINT) AS take_tokens
FROM e
"""
