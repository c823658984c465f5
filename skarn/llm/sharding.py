"""Operator 7, sharding by a Hilbert curve over document metadata.

Four dimensions are quantised to `bits` bits each: source, lang and n_chars by equal depth (the
share of documents with a smaller value), doc_id by equal width between its extremes. Documents are
range-sorted by (curve index, doc_id) and cut into runs of about `target` characters: a shard holds
the documents whose exclusive prefix sum of n_chars falls into the same multiple of `target`, so
each file covers a small box in every dimension and readers can skip files by any of them.

Defined cases: null source, lang and n_chars sort before all values and a null n_chars has size 0;
a null doc_id takes cell 0; doc_ids may span all 64-bit numbers; negative n_chars have size 0, and only
n_chars tells how long a text is; ties and repeated rows share a curve index and are ordered by doc_id;
shard() reads no other columns, write_shards() keeps them all, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import prefix_sums, small, store, table

BITS = 4
#: Characters of a shard.
TARGET = 16 << 20
DIMS = ("source", "lang", "n_chars", "doc_id")


def hilbert(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points with `bits` bits in each dimension."""
    x = [c.astype(np.int64).copy() for c in cells]
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def _depth_cells(rows: DataFrame, col: str, bits: int) -> DataFrame:
    """(col, cell): equal-depth cell of each distinct value, by prefix sums over the distinct values."""
    counts = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit(""))
    summed, totals = prefix_sums(counts, "g", [col], "n", f"hilbert-{col}")
    cell = F.expr(f"(before * {1 << bits}L) div total")
    return small(summed.crossJoin(small(totals.select("total"), f"hilbert-{col}-total")).select(F.col(col).alias(f"{col}_value"), cell.cast("int").alias(f"{col}_cell")), f"hilbert-{col}-cells")


def curve(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, source_cell, lang_cell, n_chars_cell, doc_id_cell, hilbert, size) of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    ends = small(rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")), "hilbert-ends")
    out = rows
    for c in DIMS[:3]:
        cells = _depth_cells(rows, c, bits)
        out = out.join(cells, out[c].eqNullSafe(cells[f"{c}_value"])).drop(f"{c}_value")
    out = out.crossJoin(ends).withColumn("doc_id_cell", F.coalesce(F.expr(f"((CAST(doc_id AS decimal(38,0)) - lo) * {1 << bits}) div (CAST(hi AS decimal(38,0)) - lo + 1)").cast("int"), F.lit(0)))
    out = out.select("doc_id", *(f"{c}_cell" for c in DIMS), F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)).alias("size"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hilbert([b.column(f"{c}_cell").to_numpy(zero_copy_only=False) for c in DIMS], bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h)], names=[*b.schema.names, "hilbert"])

    return out.mapInArrow(go, T.StructType([*out.schema.fields, T.StructField("hilbert", T.LongType())]))


def shard(docs: DataFrame, target: int = TARGET, bits: int = BITS) -> DataFrame:
    """(doc_id, source_cell, lang_cell, n_chars_cell, doc_id_cell, hilbert, shard) of each document."""
    rows = curve(docs, bits).withColumn("g", F.lit(""))
    summed, _ = prefix_sums(rows, "g", ["hilbert", "doc_id", "size"], "size", "hilbert-runs")
    return summed.select("doc_id", *(f"{c}_cell" for c in DIMS), "hilbert", F.expr(f"before div {int(target)}L").alias("shard"))


def write_shards(docs: DataFrame, path: str, target: int = TARGET, bits: int = BITS) -> DataFrame:
    """Write the documents as one directory for each shard, sorted along the curve; return the manifest.

    The manifest has for each shard the rows and the extremes of every dimension, by which a reader
    prunes. Rows with equal doc_id go to the shard of the first of them; a null doc_id to shard 0. The
    directories' column is `shard`, with as many underscores before it as make it unlike all columns.
    """
    part = "shard"
    while part in docs.columns:
        part = "_" + part
    found = store(shard(docs, target, bits).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("shard").alias("to"), F.min("hilbert").alias("place")), "hilbert-shards")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r"), F.col("doc_id").cast("long").alias("doc_id"))  # no name can clash with those in the struct
    out = rows.join(found, "doc_id", "left").withColumn("to", F.coalesce("to", F.lit(0).cast("long")))
    out = out.repartition("to").sortWithinPartitions("to", "place", "doc_id").select("r.*", F.col("to").alias(part))
    out.write.partitionBy(part).parquet(path)
    spec = T.StructType([*docs.schema.fields, T.StructField(part, T.LongType())])
    back = docs.sparkSession.read.schema(spec).parquet(path)
    return back.groupBy(F.col(part).alias("shard")).agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{p}_{c}") for c in DIMS for p, f in (("min", F.min), ("max", F.max))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _oracle(bits: int = BITS, target: int = TARGET) -> str:
    """The curve as a chain of CTEs, one for each step of the transform."""
    cells = [f"(sum(n) OVER (ORDER BY {c} NULLS FIRST) - n) * {1 << bits} // sum(n) OVER () AS cell FROM (SELECT {c}, count(*) AS n FROM d GROUP BY {c})" for c in DIMS[:3]]
    steps = [
        "d AS (SELECT doc_id, source, lang, n_chars FROM documents)",
        *(f"c{i} AS (SELECT {DIMS[i]}, {x})" for i, x in enumerate(cells)),
        f"""k AS (SELECT d.*, c0.cell AS source_cell, c1.cell AS lang_cell, c2.cell AS n_chars_cell,
          coalesce((doc_id - (SELECT min(doc_id) FROM d)) * {1 << bits} // (SELECT max(doc_id) - min(doc_id) + 1 FROM d), 0) AS doc_id_cell
          FROM d JOIN c0 ON d.source IS NOT DISTINCT FROM c0.source JOIN c1 ON d.lang IS NOT DISTINCT FROM c1.lang JOIN c2 ON d.n_chars IS NOT DISTINCT FROM c2.n_chars)""",
        f"s0 AS (SELECT *, {', '.join(f'CAST({c}_cell AS BIGINT) AS x{i}' for i, c in enumerate(DIMS))} FROM k)",
    ]
    n, d = 0, len(DIMS)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            first = f"CASE WHEN x{i} & {q} > 0 THEN xor(x0, {q - 1}) ELSE xor(x0, xor(x0, x{i}) & {q - 1}) END AS x0"
            own = "" if i == 0 else f", CASE WHEN x{i} & {q} > 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {q - 1}) END AS x{i}"
            steps.append(f"s{n + 1} AS (SELECT * REPLACE ({first}{own}) FROM s{n})")
            n += 1
        q >>= 1
    for i in range(1, d):
        steps.append(f"s{n + 1} AS (SELECT * REPLACE (xor(x{i}, x{i - 1}) AS x{i}) FROM s{n})")
        n += 1
    t = "0"
    q = 1 << (bits - 1)
    while q > 1:
        t = f"xor({t}, CASE WHEN x{d - 1} & {q} > 0 THEN {q - 1} ELSE 0 END)"
        q >>= 1
    steps.append(f"s{n + 1} AS (SELECT *, {t} AS t FROM s{n})")
    digits = [(b, i) for b in range(bits - 1, -1, -1) for i in range(d)]
    index = " + ".join(f"((xor(x{i}, t) >> {b}) & 1) * {1 << (len(digits) - 1 - k)}" for k, (b, i) in enumerate(digits))
    steps.append(f"h AS (SELECT *, {index} AS hilbert, greatest(coalesce(n_chars, 0), 0) AS size FROM s{n + 1})")
    run = f"(sum(size) OVER (ORDER BY hilbert, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size) // {target}"
    cells_out = ", ".join(f"CAST({c}_cell AS INTEGER) AS {c}_cell" for c in DIMS)
    return f"WITH {', '.join(steps)} SELECT doc_id, {cells_out}, CAST(hilbert AS BIGINT) AS hilbert, CAST({run} AS BIGINT) AS shard FROM h"


ORACLE = _oracle()
