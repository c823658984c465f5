"""Shared pieces of the corpus operators: tables, shared-folder storage, text batches, prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skarn.plans.scratch import keep

#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000
#: Whitespace-delimited words, spelled so that Java, RE2 and Python agree.
WORD = "[^ \\t\\n\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends there, executors may die."""
    return keep(df, name)


def small(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored side, hinted for broadcast only if its counted rows are few; else Spark shuffles it."""
    kept = store(df, name)
    return F.broadcast(kept) if kept.count() <= most else kept


def n_words(text: Column) -> Column:
    """Whitespace-delimited words of a text; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def count_words(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns with `n`, which is n_words() of the column text, counted by numpy in one scan."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for a, z, data, offs in text_parts(b.column(len(cols))):
                inside = ~_IS_GAP[data]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                heads = offs[:-1][np.diff(offs) > 0]
                first[heads] = inside[heads]
                at = np.concatenate([[0], np.cumsum(first)])
                n[a:z] = at[offs[1:]] - at[offs[:-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(n)], names=[*cols, "n"])

    rows = df.select(*cols, "text")
    return rows.mapInArrow(go, T.StructType([*rows.schema.fields[: len(cols)], T.StructField("n", T.LongType())]))


# ---------------------------------------------------------------- text batches


def text_parts(col: pa.Array | pa.ChunkedArray, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, utf-8 bytes, offsets) in parts of about `most` bytes; a longer text is a part by itself."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


_RNG = np.random.default_rng(20240229)
_POS = _RNG.integers(1, 2**63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_IS_GAP = np.zeros(256, np.bool_)
_IS_GAP[list(b" \t\n\r")] = True
_IS_WORD = np.zeros(256, np.bool_)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none of which crosses a text's end."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.empty(n, np.bool_)
    fresh[0] = True
    np.logical_not(mask[:-1], out=fresh[1:])
    inner = offs[(offs > 0) & (offs < n)]
    fresh[inner] = True
    last = np.empty(n, np.bool_)
    last[-1] = True
    np.logical_not(mask[1:], out=last[:-1])
    last[inner - 1] = True
    return np.flatnonzero(fresh & mask), np.flatnonzero(last & mask) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span (spans ascend and don't overlap)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    at = np.cumsum(size) - size
    pos = np.arange(int(size.sum()), dtype=np.int64)
    pos -= np.repeat(at, size)
    chars = data[pos + np.repeat(starts, size)].astype(np.uint64)
    chars += np.uint64(1)
    if int(size.max()) > len(_POS):  # the weights of each further block are those of the first times its own
        chars *= mix64((pos >> 12).astype(np.uint64)) | np.uint64(1)
        pos &= len(_POS) - 1
    chars *= _POS[pos]
    return mix64(np.add.reduceat(chars, at) + size.astype(np.uint64))


def doc_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index of the text that holds each start."""
    return np.searchsorted(offs, starts, "right") - 1


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the words: runs of ASCII letters or digits and of all non-ASCII bytes."""
    starts, ends = runs(_IS_WORD[data], offs)
    return starts, ends, doc_of(starts, offs)


# ---------------------------------------------------------------- prefix sums


def _running(group: str, value: str, out: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, carry = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group).dictionary_encode()
            code = g.indices.to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.diff(code, prepend=-1))
            total = np.cumsum(b.column(value).to_numpy(zero_copy_only=False))
            base = np.where(first > 0, total[first - 1], 0)
            head = g.dictionary[int(code[0])].as_py()
            base[0] -= carry if head == last else 0
            local = total - np.repeat(base, np.diff(first, append=len(code)))
            last, carry = g.dictionary[int(code[-1])].as_py(), int(local[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(code), pid, np.int32)), pa.array(local)], names=[*b.schema.names, "pid", out])

    return go


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Exclusive running sum `before` of a non-negative long `value` per non-null `group` in `order`.

    One range shuffle sorts by (group, order) over all partitions, so a hot group is spread; each
    partition sums locally while it is written, and only one total per (partition, group) is summed
    again. Returns the rows with `before`, and the totals per group as (group, total).
    """
    spec = T.StructType([*df.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("local", T.LongType())])
    df = store(df, f"{name}-rows")  # the range shuffle reads its input twice, once to find the bounds
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = store(ranged.mapInArrow(_running(group, value, "local"), spec), name)
    parts = kept.groupBy(group, "pid").agg(F.max("local").alias("part"))
    w = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(parts.withColumn("base", F.coalesce(F.sum("part").over(w), F.lit(0))), f"{name}-offsets")
    rows = kept.join(offsets.select(group, "pid", "base"), [group, "pid"]).withColumn("before", F.col("base") + F.col("local") - F.col(value)).drop("pid", "local", "base")
    return rows, offsets.groupBy(group).agg(F.sum("part").alias("total"))
