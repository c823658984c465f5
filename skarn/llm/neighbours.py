"""Operator 9, approximate nearest neighbours by an adaptive dimension scan.

Vectors are turned by one random rotation, so that the squared distance over the first t dimensions,
scaled by d/t, estimates the whole, and are stored in column blocks of some dimensions each. They are
put into the lists of centroids that k-means finds on at most SAMPLE_BYTES of sampled vectors; every
vector is in the index. How many lists a query probes is measured: the exact neighbours of CALIBRATE
sampled vectors, found in one scan over all rows, tell how many of the nearest lists hold RECALL of them.
So clustered data cost few probes, while vectors without structure cost many.

A query first searches its nearest list, whose k-th distance bounds what can still matter, then the other
probed lists with that bound, which falls as closer vectors are met. Distances grow by column blocks:
after each, a hypothesis test abandons the candidates whose scaled partial distance is too large for the
bound; only the exact distances of those that pass to the end are returned.

No task holds a list or its queries: a list of more than BLOCK members is split by hash into blocks, the
queries sent to it into chunks of about CHUNK, and a task keeps one block at a time while queries stream by.

Defined cases: null, empty and odd vectors (a null or non-finite element, or not of the most common
length; of equally common lengths the longest) and null ids are neither queries nor neighbours; rows that
repeat a vec_id are one vector, the smallest; equal distances are ranked by neighbour id; with fewer than
k other vectors in the probed lists those are returned; other columns aren't read; an empty table gives
no rows. Vectors have no texts; their length may be any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.llm.common import store, table

K = 10
#: Every row whose id is divisible by this is a query of the registered search.
EVERY = 20
#: Share of the sampled vectors' exact neighbours that the probed lists must hold.
RECALL = 0.97
CALIBRATE = 200
#: Bounds of the centroids and of the sample that k-means sees, in number and bytes.
MAX_LISTS, LIST_BYTES, SAMPLE_BYTES = 4096, 16 << 20, 64 << 20
PASSES = 8
BLOCK, CHUNK = 4096, 1 << 16
#: Dimensions of a column block, and at most so many blocks.
STEP, MAX_STEPS = 16, 16
#: Larger values abandon fewer true neighbours.
EPSILON = 2.1
FOUND = "vec_id long, neighbour_id long, d2 double"
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def rotation(d: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long binary values as floats."""
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    width = 4 * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, width * len(x) + 1, width, dtype=np.int32)), pa.py_buffer(x)])


def adaptive_scan(q: list[np.ndarray], bound: np.ndarray, x: list[np.ndarray], epsilon: float = EPSILON) -> Found:
    """(query row, candidate row, squared distance) of the pairs within the queries' squared bounds; q, x: column blocks."""
    d = sum(b.shape[1] for b in x)
    limit = np.nextafter(np.where(np.isfinite(bound), bound * (1 + 1e-6), np.inf), np.inf)
    ratio = lambda t: 1.0 if t == d else (t / d) * (1 + epsilon / math.sqrt(t)) ** 2
    t = x[0].shape[1]
    own, other = (q[0] * q[0]).sum(1), (x[0] * x[0]).sum(1)
    room = 4e-6 * (own + (other.max() if len(other) else 0))  # for the rounding of a difference of products
    i, j = np.nonzero(own[:, None] + other[None] - 2 * (q[0] @ x[0].T) <= (limit * ratio(t) + room)[:, None])
    acc = ((q[0][i].astype(np.float64) - x[0][j]) ** 2).sum(1)
    for a, b in zip(q[1:], x[1:], strict=True):
        acc += ((a[i].astype(np.float64) - b[j]) ** 2).sum(1)
        t += b.shape[1]
        go = acc <= limit[i] * ratio(t)
        i, j, acc = i[go], j[go], acc[go]
    return i, j, acc


def best(query: np.ndarray, neighbour: np.ndarray, d2: np.ndarray, k: int) -> Found:
    """The k nearest of each query, ties by neighbour."""
    order = np.lexsort((neighbour, d2, query))
    query, neighbour, d2 = query[order], neighbour[order], d2[order]
    first = np.flatnonzero(np.diff(query, prepend=query[:1] - 1)) if len(query) else np.zeros(0, np.int64)
    keep = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query))) < k
    return query[keep], neighbour[keep], d2[keep]


def search_block(q_id: np.ndarray, q: list[np.ndarray], bound: np.ndarray, x_id: np.ndarray, x: list[np.ndarray], k: int, epsilon: float = EPSILON, part: int = 256, step: int = 1024) -> Iterator[Found]:
    """(query id, neighbour id, squared distance) of up to k members within the bound of each query, which falls as members are met."""
    for a in range(0, len(q_id), part):
        ids, own, most = q_id[a : a + part], [b[a : a + part] for b in q], bound[a : a + part].copy()
        rows, near, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for z in range(0, len(x_id), step):
            i, j, e = adaptive_scan(own, most, [b[z : z + step] for b in x], epsilon)
            other = x_id[z + j] != ids[i]
            rows, near, d2 = best(np.concatenate([rows, i[other]]), np.concatenate([near, x_id[z + j[other]]]), np.concatenate([d2, e[other]]), k)
            last = np.flatnonzero(np.bincount(rows, minlength=len(ids)) == k)
            most[last] = np.minimum(most[last], d2[np.searchsorted(rows, last, "right") - 1])
        yield ids[rows], near, d2


def k_means(x: np.ndarray, lists: int, passes: int = PASSES) -> np.ndarray:
    """Centroids of a sample, started from its first rows; those that lose all rows stay where they are."""
    centres = np.array(x[:lists])
    for _ in range(passes if len(centres) > 1 else 0):
        near = np.concatenate([nearest_lists(x[a : a + 4096], centres, 1)[:, 0] for a in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        centres[used] = np.add.reduceat(x[order].astype(np.float64), first) / np.diff(first, append=len(x))[:, None]
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, want: int) -> np.ndarray:
    """The nearest centroids of each row, nearest first."""
    d2 = (centres * centres).sum(1)[None] - 2 * (x @ centres.T)
    part = np.argpartition(d2, want - 1, 1)[:, :want]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d2, part, 1), 1, kind="stable"), 1)


def _indexed(vectors: DataFrame, d: int, cuts: list[int]) -> DataFrame:
    """(vec_id, b0, b1, ...): the turned vectors in column blocks, one row for each id."""
    turn = vectors.sparkSession.sparkContext.broadcast(rotation(d))

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(-1, d).astype(np.float64) @ turn.value  # in 64 bits, so that copies stay alike
            yield pa.RecordBatch.from_arrays([b.column(0), *(_binary(v[:, x:y]) for x, y in zip(cuts, cuts[1:], strict=False))], names=["vec_id", *(f"b{i}" for i in range(len(cuts) - 1))])

    one = vectors.filter(F.size("e") == d).groupBy("vec_id").agg(F.min("e").alias("e"))
    return store(one.mapInArrow(rotate, ", ".join(["vec_id long", *(f"b{i} binary" for i in range(len(cuts) - 1))])), "ann-vectors")


def _sample(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """At most `most` of the n vectors, those of smallest hash among a share that hashing picks."""
    h = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30))
    cut = min(1 << 30, math.ceil((1 << 30) * (1.2 * most + 200) / n))
    got = rows.withColumn("h", h).filter(F.col("h") < cut).orderBy("h", "vec_id").limit(most).drop("h").toArrow()
    return got.column(0).to_numpy(), np.hstack([_matrix(got.column(i)) for i in range(1, got.num_columns)])


def _probes(index: DataFrame, ids: np.ndarray, x: np.ndarray, centres: np.ndarray, k: int, recall: float, cuts: list[int]) -> int:
    """The least number of nearest lists that hold `recall` of the exact neighbours of these vectors."""
    shared = index.sparkSession.sparkContext.broadcast((ids, [np.ascontiguousarray(x[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]))  # CALIBRATE bounds it
    blocks = [c for c in index.columns if c[0] == "b"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        found = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        lists: dict[int, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            member = b.column("vec_id").to_numpy()
            bound = np.full(len(own), np.inf)
            got = list(search_block(own, q, bound, member, [_matrix(b.column(c)) for c in blocks], k, np.inf))
            found = best(*(np.concatenate([f, *c]) for f, c in zip(found, zip(*got, strict=True), strict=True)), k)
            lists |= dict(zip(member.tolist(), b.column("list").to_pylist(), strict=True))
            lists = {i: lists[i] for i in found[1].tolist()}
        yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array([lists[i] for i in found[1].tolist()], pa.int32())], names=["vec_id", "neighbour_id", "d2", "list"])

    w = Window.partitionBy("vec_id").orderBy("d2", "neighbour_id")
    truth = index.mapInArrow(go, FOUND + ", list int").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("vec_id", "list").toArrow()
    if not truth.num_rows:
        return 1
    place = np.argsort(nearest_lists(x, centres, len(centres)), 1)  # of each list among a vector's nearest
    row = dict(zip(ids.tolist(), range(len(ids)), strict=True))
    at = place[[row[i] for i in truth.column(0).to_pylist()], truth.column(1).to_numpy()]
    return int(np.sort(at)[min(len(at), math.ceil(recall * len(at))) - 1]) + 1


def _probe(k: int, epsilon: float, steps: int):
    """Scan of rows sorted by (list, block, chunk, kind): the members of a block, then the queries sent to it."""
    names = [f"b{i}" for i in range(steps)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(c).to_numpy() for c in ("list", "block", "chunk", "kind")], 1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                part = b.slice(a, z - a)
                if tuple(key[a, :3]) != at:
                    at, parts, ready = tuple(key[a, :3]), [], None
                ids, cols = part.column("vec_id").to_numpy(), [_matrix(part.column(c)) for c in names]
                if key[a, 3] == 0:
                    parts.append((ids, cols))
                elif parts:
                    if ready is None:
                        ready = np.concatenate([p[0] for p in parts]), [np.concatenate(c) for c in zip(*(p[1] for p in parts), strict=True)]
                    for found in search_block(ids, cols, part.column("bound").to_numpy(), *ready, k, epsilon):
                        yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["vec_id", "neighbour_id", "d2"])

    return go


def _search(index: DataFrame, sizes: DataFrame, sent: DataFrame, k: int, epsilon: float, block: int, chunk: int, steps: int) -> DataFrame:
    """What the queries (vec_id, bound, list, b...) find in the lists they are sent to."""
    cols = ["vec_id", "bound", *(f"b{i}" for i in range(steps))]
    met = sent.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    plan = F.broadcast(store(sizes.join(met, "list"), "ann-plan"))  # one row for each list: MAX_LISTS bounds it
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = index.withColumn("bound", F.lit(0.0)).join(plan, "list").select("list", part("blocks", 1).alias("block"), every("chunks").alias("chunk"), F.lit(0).alias("kind"), *cols)
    queries = sent.join(plan, "list").select("list", every("blocks").alias("block"), part("chunks", 2).alias("chunk"), F.lit(1).alias("kind"), *cols)
    rows = members.unionByName(queries).repartition("list", "block", "chunk").sortWithinPartitions("list", "block", "chunk", "kind")
    return store(rows.mapInArrow(_probe(k, epsilon, steps), FOUND), "ann-found")


def nearest(vectors: DataFrame, k: int = K, every: int = 1, probes: int | None = None, lists: int | None = None, recall: float = RECALL, block: int = BLOCK, chunk: int = CHUNK, epsilon: float = EPSILON) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance) of the k nearest other vectors of each vector whose id is divisible by `every`.

    lists: by default a quarter of the square root of the number of vectors. probes: of so many nearest
    lists; by default measured. All lists with an infinite epsilon are an exact search.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("e"))
    rows = rows.filter("vec_id IS NOT NULL AND size(e) > 0 AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e18)")
    common = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    d = int(common["d"])
    step = max(STEP, -(-d // MAX_STEPS))
    cuts = [*range(0, d, step), d]
    steps = len(cuts) - 1
    turned = _indexed(rows, d, cuts)
    n = turned.count()
    lists = max(1, min(lists or round(math.sqrt(n) / 4), n, MAX_LISTS, LIST_BYTES // (4 * d)))
    ids, x = _sample(turned, n, max(lists, CALIBRATE, min(64 * lists, SAMPLE_BYTES // (4 * d))))
    centres = k_means(x, lists)
    shared = spark.sparkContext.broadcast(centres)
    blocks = [f"b{i}" for i in range(steps)]

    def assign(want: int):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = np.hstack([_matrix(b.column(c)) for c in blocks]) if b.num_rows else np.zeros((0, d), np.float32)
                near = np.concatenate([nearest_lists(v[a : a + 4096], shared.value, want) for a in range(0, len(v), 4096)] or [np.zeros((0, want), np.int64)]).astype(np.int32)
                col = pa.array(near[:, 0]) if want == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, want, dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, "list" if want == 1 else "near"])

        return go

    spec = ", ".join(["vec_id long", *(f"{c} binary" for c in blocks)])
    index = store(turned.mapInArrow(assign(1), f"{spec}, list int"), "ann-index")
    if probes is None:
        probes = _probes(index, ids[:CALIBRATE], x[:CALIBRATE], centres, k, recall, cuts)
    probes = max(1, min(probes, lists))
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    queries = index.filter(F.col("vec_id") % every == 0)
    first = _search(index, sizes, queries.withColumn("bound", F.lit(float("inf"))), k, epsilon, block, chunk, steps)
    found = first
    if probes > 1:
        w = Window.partitionBy("vec_id").orderBy("d2", "neighbour_id")
        met = first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == k).select("vec_id", F.col("d2").alias("bound"))
        ranged = queries.drop("list").mapInArrow(assign(probes), f"{spec}, near array<int>")
        sent = ranged.join(met, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        sent = store(sent.select("vec_id", "bound", *blocks, F.explode(F.slice("near", 2, probes)).alias("list")), "ann-sent")
        found = first.unionByName(_search(index, sizes, sent, k, epsilon, block, chunk, steps))
    w = Window.partitionBy("vec_id").orderBy("d2", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", F.sqrt("d2").alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by EVERY is searched against all rows."""
    return nearest(table(spark, sf_dir, "embeddings"), every=EVERY)
