"""Operator 6, MinHash near-dedup with min-max hashing.

A text is lower-cased; its words are the runs of letters and digits (any non-ASCII byte counts as a
letter); its shingles are its runs of three words. Each of `PERMS` hash permutations yields both the
minimum and the maximum over the shingles, two signature values for one evaluation of the hash. Bands
of ROWS values are LSH buckets. Candidates are verified by the share of equal signature values, an
unbiased estimate of the Jaccard similarity once the chance of equal low bytes is taken off. Estimates
of at least MARGIN over the threshold are taken; those less than MARGIN from it are settled by the
exact sets of shingles, unless their documents are in one group already.

Members that are connected aren't compared again: each one is compared with the bucket's smallest doc_id, and
buckets in which that leaves members over get a leader pass, in which a member that resembles no
leader becomes one and is compared with all others, earlier ones included; members that are no leaders
are then compared across what is not yet connected, so that a bucket's similar pairs connect it whole.
Groups are the connected components of verified pairs, found by large-star/small-star steps; each
group keeps its smallest doc_id.

Defined cases: a null or empty text, or a null doc_id, is in no group and stays; a text of one or two
words has one shingle; a text without words has its bytes as its shingle; a very long text is read whole;
rows that repeat a doc_id are one document, of which one row stays, also where they have no text; other
columns are kept, whatever their names; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.llm.common import mix64, small, span_hashes, store, table, text_parts, words_of
from skarn.plans.scratch import discard

PERMS, ROWS, SHINGLE = 72, 3, 3
THRESHOLD = 0.5
#: Over three standard errors of the estimate at the threshold (0.042).
MARGIN = 0.14
#: Ids of open pairs that are broadcast at most, some 40 MB.
IDS = 1_000_000
_SEEDS = np.random.default_rng(7)
_A = _SEEDS.integers(0, 2**32, PERMS, dtype=np.uint32) | np.uint32(1)
_B = _SEEDS.integers(0, 2**32, PERMS, dtype=np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of the shingles of lower-cased texts, ascending by text; none for an empty text."""
    n = len(offs) - 1
    starts, ends, doc = words_of(data, offs)
    h = span_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=n)
    docs, vals = [], []
    if len(h) >= SHINGLE:
        whole = doc[: 1 - SHINGLE] == doc[SHINGLE - 1 :]
        x = np.zeros(len(whole), np.uint64)
        for k in range(SHINGLE):
            x = x * _M + h[k : len(h) - SHINGLE + 1 + k]
        docs.append(doc[: 1 - SHINGLE][whole])
        vals.append(mix64(x[whole]))
    few = (count > 0) & (count < SHINGLE)
    if few.any():
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        acc = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(first, np.diff(first, append=len(doc))).astype(np.uint64) + _M), first)
        pick = few[doc[first]]
        docs.append(doc[first][pick])
        vals.append(mix64(acc[pick]))
    bare = np.flatnonzero((count == 0) & (np.diff(offs) > 0))
    if len(bare):
        docs.append(bare)
        vals.append(span_hashes(data, offs[bare], offs[bare + 1]))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    d, v = np.concatenate(docs), np.concatenate(vals)
    order = np.argsort(d, kind="stable")
    return d[order], v[order]


def min_max(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, values): of each text that has shingles, minimum and maximum under each permutation."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.empty((len(first), 2 * PERMS), np.uint32)
    if len(first):
        base = (x >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(base)
        for k in range(PERMS):
            np.multiply(base, _A[k], out=y)
            np.add(y, _B[k], out=y)
            out[:, 2 * k] = np.minimum.reduceat(y, first)
            out[:, 2 * k + 1] = np.maximum.reduceat(y, first)
    return doc[first], out


def band_hashes(values: np.ndarray) -> np.ndarray:
    """64-bit bucket of each band; the band's number is part of it."""
    n = 2 * PERMS // ROWS
    v = values.reshape(len(values), n, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(n, dtype=np.uint64) * _M, v.shape[:2])
    for k in range(ROWS):
        out = mix64((out ^ v[:, :, k]) * _M)
    return out.astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from signatures of low bytes."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _bytes(col: pa.Array, width: int = 2 * PERMS) -> np.ndarray:
    """Matrix of equally long binary values."""
    if not len(col):
        return np.zeros((0, width), np.uint8)
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), width)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0)
        for a, _, data, offs in text_parts(pc.utf8_lower(b.column(1))):
            docs, values = min_max(*shingles(data, offs))
            if len(docs):
                low = np.ascontiguousarray(values.astype(np.uint8))
                bands = band_hashes(values)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(docs + a)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(bands.ravel())),
                    pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(np.arange(0, low.size + 1, low.shape[1], dtype=np.int32)), pa.py_buffer(low)]),
                ], names=["doc_id", "bands", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, bands, sig) of the documents that can be in a group."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text <> ''")
    return rows.mapInArrow(_sign, "doc_id long, bands array<long>, sig binary")


def leaders(bucket: np.ndarray, doc: np.ndarray, sig: np.ndarray, threshold: float, near: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Verified pairs (doc, leader) of members sorted by bucket, and which members are leaders; a leader meets all other members."""
    open_, lead, pairs = np.ones(len(bucket), np.bool_), np.zeros(len(bucket), np.bool_), []
    rows = np.arange(len(bucket))
    while len(rows):
        left = rows[open_[rows]]
        if not len(left):
            break
        b, first = np.unique(bucket[left], return_index=True)
        head = left[first]
        lead[head] = True
        open_[head] = False
        rows = rows[np.isin(bucket[rows], b)]
        of = head[np.searchsorted(b, bucket[rows])]
        other = ~lead[rows]  # earlier leaders have met this one
        x, y = rows[other], of[other]
        same = _similar(sig, x, y, threshold, near=near)
        open_[x[same]] = False
        apart = same & (doc[x] != doc[y])
        pairs.append(np.stack([doc[x[apart]], doc[y[apart]]], 1))
    return pairs, lead


def _similar(sig: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, most: int = 1 << 16, near: list[np.ndarray] | None = None) -> np.ndarray:
    """Which of the row pairs reach the threshold, in parts; `near` gains those less than two MARGINs below it."""
    out = np.zeros(len(x), np.bool_)
    for a in range(0, len(x), most):
        p, q = x[a : a + most], y[a : a + most]
        s = similarity(sig[p], sig[q])
        out[a : a + most] = s >= threshold
        if near is not None:
            close = (s < threshold) & (s >= threshold - 2 * MARGIN) & (p != q)
            near.append(np.stack([p[close], q[close]], 1))
    return out


def _labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component under the row pairs."""
    comp = np.arange(n)
    while True:
        new, low = comp.copy(), np.minimum(comp[x], comp[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == comp).all():
            return comp
        comp = new


def bucket_pairs(bucket: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Similar row pairs (x, y) that connect, in each bucket of rows sorted by bucket, what all its similar pairs connect; and the near pairs between what is left apart.

    After the leaders, only members of different components that are both no leaders have not met.
    Each of them in turn meets those that are still in other components.
    """
    near: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    first, lead = leaders(bucket, np.arange(len(bucket)), sig, threshold, near)
    pairs = [np.zeros((0, 2), np.int64), *first]
    comp = _labels(len(bucket), *np.concatenate(pairs).T)
    rows = np.flatnonzero(~lead)
    while len(rows):
        b, start = np.unique(bucket[rows], return_index=True)
        at = np.searchsorted(b, bucket[rows])
        of = rows[start][at]
        other = comp[rows] != comp[of]
        more = np.bincount(at, other, len(b)) > 0
        x, y = rows[other], of[other]
        same = _similar(sig, x, y, threshold, near=near)
        pairs.append(np.stack([x[same], y[same]], 1))
        to = np.arange(len(bucket))
        to[comp[x[same]]] = comp[y[same]]
        comp = to[comp]
        rows = rows[(rows != of) & more[at]]
    open_ = np.concatenate(near)
    return np.concatenate(pairs), open_[comp[open_[:, 0]] != comp[open_[:, 1]]]


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, doc, sig) of sorted rows, cut so that no bucket is split."""
    parts: list[tuple] = []
    for b in batches:
        if not b.num_rows:
            continue
        bucket, doc = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sig = _bytes(b.column(2))
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut or (parts and parts[-1][0][-1] != bucket[0]):
            yield tuple(np.concatenate(c) for c in zip(*parts, (bucket[:cut], doc[:cut], sig[:cut]), strict=True))
            parts = []
        parts.append((bucket[cut:], doc[cut:], sig[cut:]))
    if parts:
        yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _leader_pass(threshold: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, doc, sig in _whole_buckets(batches):
            # Members with one signature are alike: the first one stands for them.
            key = np.ascontiguousarray(np.concatenate([bucket.astype(np.int64)[:, None].view(np.uint8), sig], axis=1))
            _, first, of = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_index=True, return_inverse=True)
            keep = np.sort(first)
            sure, near = bucket_pairs(bucket[keep], sig[keep], threshold)
            p = doc[np.concatenate([keep[sure], np.stack([np.arange(len(doc)), first[of]], 1), keep[near]])]
            same = np.arange(len(p)) < len(p) - len(near)
            apart = p[:, 0] != p[:, 1]
            p, same = p[apart], same[apart]
            yield pa.RecordBatch.from_arrays([pa.array(p.max(1)), pa.array(p.min(1)), pa.array(same)], names=["u", "v", "same"])

    return go


def _verify(threshold: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = similarity(_bytes(b.column(2)), _bytes(b.column(3)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s >= threshold), pa.array((s < threshold) & (s >= threshold - 2 * MARGIN))], names=["u", "v", "same", "near"])

    return go


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, e, data, offs in text_parts(pc.utf8_lower(b.column(1))):
            doc, x = shingles(data, offs)
            ends = np.searchsorted(doc, np.arange(e - a + 1)).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), sets], names=["doc_id", "set"])


def exact_pairs(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose exact sets of shingles reach the threshold; of rows that repeat a doc_id any pair counts."""
    # Counted, so that texts are shuffled only where the open pairs are too many to broadcast.
    ids = small(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "minhash-ids", IDS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text <> ''").join(ids, "doc_id", "left_semi")
    sets = store(rows.mapInArrow(_sets, "doc_id long, set array<long>").withColumn("set", F.array_distinct("set")), "minhash-sets")
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(shared >= F.lit(threshold) * (F.size("a") + F.size("b") - shared)).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node of the pairs u > v that isn't its component's smallest, with the smallest."""
    edges = store(edges.select("u", "v").distinct(), "cc")
    state = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            return edges
        state = mark
        # Aggregates combine before they are shuffled, so a hub with many neighbours isn't one task's.
        low = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = store(edges.join(low, "v").select("u", F.col("m").alias("v")).distinct(), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(least, "u").filter("v <> m").select("v", "m").union(least).toDF("u", "v").distinct()
        last, edges = edges, store(step, "cc")
        discard(last)
        discard(large)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of): every document that repeats another, with the one of its group that stays."""
    return _groups(docs, store(signatures(docs), "minhash"), threshold)


def _groups(docs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    sure = threshold + MARGIN
    bands = sigs.select("doc_id", F.explode("bands").alias("bucket"))
    # Combined before the shuffle, so a hot bucket isn't one task's.
    shared = bands.groupBy("bucket").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("n")).filter("n > lead").drop("n")
    members = store(bands.join(shared, "bucket"), "minhash-members")
    pairs = members.filter("doc_id <> lead").select(F.col("doc_id").alias("u"), F.col("lead").alias("v")).distinct()
    a = sigs.select(F.col("doc_id").alias("u"), F.col("sig").alias("sig_u"))
    b = sigs.select(F.col("doc_id").alias("v"), F.col("sig").alias("sig_v"))
    joined = pairs.join(b, "v").join(a, "u").select("u", "v", "sig_u", "sig_v")
    checked = store(joined.mapInArrow(_verify(sure), "u long, v long, same boolean, near boolean"), "minhash-pairs")
    edges = checked.filter("same").select("u", "v")
    failed = checked.filter("NOT same").select(F.col("u").alias("doc_id"), F.col("v").alias("lead"))
    mixed = members.join(failed, ["doc_id", "lead"], "left_semi").select("bucket").distinct()
    rest = members.join(mixed, "bucket", "left_semi").select("bucket", "doc_id").join(sigs.select("doc_id", "sig"), "doc_id").select("bucket", "doc_id", "sig")
    more = store(rest.repartition("bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(_leader_pass(sure), "u long, v long, same boolean"), "minhash-more")
    found = components(edges.union(more.filter("same").select("u", "v")))
    near = checked.filter("near").select("u", "v").union(more.filter("NOT same").select("u", "v")).distinct()
    root = found.select(F.col("u").alias("id"), F.col("v").alias("root"))
    apart = near.join(root.toDF("u", "root_u"), "u", "left").join(root.toDF("v", "root_v"), "v", "left").filter("coalesce(root_u, u) <> coalesce(root_v, v)").select("u", "v")
    close = store(exact_pairs(docs, store(apart, "minhash-near"), threshold), "minhash-close")
    whole = found if close.isEmpty() else components(found.union(close))
    return whole.select(F.col("u").alias("doc_id"), F.col("v").alias("duplicate_of"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that repeat another; of rows that repeat a doc_id the one of smallest text stays.

    Texts are shuffled only if the dropped ids are too many to broadcast.
    """
    sigs = store(signatures(docs), "minhash")
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id IS NOT NULL")
    dropped = small(_groups(docs, sigs, threshold).select(F.col("doc_id").alias("id")), "minhash-dropped")
    twice = small(ids.groupBy("id").count().filter("count > 1").select("id"), "minhash-twice")
    # The columns are carried in one struct, so that none of their names can clash.
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r"), F.col("doc_id").cast("long").alias("id"))
    kept = rows.join(dropped, "id", "left_anti")
    if not twice.isEmpty():
        w = Window.partitionBy("id").orderBy(F.col("r").getField("text"))
        one = kept.join(twice, "id", "left_semi").withColumn("n", F.row_number().over(w)).filter("n = 1").select("id", "r")
        kept = kept.join(twice, "id", "left_anti").select("id", "r").unionByName(one)
    return kept.select(*(F.col("r").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
