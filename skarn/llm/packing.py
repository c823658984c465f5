"""Operator 10, best-fit packing of documents into token sequences, improved by local search.

A document longer than `capacity` is split into full pieces and a rest. Rests are spread by hash over
tasks of about `per_shard`, each of which packs its own: best-fit decreasing, then a local search over
the underfull bins. It moves a document, exchanges one for one, two for one or one for two between two
underfull bins whenever the sum of squared fills grows, until a bin is empty or nothing improves; it
stops once there are as few bins as the tokens allow. Documents of one length are alike, so a bin is a
multiset of lengths, and an index by length, and by the sum of two, gives for each bin the exchange that
fills it most without trying all pairs of bins.

Rounds: the bins that are still underfull meet those of other tasks, spread by another hash, and the
search goes on among them. Rounds end when one task holds all underfull bins, or when a round emptied
less than SETTLED of them. So no task grows with the corpus, and no bin stays open because of the split.

Defined cases: a document without words, or with a null text, takes no place and is in no bin; a
null doc_id is packed as null; repeated rows are packed each; a very long text is split; ties go by
doc_id; other columns are not read; an empty table gives no bins.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import count_words, store, table

CAPACITY = 2048
PER_SHARD = 20_000
#: Share of the underfull bins that a round must empty for another one to follow.
SETTLED = 0.005
BINS = "s long, doc_ids array<long>, starts array<int>, lengths array<int>, fill int"
_FAR = 1 << 40


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the items in each bin; sizes are between 1 and capacity."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            bins.append([i])
            room, b = capacity, len(bins) - 1
        else:
            room, b = free.pop(at)
            bins[b].append(i)
        if room > sizes[i]:
            insort(free, (room - sizes[i], b))
    return bins


class _Index:
    """By value (a length, or a sum of two lengths of a bin), the bin that keeps least without it.

    Entries of bins that changed since are skipped when they come up.
    """

    def __init__(self, capacity: int) -> None:
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.least = np.full(capacity + 1, _FAR, np.int64)

    def add(self, value: int, kept: int, b: int, version: int) -> None:
        heapq.heappush(self.heaps[value], (kept, b, version))
        self.least[value] = self.heaps[value][0][0]

    def clean(self, value: int, versions: list[int]) -> None:
        heap = self.heaps[value]
        while heap and versions[heap[0][1]] != heap[0][2]:
            heapq.heappop(heap)
        self.least[value] = heap[0][0] if heap else _FAR

    def find(self, low: int, high: int, below: int, versions: list[int]) -> int:
        """The largest value in (low, high] whose bin keeps less than `below`; 0 if there is none."""
        while True:
            hits = np.flatnonzero(self.least[low + 1 : high + 1] < below)
            if not len(hits):
                return 0
            value = low + 1 + int(hits[-1])
            self.clean(value, versions)
            if self.least[value] < below:
                return value


def _pairs(c: Counter) -> dict[int, tuple[int, int]]:
    """Sums of two of a bin's lengths, each with one way to get it."""
    kinds = sorted(c)
    return {a + b: (a, b) for i, a in enumerate(kinds) for b in kinds[i:] if a != b or c[a] > 1}


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search between underfull bins; each step adds to the sum of squared fills, so it ends.

    What a taker of fill t gives back (sum r) for what it gets (sum v) makes the squares grow if and only
    if v > r and the giver keeps less than t - r: then v - r is more than the giver's lead.
    """
    least = -(-sum(sizes) // capacity)
    hold = [Counter(sizes[i] for i in b) for b in bins]
    fill = [sum(k * n for k, n in c.items()) for c in hold]
    left, versions = sum(f > 0 for f in fill), [0] * len(bins)
    if left > least:
        one, two = _Index(capacity), _Index(capacity)

        def enter(b: int) -> None:
            if 0 < fill[b] < capacity:
                for v in hold[b]:
                    one.add(v, fill[b] - v, b, versions[b])
                for v in _pairs(hold[b]):
                    two.add(v, fill[b] - v, b, versions[b])

        def step(b: int) -> int | None:
            """Make the exchange that fills b most; return the giver, None if there is no exchange."""
            room, t = capacity - fill[b], fill[b]
            pairs = _pairs(hold[b])
            back = [(0, ()), *((r, (r,)) for r in hold[b]), *pairs.items()]
            best, found = 0, None
            for r, given in back:
                for index in (one, two) if len(given) == 1 else (one,):
                    if t - r > 0 and room > best:
                        v = index.find(r + best, min(r + room, capacity), t - r, versions)
                        if v:
                            best, found = v - r, (index, v, given)
            if found is None:
                return None
            index, v, given = found
            g = index.heaps[v][0][1]
            taken = (v,) if index is one else _pairs(hold[g])[v]
            for bin_, out, in_ in ((g, taken, given), (b, given, taken)):
                hold[bin_].subtract(out)
                hold[bin_].update(in_)
                hold[bin_] = +hold[bin_]
            fill[g] -= best
            fill[b] += best
            return g

        for b in range(len(bins)):
            enter(b)
        again = True
        while again and left > least:
            again = False
            for b in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b)):
                moved = True
                while moved and 0 < fill[b] < capacity and left > least:
                    versions[b] += 1  # out of the index, so that it doesn't meet itself
                    g = step(b)
                    moved = g is not None
                    if moved:
                        again = True
                        versions[g] += 1
                        left -= fill[g] == 0
                        enter(g)
                    enter(b)
    stock: dict[int, list[int]] = {}
    for b in bins:
        for i in b:
            stock.setdefault(sizes[i], []).append(i)
    for s in stock.values():
        s.reverse()
    return [[stock[v].pop() for v in sorted(c, reverse=True) for _ in range(c[v])] for c, f in zip(hold, fill, strict=True) if f]


def _frame(key: int, bins: list[list[int]], ids: list, starts: list[int], sizes: list[int]) -> pd.DataFrame:
    return pd.DataFrame({
        "s": np.full(len(bins), key, np.int64),
        "doc_ids": [[ids[i] for i in b] for b in bins],
        "starts": [[starts[i] for i in b] for b in bins],
        "lengths": [[sizes[i] for i in b] for b in bins],
        "fill": [sum(sizes[i] for i in b) for b in bins],
    })


def pack(docs: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """(bin_id, doc_ids, starts, lengths, fill): the pieces of each bin, with first token and tokens."""
    rows = count_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]).filter("n > 0")
    rows = store(rows.withColumn("rest", F.col("n") % capacity), "packing-lengths")
    first = F.explode(F.expr(f"sequence(0L, n div {capacity} - 1)"))
    whole = rows.filter(F.col("n") >= capacity).select("doc_id", first.alias("k")).select(F.lit(0).cast("long").alias("s"), F.array("doc_id").alias("doc_ids"), F.array((F.col("k") * capacity).cast("int")).alias("starts"), F.array(F.lit(capacity)).alias("lengths"), F.lit(capacity).alias("fill"))
    rest = rows.filter("rest > 0").select("doc_id", "n", "rest")
    shards = lambda n: max(1, -(-n // per_shard))

    def start(key: tuple, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(it), ignore_index=True).sort_values(["doc_id", "n"], kind="stable", na_position="first")
        ids = [None if pd.isna(d) else int(d) for d in pdf["doc_id"].astype("object")]
        sizes = pdf["rest"].tolist()
        yield _frame(int(key[0]), improve(best_fit(sizes, capacity), sizes, capacity), ids, (pdf["n"] - pdf["rest"]).tolist(), sizes)

    def go_on(key: tuple, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(it), ignore_index=True)
        pdf["of"] = [tuple(x) for x in pdf["lengths"]]
        pdf = pdf.sort_values(["fill", "of"], kind="stable")
        ids = [None if pd.isna(i) else int(i) for x in pdf["doc_ids"] for i in x]
        starts, sizes = ([int(i) for x in pdf[c] for i in x] for c in ("starts", "lengths"))
        ends = np.cumsum([len(x) for x in pdf["lengths"]]).tolist()
        bins = [list(range(a, z)) for a, z in zip([0, *ends], ends, strict=False)]
        yield _frame(int(key[0]), improve(bins, sizes, capacity), ids, starts, sizes)

    n = shards(rest.count())
    keyed = rest.withColumn("s", F.pmod(F.xxhash64("doc_id", "n"), F.lit(n)))
    hot = F.col("doc_id").isNull()  # without ids, documents of one length would hash alike
    keyed = keyed.withColumn("s", F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(n))).otherwise(F.col("s")))
    out = store(store(keyed, "packing-shards").groupBy("s").applyInPandas(start, BINS), "packing-bins")
    done, salt = whole.unionByName(out.filter(F.col("fill") == capacity)), 0
    open_ = out.filter(F.col("fill") < capacity)
    while n > 1:
        bins, items = open_.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lengths")), F.lit(0))).first()
        if bins < 2:
            break
        n, salt = shards(items), salt + 1
        spread = F.pmod(F.xxhash64("doc_ids", "starts", "s", F.lit(salt)), F.lit(n))
        out = store(open_.withColumn("s", spread).groupBy("s").applyInPandas(go_on, BINS), "packing-round")
        done, open_ = done.unionByName(out.filter(F.col("fill") == capacity)), out.filter(F.col("fill") < capacity)
        if bins - out.count() < SETTLED * bins:
            break
    return done.unionByName(open_).select(F.monotonically_increasing_id().alias("bin_id"), "doc_ids", "starts", "lengths", "fill")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
