"""Operator 1, quality rules: gradient-boosted trees over document statistics.

Statistics are computed by numpy over whole texts. Trees are grown here by histograms with Newton
steps on the logistic loss, on a sample of at most MAX_ROWS labelled documents (those with the
smallest hash of doc_id), under monotonic constraints on chosen features, and flattened into arrays
of complete trees, by which a batch of documents walks all trees level by level. Documents whose
probability of good quality is under `threshold` are rejected. Scoring is one scan without a shuffle.

Defined cases: a null text counts as empty; an empty text has all statistics 0 and is scored like any
other; a very long text is read whole; null labels and labels of no document are ignored; without labels of both classes every
document is kept with score 1; a null doc_id is carried through; repeated rows get the same score;
other columns are kept by keep_good() and never read by score(); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import mix64, runs, span_hashes, store, table, text_parts, words_of

MAX_ROWS = 20_000
THRESHOLD = 0.5
#: Statistics in order, with the sign in which they may move the probability of good quality; 0: freely.
FEATURES: dict[str, int] = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "upper_share": -1, "exclaim_per_word": -1, "distinct_words": 0, "repeat_share": -1, "top_word_share": 0,
    "distinct_grams": 1, "words_per_line": 0, "repeated_lines": -1, "digit_share": 0, "pipes_per_word": -1, "stops_per_word": 0, "non_ascii_share": 0,
}
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.15, 5.0, 4.0
_SYMBOL, _UPPER, _LETTER, _DIGIT, _PIPE, _BANG, _STOP, _BLANK, _HIGH = (1 << i for i in range(9))
_KIND = np.zeros(256, np.uint16)
for _chars, _bit in ((b"#$%&*<>{}[]^~\\@=+_", _SYMBOL), (b"|", _PIPE), (b"!", _BANG), (b".?", _STOP), (b" \t\n\r\f\v", _BLANK), (b"0123456789", _DIGIT), (bytes(range(65, 91)), _UPPER | _LETTER), (bytes(range(97, 123)), _LETTER), (bytes(range(128, 256)), _HIGH)):
    for _c in _chars:
        _KIND[_c] |= _bit


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of True in each text."""
    at = np.concatenate([[0], np.cumsum(flags)])
    return (at[offs[1:]] - at[offs[:-1]]).astype(np.float64)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(mix64(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(doc[first], minlength=n).astype(np.float64)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Matrix of FEATURES of the texts."""
    n = len(offs) - 1
    kind = _KIND[data]
    total = np.diff(offs).astype(np.float64)
    count = {b: _per_text((kind & b) != 0, offs) for b in (_SYMBOL, _UPPER, _LETTER, _DIGIT, _PIPE, _BANG, _STOP, _BLANK, _HIGH)}
    starts, ends, doc = words_of(data, offs)
    h = span_hashes(data, starts, ends)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    per_word, per_char = 1 / np.maximum(words, 1), 1 / np.maximum(total - count[_BLANK], 1)
    same = np.zeros(len(h), np.bool_)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    vocab, inv = np.unique(h, return_inverse=True)
    pair, freq = np.unique(doc * max(1, len(vocab)) + inv, return_counts=True)
    top, kinds = np.zeros(n), np.bincount(pair // max(1, len(vocab)), minlength=n)
    np.maximum.at(top, pair // max(1, len(vocab)), freq)
    grams, gram_kinds = np.zeros(n), np.zeros(n)
    if len(h) >= 5:
        inside = doc[:-4] == doc[4:]
        x = np.zeros(len(inside), np.uint64)
        for k in range(5):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - 4 + k]
        x, at = x[inside], doc[:-4][inside]
        grams, gram_kinds = np.bincount(at, minlength=n).astype(np.float64), _distinct(at, x, n)
    a, z = runs(data != 10, offs)
    line_doc = np.searchsorted(offs, a, "right") - 1
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    line_kinds = _distinct(line_doc, span_hashes(data, a, z), n)
    return np.stack([
        np.log1p(words), np.bincount(doc, weights=(ends - starts), minlength=n) * per_word, count[_SYMBOL] * per_char, count[_UPPER] / np.maximum(count[_LETTER], 1),
        count[_BANG] * per_word, kinds * per_word, np.bincount(doc, weights=same, minlength=n) * per_word, top * per_word, np.where(grams > 0, gram_kinds / np.maximum(grams, 1), 1.0) * (total > 0),
        words / np.maximum(lines, 1), (lines - line_kinds) / np.maximum(lines, 1), count[_DIGIT] * per_char, count[_PIPE] * per_word, count[_STOP] * per_word, count[_HIGH] / np.maximum(total, 1),
    ], 1)


@dataclass(frozen=True)
class Trees:
    """Complete trees of `depth` levels as arrays (tree, node); node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(self.leaf.shape[1]).bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2, least: float = LEAST) -> Trees:
    """Boosted trees for the logistic loss; a leaf's value stays within the bounds its constrained ancestors set."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1) + np.arange(d) * bins
    sign = np.array(signs)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, inner = np.full(n, base), 2**depth - 1
    out = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            if len(rows) < 2:
                node[rows], low[2 * i + 1], high[2 * i + 1] = 2 * i + 1, low[i], high[i]
                continue
            flat = codes[rows].ravel()
            gs, hs = (np.bincount(flat, weights=np.repeat(v[rows], d), minlength=d * bins).reshape(d, bins).cumsum(1) for v in (g, h))
            gt, ht = gs[0, -1], hs[0, -1]
            lo, hi = low[i], high[i]
            left, right = np.clip(gs / (hs + l2), lo, hi), np.clip((gt - gs) / (ht - hs + l2), lo, hi)
            whole = np.clip(gt / (ht + l2), lo, hi)
            score = lambda v, a, b: 2 * v * a - v * v * (b + l2)
            gain = score(left, gs, hs) + score(right, gt - gs, ht - hs) - score(whole, gt, ht)
            gain[(hs < least) | (ht - hs < least) | (sign[:, None] * (right - left) < 0)] = -np.inf
            f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if not gain[f, b] > 1e-6 or b >= len(edges[f]):
                node[rows], low[2 * i + 1], high[2 * i + 1] = 2 * i + 1, lo, hi
                continue
            out[0][t, i], out[1][t, i] = f, edges[f][b]
            node[rows] = 2 * i + 1 + (x[rows, f] > edges[f][b])
            mid = (left[f, b] + right[f, b]) / 2
            low[2 * i + 1], high[2 * i + 1], low[2 * i + 2], high[2 * i + 2] = lo, hi, lo, hi
            if sign[f] > 0:
                high[2 * i + 1], low[2 * i + 2] = mid, mid
            elif sign[f] < 0:
                low[2 * i + 1], high[2 * i + 2] = mid, mid
        leaf = node - inner
        gs, hs = (np.bincount(leaf, weights=v, minlength=inner + 1) for v in (g, h))
        out[2][t] = rate * np.clip(gs / (hs + l2), low[inner:], high[inner:])
        margin += out[2][t][leaf]
    return Trees(*out, base)


def _stats_of(col: pa.Array) -> np.ndarray:
    parts = [statistics(data, offs) for _, _, data, offs in text_parts(col)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most max_rows labelled documents."""
    seen = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").cast("int").alias("__quality"))
    sample = F.broadcast(store(seen.orderBy(F.xxhash64("__id"), "__id").limit(max_rows), "quality-labels"))  # max_rows bounds it
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__quality")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stats_of(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(go, "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).orderBy("doc_id").select("r.y", "r.x").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    return x, got.column("y").to_numpy().astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees | None:
    """The model; None without labelled documents of both classes."""
    x, y = labelled_statistics(docs, labels, max_rows)
    return fit(x, y, list(FEATURES.values())) if 0 < y.sum() < len(y) else None


def _scored(rows: DataFrame, model: Trees | None, threshold: float, text: int, with_score: bool) -> DataFrame:
    """The rows whose text, at this position, passes; with a last column `score` if asked for."""
    from pyspark.sql import types as T

    arrays = None if model is None else (model.feature, model.cut, model.leaf, model.base)
    shared = rows.sparkSession.sparkContext.broadcast(arrays)  # of a fixed size

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = None if shared.value is None else Trees(*shared.value)
        for b in batches:
            p = trees.probability(_stats_of(b.column(text))) if trees is not None else np.ones(b.num_rows)
            keep = pa.array(p >= threshold)
            cols = [c.filter(keep) for c in b.columns]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p).filter(keep)] if with_score else cols, names=[*b.schema.names, "score"] if with_score else b.schema.names)

    extra = [T.StructField("score", T.DoubleType())] if with_score else []
    return rows.mapInArrow(go, T.StructType([*rows.schema.fields, *extra]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, score) of the documents that are kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scored(rows, train(docs, labels, max_rows), threshold, 1, True).select("doc_id", "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return _scored(docs, train(docs, labels, max_rows), threshold, docs.columns.index("text"), False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
