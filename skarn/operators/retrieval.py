"""Retrieval: vector, BM25 and hybrid ranked search, reranking, and the incremental index."""

from __future__ import annotations

import datetime
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions import columns as C
from skarn.operators.chunking import batches

K1, B, RRF_K = 1.2, 0.75, 60
TOKEN = "[\\p{L}\\p{N}]+"


def hash_embedder(dim: int = 64) -> Callable[[Sequence[str]], np.ndarray]:
    """T09 offline: a deterministic unit vector of hashed lower-case words; zeros for a text without any."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for word in t.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1 if h & 0x10000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def with_retry(call: Callable[[Sequence[str]], np.ndarray], limited: Callable[[Exception], bool], tries: int = 6, sleep: Callable[[float], None] | None = None) -> Callable[[Sequence[str]], np.ndarray]:
    """The embedder, tried again after min(2^n, 30) seconds when it is rate-limited; other errors pass."""
    import time

    wait = sleep or time.sleep

    def go(texts: Sequence[str]) -> np.ndarray:
        for n in range(tries):
            try:
                return call(texts)
            except Exception as e:
                if not limited(e) or n == tries - 1:
                    raise
                wait(min(2**n, 30))
        raise AssertionError

    return go


def embed_texts(texts: Sequence[str], embedder: Callable[[Sequence[str]], np.ndarray], most_items: int = 64, most_chars: int = 16000, clip: int = 8000) -> np.ndarray:
    """Vectors of the clipped texts, one call for each batch."""
    cut = [t[:clip] for t in texts]
    batch = np.array(batches([len(t) for t in cut], most_items, most_chars))
    parts = [np.asarray(embedder([cut[i] for i in np.flatnonzero(batch == b)]), np.float32) for b in range(int(batch.max()) + 1 if len(batch) else 0)]
    return np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)


def embed(rows: DataFrame, text: str, embedder: Callable[[Sequence[str]], np.ndarray], **bounds: int) -> DataFrame:
    """Rows with `vector`; the embedder runs in Arrow batches on executors."""
    from pyspark.sql import types as T

    spec = T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(vector=list(embed_texts(pdf[text].fillna("").tolist(), embedder, **bounds)))

    return rows.mapInPandas(go, spec)


def cosine_distance(vector: str, query: Sequence[float]) -> Column:
    """1 - cosine; null for a null vector or one without length, and for another dimension."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot, own = total(F.zip_with(v, q, lambda a, b: a * b)), F.sqrt(total(F.transform(v, lambda x: x * x)))
    norm = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    return F.when((F.size(vector) == len(query)) & (own > 0) & F.lit(norm > 0), 1 - dot / (own * (norm or 1.0)))


def vector_search(rows: DataFrame, query: Sequence[float], k: int, where: Column | None = None, id_: str = "id", vector: str = "vector") -> DataFrame:
    """K nearest by cosine distance among the rows that pass the filter; smaller is better, ties by id."""
    rows = rows if where is None else rows.filter(where)
    return rows.withColumn("distance", cosine_distance(vector, query)).filter("distance IS NOT NULL").orderBy("distance", id_).limit(k)


def postings(rows: DataFrame, id_: str = "id", text: str = "contextualized") -> DataFrame:
    """(id, term, tf, length) of every text; written partitioned by a hash of term it is the index."""
    terms = rows.select(F.col(id_).alias("id"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))).alias("term"))
    tf = terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.withColumn("length", F.sum("tf").over(Window.partitionBy("id")))


def bm25(rows: DataFrame, query: str, k: int | None, where: Column | None = None, id_: str = "id", text: str = "contextualized", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) by BM25 with ln(1 + (N - df + 0.5) / (df + 0.5)); larger is better, ties by id.

    Only terms of the query are exploded and counted; lengths come from a count of matches in the
    scan. Statistics are those of the filtered rows. Terms of the query count once.
    """
    import regex

    terms = sorted(set(regex.findall(TOKEN, query.lower())))
    rows = (rows if where is None else rows.filter(where)).select(F.col(id_).alias("id"), F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0)).alias("t"))
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    base = rows.select("id", F.size("t").alias("length"), F.filter("t", lambda x: F.array_contains(wanted, x)).alias("t"))
    total = F.broadcast(base.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length")))  # one row
    tf = base.filter("size(t) > 0").select("id", "length", F.explode("t").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = F.broadcast(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # one row for each term of the query
    scored = tf.join(df, "term").crossJoin(total)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    out = scored.groupBy("id").agg(F.round(F.sum(part), 9).alias("score"))  # rounded, so that equal texts tie
    return out if k is None else out.orderBy(F.desc("score"), "id").limit(k)


def rrf(first: DataFrame, second: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """(id, score) of two ranked lists (id, rank) by the sum of 1 / (constant + rank)."""
    both = first.select("id", F.col("rank").alias("a")).join(second.select("id", F.col("rank").alias("b")), "id", "full_outer")
    score = F.coalesce(1 / (constant + F.col("a")), F.lit(0.0)) + F.coalesce(1 / (constant + F.col("b")), F.lit(0.0))
    return both.select("id", "a", "b", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranked(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rank from 1 in an order; for lists already cut to a top-k, whose size bounds the one partition."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def hybrid_search(rows: DataFrame, query: str, vector: Sequence[float], k: int, where: Column | None = None, pool: int | None = None, hybrid: bool = True) -> DataFrame:
    """Rank fusion of the nearest vectors and the best texts; vectors alone without hybrid or a text to find."""
    n = pool or max(k * 3, 50)
    near = ranked(vector_search(rows, vector, n if hybrid else k, where).select("id", "distance"), ["distance", "id"])
    if not hybrid or not query.strip():
        return near.select("id", "rank", F.lit(None).cast("int").alias("text_rank"), F.lit(None).cast("double").alias("score"), "distance")
    text = ranked(bm25(rows, query, n, where), [F.desc("score"), "id"])
    return rrf(near, text, k).select("id", F.col("a").alias("rank"), F.col("b").alias("text_rank"), "score")


def meta_rerank(results: DataFrame, k: int, today: Column) -> DataFrame:
    """Results (rank, status, last_commit) in order of rank - 1 + penalty, then rank; the first k."""
    place = F.col("rank") - 1 + C.rank_penalty("status", "last_commit", today)
    return results.withColumn("place", place).orderBy("place", "rank").limit(k)


def reorder(n: int, said: Sequence[int]) -> list[int]:
    """Valid indices of a reply, each once, then the others in order."""
    first = [i for i in dict.fromkeys(said) if isinstance(i, int) and 0 <= i < n]
    return first + [i for i in range(n) if i not in set(first)]


def search(index: DataFrame, question: str, k: int, embedder: Callable[[Sequence[str]], np.ndarray], repos: Sequence[str] | None = None, lang: str | None = None, today: datetime.date | None = None, rewrite: Callable[[str], str] | None = None, rerank: Callable[[str, list], Sequence[int]] | None = None, hybrid: bool = True) -> DataFrame:
    """Rewrite, embed, search three times k, reorder by the hook, rerank by status and age.

    Hooks that fail or answer blank leave things as they are. `today` is a parameter; without it
    nothing is reranked by age and status.
    """
    text = question
    if rewrite:
        try:
            text = rewrite(question).strip() or question
        except Exception:  # a hook's failure keeps the question
            text = question
    vector = embed_texts([text], embedder)[0].tolist()
    found = hybrid_search(index, text, vector, k * 3, C.search_filter(repos, lang), hybrid=hybrid)
    order = [F.desc("score"), "id"] if hybrid and text.strip() else ["distance", "id"]
    hits = ranked(found.drop("rank"), order)
    if rerank:
        rows = hits.join(index.select("id", "text"), "id").orderBy("rank").collect()  # at most 3 k
        try:
            said = reorder(len(rows), rerank(text, rows))
        except Exception:  # a hook's failure keeps the order
            said = list(range(len(rows)))
        places = index.sparkSession.createDataFrame([(rows[i]["id"], p + 1) for p, i in enumerate(said)], "id string, rank int")
        hits = hits.drop("rank").join(F.broadcast(places), "id")
    out = hits.join(index, "id")
    return meta_rerank(out, k, F.lit(today).cast("date")) if today else out.orderBy("rank").limit(k)


# ---------------------------------------------------------------- incremental index


def attach_metadata(rows: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """last_commit and status by key, source by repo; '' where there is none."""
    out = rows.join(files.select("key", "last_commit", "status"), "key", "left").join(repos.select("repo", "source"), "repo", "left")
    return out.fillna("", ["last_commit", "status", "source"])


def changes(walked: DataFrame, indexed: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(to index, to delete) by key.

    walked: (key, repo, sha); indexed: (key, repo, sha, embed_ver). A file is indexed if it is new,
    its sha differs or it was embedded by another version; deleted are those and the vanished ones
    of repositories that were walked.
    """
    state = indexed.groupBy("key").agg(F.max("repo").alias("repo"), F.max("sha").alias("old_sha"), F.min("embed_ver").alias("old_ver"))
    todo = walked.join(state.drop("repo"), "key", "left").filter(~(F.col("sha").eqNullSafe(F.col("old_sha")) & F.col("old_ver").eqNullSafe(F.lit(version)))).drop("old_sha", "old_ver")
    gone = state.join(walked.select("key"), "key", "left_anti").join(walked.select("repo").distinct(), "repo", "left_semi").select("key")
    return todo, gone.union(todo.join(state, "key", "left_semi").select("key"))


def upsert(indexed: DataFrame, new: DataFrame, delete: DataFrame) -> DataFrame:
    """The next version of the index: without the deleted keys, with the new rows."""
    return indexed.join(delete.select("key").distinct(), "key", "left_anti").unionByName(new, allowMissingColumns=True)


def dry_run_cost(chunks: DataFrame, per_million: float = 0.15) -> DataFrame:
    """Characters, tokens at 4 characters each, and their price."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).withColumn("tokens", F.floor(F.col("chars") / 4)).withColumn("usd", F.col("tokens") * per_million / 1e6)
