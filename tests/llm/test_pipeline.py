"""The pipeline stage by stage against brute force over the smallest tables."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from test_mixing import brute as mixed
from test_near_dup import signature
from test_quality import stats
from test_secrets import brute as secrets_in

import corpus_pipeline as cp
from skarn.llm import mixing, near_dup, quality, secrets


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows before each stage and after the last, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mix", "best_fit_packing"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality(spark, sf_dir, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r.doc_id for r in stages[0].collect() if model.probability(stats([r.text]))[0] >= quality.THRESHOLD}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_one_of_each_group_stays(stages):
    rows = {r.doc_id: r.text for r in stages[1].collect()}
    sig = {i: s for i, t in rows.items() if t and (s := signature([t]).get(0)) is not None}
    low = {i: np.asarray(s, np.uint32).astype(np.uint8)[None] for i, s in sig.items()}
    by = defaultdict(set)
    for i, s in sig.items():
        for b in near_dup.band_hashes(np.asarray(s, np.uint32)[None])[0].tolist():
            by[b].add(i)
    root = {i: i for i in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted({p for m in by.values() for p in combinations(sorted(m), 2)}):
        if near_dup.similarity(low[a], low[b])[0] >= near_dup.THRESHOLD:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    want = {i for i in rows if top(i) == i}
    assert {r.doc_id for r in stages[2].collect()} == want and len(want) < len(rows)


def test_secrets_are_masked(stages):
    def clean(text):
        for a, e, _ in reversed(secrets_in(text)):
            text = text[:a] + secrets.MASK + text[e:]
        return text

    before = {r.doc_id: clean(r.text) for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert {i: r.text for i, r in after.items()} == before and all(r.n_chars == len(r.text) for r in after.values())


def test_mixture(stages):
    want = mixed([(r.doc_id, r.source, r.text) for r in stages[3].collect()], mixing.WEIGHTS, mixing.DEFAULT_WEIGHT)
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in stages[4].collect())
    assert got == Counter((d, s, take) for d, s, _, _, take in want)


def test_packing_and_run(spark, sf_dir, stages):
    words = Counter()
    for r in stages[4].collect():
        words[r.doc_id] += len(r.text.split())
    for rows in (stages[5].collect(), cp.run(spark, sf_dir).collect()):
        got = Counter()
        for r in rows:
            assert sum(r.lengths) == r.fill <= 2048
            for d, n in zip(r.doc_ids, r.lengths, strict=True):
                got[d] += n
        assert got == words


def test_empty_documents(spark, sf_dir, stages):
    docs = stages[0].limit(0)
    for _, f in cp.STAGES:
        docs = f(spark, docs, sf_dir)
        assert docs.count() == 0


def test_odd_rows_through_all_stages(spark, sf_dir):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    secret = "the key is 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b and more words follow here for a while"
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "a null id and source with some words", "en", None, 36), (None, "a null id and source with some words", "en", None, 36), (-1, "", "en", "s", 0), (-2, None, "en", "s", None), (-3, "tie of words", "en", "s", 12), (-3, "tie of words", "en", "s", 12), (-4, "word " * 30_000, "en", "s", 150_000), (-5, secret, "en", "s", len(secret))],
        base.schema,
    )
    clash = {c: F.lit(7) for c in ("id", "r", "n", "score", "g", "key", "__mix_g", "__dup_rank", "shard", "bin_id", "h", "s")}
    docs = base.unionByName(odd).withColumns(clash)
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns, name
            out = cp.store(out, "test")
            assert {tuple(r[c] for c in clash) for r in out.collect()} == {(7,) * len(clash)}, name
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0, name
        docs = out
    rows = docs.collect()
    assert rows and all(sum(r.lengths) == r.fill <= 2048 for r in rows)
