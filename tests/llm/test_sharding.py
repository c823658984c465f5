from itertools import product

import numpy as np
import pytest

from skarn.llm import sharding as s


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 4), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_neighbours_in_order(dims, bits):
    points = np.array(list(product(range(1 << bits), repeat=dims)))
    h = s.hilbert(list(points.T), bits)
    order = np.argsort(h)
    assert (h[order] == np.arange(len(points))).all()
    assert (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()


def test_files_prune_by_every_dimension(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = s.write_shards(docs, str(tmp_path / "out"), target=40_000).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert len(manifest) > 5 and sum(m.rows for m in manifest) == docs.count()
    for r in back.collect():
        m = next(x for x in manifest if x.shard == r.shard)
        assert all(m[f"min_{c}"] <= r[c] <= m[f"max_{c}"] for c in s.DIMS)
    for c in ("source", "lang"):
        value = back.first()[c]
        assert sum(m[f"min_{c}"] <= value <= m[f"max_{c}"] for m in manifest) < len(manifest)
    sizes = {r.shard: r["sum"] for r in back.groupBy("shard").agg({"n_chars": "sum"}).withColumnRenamed("sum(n_chars)", "sum").collect()}
    longest = docs.agg({"n_chars": "max"}).first()[0]
    assert max(sizes.values()) < 40_000 + longest


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a", "en", 5), (1, "a", "en", 5), (None, None, None, None), (2, None, "en", -3), (3, "b", None, 2_000_000_000), (4, "b", "fr", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long").selectExpr("*", "'t' AS text", "1 AS hilbert", "2 AS shard", "3 AS g")
    got = s.shard(docs, target=10).collect()
    assert len(got) == 6 and len({r.hilbert for r in got if r.doc_id == 1}) == 1
    assert {r.doc_id_cell for r in got if r.doc_id is None} == {0}
    assert sum(m.rows for m in s.write_shards(docs, str(tmp_path / "o"), target=10).collect()) == 6
    assert s.shard(docs.limit(0)).count() == 0


def test_ids_over_all_64_bits_and_clashing_names(spark, tmp_path):
    ids = [-(2**63), -(2**62), 0, None, 2**62, 2**63 - 1]
    docs = spark.createDataFrame([(i, "s", "en", 5, 1, 7) for i in ids], "doc_id long, source string, lang string, n_chars long, shard int, __id int")
    got = {r.doc_id: r.doc_id_cell for r in s.curve(docs).collect()}
    assert got[-(2**63)] == 0 and got[2**63 - 1] == 15 and got[0] == 8 and got[None] == 0
    manifest = s.write_shards(docs, str(tmp_path / "out"), target=10).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sum(r["rows"] for r in manifest) == 6 and back.columns[:6] == docs.columns
    assert {(r.doc_id, r.shard, r["__id"]) for r in back.collect()} == {(i, 1, 7) for i in ids}
    assert sorted({r._shard for r in back.collect()}) == sorted(r.shard for r in manifest)
