import numpy as np
import pytest

from skarn.llm import neighbours as a


def exact(x, k):
    x = x.astype(np.float64)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    return np.argsort(d2, 1, kind="stable")[:, :k], np.sqrt(np.sort(d2, 1)[:, :k])


def recall(rows, ids, near, k):
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, set()).add(r.neighbour_id)
    return np.mean([len(found[i] & set(np.asarray(n).tolist())) / k for i, n in zip(ids, near, strict=True)])


@pytest.mark.parametrize("kind", ["table", "clusters", "noise"])
def test_recall_of_every_row(spark, kind):
    rng = np.random.default_rng(2)
    if kind == "table":
        df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
        pdf = df.toPandas()
        ids, x = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"])
    else:
        n, d = 1500, 32
        x = rng.standard_normal((n, d)) + (rng.standard_normal((30, d))[rng.integers(0, 30, n)] * 4 if kind == "clusters" else 0)
        x, ids = x.astype(np.float32), np.arange(n) * 3
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    near, dist = exact(x, a.K)
    rows = a.nearest(df, block=400, chunk=300).collect()
    assert len(rows) == a.K * len(ids)
    assert recall(rows, ids, ids[near], a.K) >= 0.9
    first = {r.vec_id: r.distance for r in rows if r["rank"] == 1}
    assert np.mean([np.isclose(first[i], d[0], rtol=1e-3, atol=1e-3) for i, d in zip(ids, dist, strict=True)]) > 0.9


def test_scan_keeps_all_pairs_within_bounds_when_it_never_guesses():
    rng = np.random.default_rng(0)
    q, x = rng.standard_normal((40, 48)).astype(np.float32), rng.standard_normal((300, 48)).astype(np.float32)
    d2 = ((q[:, None].astype(np.float64) - x[None]) ** 2).sum(2)
    bound = np.sort(d2, 1)[:, 9]
    blocks = lambda v: [v[:, :16], v[:, 16:32], v[:, 32:]]
    i, j, got = a.adaptive_scan(blocks(q), bound, blocks(x), epsilon=1e9)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(d2 <= bound[:, None] * (1 + 1e-9))), strict=True))
    assert np.allclose(got, d2[i, j], rtol=1e-5)
    guess = a.adaptive_scan(blocks(q), bound, blocks(x))
    assert len(guess[0]) >= 0.95 * len(i)


def test_block_search_is_exact_when_it_never_guesses():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((150, 20)), 2, 0).astype(np.float32)  # pairs of equal vectors
    ids = rng.permutation(300)
    got = list(a.search_block(ids, [x[:, :16], x[:, 16:]], np.full(300, np.inf), ids, [x[:, :16], x[:, 16:]], 5, 1e9, part=70, step=64))
    q, near, d2 = (np.concatenate(c) for c in zip(*got, strict=True))
    full = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2)
    np.fill_diagonal(full, np.inf)
    for r, i in enumerate(ids):
        want = sorted(zip(full[r].round(9), ids, strict=True))[:5]
        mine = sorted(zip(d2[q == i].round(9), near[q == i], strict=True))
        assert [m[1] for m in mine] == [w[1] for w in want]


def test_all_lists_without_guesses_are_an_exact_search(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    near, _ = exact(x, a.K)
    rows = a.nearest(df, every=20, probes=1 << 20, lists=7, block=30, chunk=3, epsilon=1e9).collect()
    assert len(rows) == 20 * a.K and recall([r for r in rows], [*range(0, 400, 20)], near[::20], a.K) == 1.0


def test_a_third_of_the_rows_in_one_place(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = a.nearest(df, block=50, chunk=20).collect()
    assert len(rows) == 9000
    copies = sorted((r["rank"], r.neighbour_id) for r in rows if r.vec_id == 300)
    assert copies == [(i + 1, 3 * i) for i in range(10)]


def test_query_takes_every_row_divisible_by_twenty(spark):
    d = "/root/testdata/sf0.01"
    pdf = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids = pdf["vec_id"].to_numpy()
    near, _ = exact(np.stack(pdf["embedding"]), a.K)
    rows = a.query(spark, d).collect()
    q = ids % 20 == 0
    assert {r.vec_id for r in rows} == set(ids[q].tolist()) and len(rows) == a.K * q.sum()
    assert recall(rows, ids[q], [ids[x] for x in near[q]], a.K) >= 0.9


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0]), (7, [None, 1.0]), (8, [float("nan"), 0.0]), (None, [0.0, 0.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS list", "3 AS block")
    got = [(r.vec_id, r["rank"], r.neighbour_id, round(r.distance, 3)) for r in a.nearest(df).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 1.414), (3, 1, 1, 1.0), (3, 2, 2, 1.414)]
    assert a.nearest(df.limit(0)).count() == 0 and a.nearest(df.filter("vec_id = 1")).count() == 0
    twins = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.neighbour_id) for r in a.nearest(twins, k=2).orderBy("vec_id", "rank").collect()][:4] == [(0, 1), (0, 2), (1, 0), (1, 2)]
