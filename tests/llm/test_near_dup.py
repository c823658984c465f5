import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from skarn.llm import near_dup as nd
from skarn.llm.common import text_parts


def shingle_set(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else {text} if text else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def signature(texts):
    parts = []
    for a, _, data, offs in text_parts(pa.array([t.lower() for t in texts]), 50):
        docs, values = nd.min_max(*nd.shingles(data, offs))
        parts += list(zip((docs + a).tolist(), values, strict=True))
    return dict(parts)


def test_min_max_equals_brute_force():
    rng = np.random.default_rng(0)
    doc, x = np.array([0, 0, 0, 2, 2]), rng.integers(0, 2**63, 5, dtype=np.uint64)
    docs, values = nd.min_max(doc, x)
    assert docs.tolist() == [0, 2]
    for d, row in zip(docs, values, strict=True):
        own = [int(h) >> 32 for h in x[doc == d]]
        for k in range(nd.PERMS):
            y = [(h * int(nd._A[k]) + int(nd._B[k])) % 2**32 for h in own]
            assert (row[2 * k], row[2 * k + 1]) == (min(y), max(y))


def test_estimate_is_unbiased():
    words = [f"w{i}" for i in range(400)]
    a = " ".join(words)
    errors = []
    for cut in range(40, 240, 4):
        b = " ".join(words[cut:] + [f"z{cut}_{i}" for i in range(cut)])
        s = signature([a, b])
        low = [np.asarray(s[i], np.uint32).astype(np.uint8)[None] for i in (0, 1)]
        errors.append(float(nd.similarity(*low)[0]) - jaccard(shingle_set(a), shingle_set(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def groups(rows):
    """Components of the exact Jaccard similarity by pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    return {(max(a, b), min(a, b)): s for a, b in combinations(sets, 2) if (s := jaccard(sets[a], sets[b])) >= 0.3}


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").filter("length(text) < 6000").collect()]
    pairs = groups(rows)
    found = {r.doc_id: r.duplicate_of for r in nd.near_duplicates(docs.filter("length(text) < 6000")).collect()}
    root = lambda i: found.get(i, i)
    sure = [p for p, s in pairs.items() if s >= 0.7]
    assert len(sure) > 50 and np.mean([root(a) == root(b) for a, b in sure]) > 0.99
    linked = {i for p, s in pairs.items() if s >= 0.4 for i in p}
    assert set(found) <= linked and all(v < k for k, v in found.items())


def test_large_and_mixed_buckets(spark):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(k * 1000 + i, base[k] + f" tail{i % 5}") for k in range(3) for i in range(300)]
    got = {r.doc_id: r.duplicate_of for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k * 1000 + i: k * 1000 for k in range(3) for i in range(1, 300)}


def test_leader_pass_splits_a_bucket():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 256, (3, 2 * nd.PERMS), dtype=np.uint8)
    sig = kinds[[0, 1, 0, 2, 1, 2, 0]]
    doc = np.arange(7)
    pairs, lead = nd.leaders(np.zeros(7, np.int64), doc, sig, 0.5)
    assert lead.tolist() == [True, True, False, True, False, False, False]
    assert sorted(map(tuple, np.concatenate(pairs).tolist())) == [(2, 0), (4, 1), (5, 3), (6, 0)]


def mixed(kinds, shares):
    """A signature that takes the given numbers of values from the given ones, in turn."""
    return np.concatenate([k[a:b] for k, (a, b) in zip(kinds, shares, strict=True)])


def test_late_leader_meets_closed_members():
    a, b, c = np.random.default_rng(5).integers(0, 256, (3, 2 * nd.PERMS), dtype=np.uint8)
    half = mixed((a, b), ((0, nd.PERMS), (nd.PERMS, None)))
    pairs, lead = nd.leaders(np.zeros(3, np.int64), np.arange(3), np.stack([a, half, b]), 0.45)
    assert lead.tolist() == [True, False, True]
    assert sorted(map(tuple, np.concatenate(pairs).tolist())) == [(1, 0), (1, 2)]
    # Two members that are no leaders connect two leaders, over three batches of one bucket.
    t = 2 * nd.PERMS // 3
    x, y = mixed((a, c, c), ((0, t), (t, 2 * t), (2 * t, None))), mixed((b, c, b), ((0, t), (t, 2 * t), (2 * t, None)))
    x[-t // 4 :], y[-t // 4 :] = a[-t // 4 :], b[-t // 4 :]
    x[: t // 4], y[: t // 4] = c[: t // 4], c[: t // 4]
    near = lambda p, q: nd.similarity(p[None], q[None])[0]
    th = min(near(a, x), near(b, y), near(x, y)) - 1e-9
    assert th > max(near(a, b), near(a, y), near(b, x))
    rows = [pa.RecordBatch.from_pydict({"b": [0] * len(s), "d": d, "s": [v.tobytes() for v in s]}) for d, s in (([1, 2], [a, b]), ([3], [x]), ([4, 5], [y, y]))]
    edges = [(u, v) for out in nd._leader_pass(th)(iter(rows)) for u, v, same in zip(*(c.to_pylist() for c in out.columns), strict=True) if same]
    assert sorted(edges) == [(3, 1), (4, 2), (4, 3), (5, 4)]


def test_original_in_the_middle(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words if i == 100 else [f"z{i}_{j}" if rng.random() < 0.08 else w for j, w in enumerate(words)])) for i in range(200)]
    got = {r.doc_id: r.duplicate_of for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 190 and 100 in got


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(200, 100), (300, 200), (300, 100)]
    got = {r.u: r.v for r in nd.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {200: 100, 300: 100}
    assert nd.components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_odd_rows(spark):
    long = "lorem " * 3 + " ".join(f"t{i}" for i in range(40_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "", None), (None, "one two three four", "a"), (None, "one two three four", "b"), (5, "hi", "a"), (6, "HI!", "a"), (7, "?!?!", "a"), (8, "?!?!", "a"), (9, long, "x"), (10, long + " end", "y"), (11, "alpha beta gamma", "z"), (11, "alpha beta gamma", "z"), (12, "hello there", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string").selectExpr("*", "1 AS lead", "2 AS __dup_id", "3 AS sig")
    assert {(r.doc_id, r.duplicate_of) for r in nd.near_duplicates(docs).collect()} == {(6, 5), (8, 7), (10, 9)}
    out = nd.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 1, 2, 3, 5, 7, 9, 11, 12]
    assert nd.deduplicate(docs.limit(0)).count() == 0 and nd.near_duplicates(docs.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    texts, want = [], {}
    for k in range(400):
        n = 240 + k % 7
        cut = (76 if k % 2 else 100) + k % 3
        words = [f"p{k}_{i}" for i in range(n)]
        pair = [" ".join(words), " ".join(words[cut:] + [f"q{k}_{i}" for i in range(cut)])]
        want[2 * k + 1] = jaccard(*map(shingle_set, pair))
        texts += pair
    got = {r.doc_id: r.duplicate_of for r in nd.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    reach = [i for i, s in want.items() if s >= nd.THRESHOLD]
    assert len(reach) == 200 and max(want[i] for i in reach) < 0.55 and np.mean([got.get(i) == i - 1 for i in reach]) >= 0.98
    assert all(i in want and got[i] == i - 1 for i in got) and sum(want[i] < nd.THRESHOLD for i in got) <= 1


def test_repeated_ids_and_clashing_names(spark):
    same = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (1, None), (1, ""), (2, ""), (2, ""), (None, None), (None, None), (3, same), (3, same), (4, same + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS __dup_rank", "2 AS __dup_id", "3 AS id", "4 AS r", "5 AS n")
    got = nd.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (0, ""), (1, ""), (2, ""), (3, same)]
    assert {tuple(r)[2:] for r in got.collect()} == {(1, 2, 3, 4, 5)}


def test_a_hub_with_many_neighbours(spark):
    edges = spark.range(1, 3000).selectExpr("id AS u", "0L AS v").union(spark.range(3001, 3004).selectExpr("id AS u", "id - 1 AS v"))
    got = {r.u: r.v for r in nd.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 3000), 0), **dict.fromkeys(range(3001, 3004), 3000)}
