import hashlib
from collections import Counter, defaultdict

import pytest

from skarn.llm import mixing


def brute(rows, weights, default, total=None, seed=mixing.SEED):
    """[(doc_id, source, epoch, n, take)] by plain loops."""
    by = defaultdict(list)
    for doc, source, text in rows:
        n = len([w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
        if n:
            key = int(hashlib.md5(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:15], 16)
            by[source].append((key, doc is not None, doc or 0, n, doc))
    sums = {s: sum(x[3] for x in v) for s, v in by.items()}
    w = {s: weights.get(s, default) for s in by}
    out = []
    for s, v in by.items():
        left, epoch = (sum(sums.values()) if total is None else total) * w[s] // sum(w.values()), 0
        while left > 0:
            for _, _, _, n, doc in sorted(v):
                if left > 0:
                    out.append((doc, s, epoch, n, min(n, left)))
                    left -= n
            epoch += 1
    return out


ROWS = [(i, f"src{i % 4}", "w " * (i * 7 % 13 + 1)) for i in range(40)] + [(None, None, "a b c"), (None, None, "d"), (3, "src3", "x y"), (3, "src3", "x y"), (50, "src0", None), (51, "src0", " \n"), (52, "z", "q" * 50_000 + " r")]


@pytest.mark.parametrize("total", [None, 0, 7, 3000])
def test_equals_plain_loops(spark, total):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string").selectExpr("*", "1 AS g", "2 AS n", "3 AS epoch")
    got = Counter((r.doc_id, r.source, r.epoch, r.n_tokens, r.take_tokens) for r in mixing.mix(docs, total=total).collect())
    want = brute(ROWS, mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, total)
    assert got == Counter(want)


@pytest.mark.parametrize("total", [None, 7, 3000])
def test_documents_hold_what_the_mixture_takes(spark, total):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, text string").selectExpr("*", "length(text) AS n_chars", "1 AS g", "2 AS `__x`")
    out = mixing.mix_documents(docs, total=total)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in out.collect())
    want = Counter((d, s, take) for d, s, _, _, take in brute(ROWS, mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, total))
    assert got == want and out.filter("n_chars <> length(text)").isEmpty()


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    for d in (docs, docs.limit(0)):
        assert mixing.mix(d).count() == 0 and mixing.mix_documents(d).count() == 0


def test_weights_of_zero(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "b", "z")], "doc_id long, source string, text string")
    assert mixing.mix(docs, {"a": 0, "b": 0}, 0).count() == 0 and mixing.mix_documents(docs, {"a": 0, "b": 0}, 0).count() == 0
    got = mixing.mix(docs, {"a": 0}, 1, total=4).collect()
    assert [(r.doc_id, r.take_tokens) for r in sorted(got, key=lambda r: r.epoch)] == [(2, 1)] * 4


def test_names_of_its_own_columns(spark):
    names = "__mix_g string, g string, key long, n int, r int, id int, __mix_cut int, e int, o int, due int, copies int"
    docs = spark.createDataFrame([(i, f"s{i % 2}", "w " * (i + 1), *["v"] * 2, *[7] * 9) for i in range(9)], f"doc_id long, source string, text string, {names}")
    out = mixing.mix_documents(docs, {"s0": 3}, 1)
    assert out.columns == docs.columns
    plain = mixing.mix_documents(docs.select("doc_id", "source", "text"), {"s0": 3}, 1)
    rows = out.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
    assert {r["__mix_g"] for r in rows} == {"v"} and {r.due for r in rows} == {7}
