from itertools import combinations

import numpy as np
import pytest

from skarn.llm import toxicity as t


def brute_kernel(a, b):
    total = 0.0
    for i in combinations(range(len(a)), t.ORDER):
        for j in combinations(range(len(b)), t.ORDER):
            if all(a[x] == b[y] and a[x] > 0 for x, y in zip(i, j, strict=True)):
                total += t.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_equals_enumeration():
    words = [b"idiot", b"i.d.i.o.t", b"idxiot", b"moron", b"ab", b"aaaa"]
    u = t._encode(words)
    k = t.kernel(u, u)
    for i, a in enumerate(u):
        for j, b in enumerate(u):
            assert np.isclose(k[i, j], brute_kernel(a, b), rtol=1e-4), (words[i], words[j])
    assert np.allclose(t.self_kernel(u), np.diag(k), rtol=1e-5)


def test_units():
    text = b"well, i-d-i-o-t! i d i o t and you *moron* a b .x"
    assert units(text) == {b"well", b"i.d.i.o.t", b"and", b"you", b"moron", b"a.b..x"}
    assert units(b"so i - d - i - o - t it is") == {b"i...d...i...o...t"}
    assert units(b"the m * o * r * o * n") == {b"the", b"m...o...r...o...n"}
    assert units("tu es d é b i l ici".encode()) == {"d.é.b.i.l".encode(), b"ici"}
    assert units("été \u201cidiot\u201d l\u2019idiot you\u00a0moron à é".encode()) == {"été".encode(), b"idiot", b"l...idiot", b"you", b"moron"}
    assert units(b"a b 1 2 word c d") == {b"word"}


def units(text):
    norm, s, e = t.units(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return {norm[a:b].tobytes() for a, b in zip(s, e, strict=True)}


def test_no_unit_crosses_a_text():
    texts = [b"x y", b"z w", b"", b"one two", b"q"]
    offs = np.cumsum([0, *map(len, texts)])
    norm, s, e = t.units(np.frombuffer(b"".join(texts), np.uint8), offs)
    assert {norm[a:b].tobytes() for a, b in zip(s, e, strict=True)} == {b"one", b"two"}


def test_sentences():
    text = b"one two. three four! five v1.5 six\nseven " + b"word " * 130
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    _, s, _ = t.units(data, offs)
    got = t.sentences(data, offs, s).tolist()
    assert got[:7] == [0, 0, 1, 1, 2, 2, 3] and got[-1] == 3 + 131 // t.LONGEST and sorted(got) == got


def test_correction_counts_only_what_can_be_significant():
    k, m = t._testable({1: 100_000, 2: 900, 6: 50, 20: 10}, 0.1)
    assert m * 0.1**k < t.SIGNIFICANCE <= (m + {1: 100_000, 2: 900, 6: 50, 20: 10}.get(k - 1, 0)) * 0.1 ** (k - 1)
    assert t._testable({}, 0.5)[1] == 0


@pytest.fixture(scope="module")
def data(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")


def test_planted_spellings_and_clean_documents(spark, data):
    docs, labels = data
    clean = docs.join(labels.filter("toxic = 0 AND quality = 1"), "doc_id", "left_semi").filter("length(text) BETWEEN 300 AND 3000").orderBy("doc_id").limit(24).collect()
    kinds = [["you idiot", "a moron", "worthless scum"], ["i.d.i.o.t", "m-o-r-o-n,", "s t u p i d", "l*o*s*e*r"], ["idiiot", "morron", "stuupid", "loserr"]]
    planted = []
    for i, r in enumerate(clean):
        words = r.text.split(" ")
        for k, w in enumerate(kinds[i % 3]):
            words.insert((k + 1) * len(words) // 6, w)
        planted.append((10_000_000 + i, " ".join(words)))
    every = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {r.doc_id for r in t.find_toxic(every, labels).collect()}
    assert sum(10_000_000 + i in found for i in range(len(clean))) >= 0.9 * len(clean)
    good = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    assert len(found & good) <= 0.01 * len(good)
    shuffled = {r.doc_id for r in t.find_toxic(every, labels, most=0).collect()}
    assert shuffled == found


def plain_kernel(a, b):
    """The textbook recursion, letter by letter."""
    n, m, d = len(a), len(b), t.DECAY
    last = [[1.0] * (m + 1) for _ in range(n + 1)]
    for _ in range(t.ORDER - 1):
        now = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(1, n + 1):
            run = 0.0
            for j in range(1, m + 1):
                run = d * run + (d * d * last[i - 1][j - 1] if a[i - 1] == b[j - 1] and a[i - 1] != 46 else 0.0)
                now[i][j] = d * now[i - 1][j] + run
        last = now
    return sum(d * d * last[i][j] for i in range(n) for j in range(m) if a[i] == b[j] and a[i] != 46)


def brute_like(a, b):
    own = plain_kernel(a, a) * plain_kernel(b, b)
    return plain_kernel(a, b) / own**0.5 if own else 0.0


def test_recursion_equals_enumeration():
    for a, b in ((b"idiot", b"i.d.i.o.t"), (b"moron", b"morxon"), (b"aaaa", b"aabaa"), (b"ab", b"ab")):
        assert np.isclose(plain_kernel(a, b), brute_kernel(t._encode([a])[0], t._encode([b])[0]))


def test_application_equals_brute_force(spark, data):
    import re

    docs, labels = data
    model, least = t.train(docs, labels)
    some = docs.filter("length(text) BETWEEN 50 AND 900").orderBy("doc_id").limit(25).collect()
    planted = {-1: "You i d i o t. Nothing else! A moron, a m-o-r-o-n", -2: "a clean sentence", -3: "idiot"}
    rows = {r.doc_id: r.text for r in some} | planted
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    cache = {}

    def unit_score(u):
        if u not in cache:
            parts = t._windows(u)
            like = np.array([max(brute_like(p, m) for p in parts) for m in model.texts])
            f = float((like**t.POWER) @ model.weight) if like[: model.toxic].max() >= t.NEAR else 0.0
            cache[u] = f if f > 0 and f >= t.TRACE * -model.bias else 0.0
        return cache[u]

    want = {}
    for i, text in rows.items():
        total, sentence = 0.0, r"[^.!?\n]*(?:[.!?](?!\s|$)[^.!?\n]*)*"
        for part in re.findall(sentence, text.lower()):
            tokens, found, run = part.split(), [], []
            for w in [*tokens, "endofline"]:
                letters = [c for c in w if c.isalpha()]
                if len(letters) <= 1:
                    run.append(w)
                    continue
                if sum(any(c.isalpha() for c in x) for x in run) >= 3:
                    found.append(" ".join(run))
                run = []
                if len(letters) >= t.ORDER and w != "endofline":
                    found.append(w)
            units_ = [re.sub(r"^\.+|\.+$", "", "".join(c if c.isalpha() else "." for c in f)).encode() for f in found]
            for a in range(0, len(units_), t.LONGEST):
                total += max(0.0, sum(unit_score(u) for u in set(units_[a : a + t.LONGEST])) + model.bias)
        if total >= least:
            want[i] = total
    hits = t.toxic_units(frame, model)
    scores = {r.unit: r.score for r in hits.collect()}
    for u, f in scores.items():
        assert np.isclose(f, unit_score(u.encode()), atol=1e-3), u
    assert all(u.decode() in scores for u, f in cache.items() if f > 0.01)
    found = {r.doc_id: r.score for r in t.find_toxic(docs.unionByName(frame.filter("doc_id < 0")), labels).collect()}
    assert {i for i in found if i in rows} == set(want) and {-1, -3} <= set(want) and -2 not in want
    for i, f in want.items():
        assert np.isclose(found[i], f, atol=0.05), i


def test_held_out_labels(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").filter("lang = 'en'").select("doc_id"), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    test = labels.filter(fold == 1)
    found = t.find_toxic(docs.join(test, "doc_id", "left_semi").unionByName(docs.join(labels.filter(fold == 0), "doc_id", "left_semi")), labels.filter(fold == 0)).select("doc_id")
    bad, good = test.filter("toxic = 1"), test.filter("toxic = 0")
    assert bad.join(found, "doc_id", "left_semi").count() >= 0.9 * bad.count()
    assert good.join(found, "doc_id", "left_semi").count() <= 0.01 * good.count()


def test_odd_rows(spark, data):
    docs, labels = data
    insult = "stupid idiot moron loser scum trash pathetic clown"
    odd = spark.createDataFrame([(None, insult), (-1, None), (-2, ""), (-3, insult), (-3, insult), (-4, "word " * 60_000 + insult), (-5, "x" * 100_000)], "doc_id long, text string")
    every = docs.unionByName(odd).selectExpr("*", "1 AS unit", "2 AS h", "3 AS toxic", "4 AS __id", "5 AS id", "6 AS y", "7 AS sid")
    got = t.find_toxic(every, labels).filter("doc_id IS NULL OR doc_id < 0").collect()
    assert sorted((r.doc_id or 0) for r in got) == [-4, -3, -3, 0]
    assert t.find_toxic(odd, labels.limit(0)).count() == 0 and t.find_toxic(every.limit(0), labels).count() == 0
    assert t.find_toxic(odd, spark.createDataFrame([(None, 1), (-3, None)], "doc_id long, toxic int")).count() == 0
