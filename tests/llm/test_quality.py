import re

import numpy as np
import pyarrow as pa

from skarn.llm import quality as q
from skarn.llm.common import text_parts

NAMES = list(q.FEATURES)


def stats(texts):
    return np.concatenate([q.statistics(d, o) for _, _, d, o in text_parts(pa.array(texts, pa.string()), 60)])


def brute(text):
    """Some of the statistics, word by word."""
    words = [w for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]
    lines = [x for x in text.split("\n") if x]
    solid = len([b for b in text.encode() if b not in b" \t\n\r\f\v"])
    n = max(1, len(words))
    return {
        "log_words": np.log1p(len(words)), "word_length": sum(len(w.encode()) for w in words) / n, "symbol_share": sum(c in "#$%&*<>{}[]^~\\@=+_" for c in text) / max(1, solid),
        "upper_share": sum("A" <= c <= "Z" for c in text) / max(1, sum(c.isascii() and c.isalpha() for c in text)), "exclaim_per_word": text.count("!") / n, "distinct_words": len(set(words)) / n,
        "repeat_share": sum(a == b for a, b in zip(words, words[1:])) / n, "top_word_share": max(map(words.count, words), default=0) / n, "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "digit_share": sum("0" <= c <= "9" for c in text) / max(1, solid), "pipes_per_word": text.count("|") / n, "stops_per_word": sum(c in ".?" for c in text) / n, "words_per_line": len(words) / max(1, len(lines)),
    }


def test_statistics_equal_brute_force():
    texts = ["", "a", "A b!! c? A b", "one one one\none one one\n\n| x | y |", "été à la été 12 3\n#tag @me", "x" * 500 + " y", "!!!", "a b c d e f a b c d e f"]
    got = stats(texts)
    for row, text in zip(got, texts, strict=True):
        for name, want in brute(text).items():
            assert np.isclose(row[NAMES.index(name)], want), (text, name)
    assert np.allclose(stats(texts[::-1])[::-1], got)
    grams = NAMES.index("distinct_grams")
    assert np.isclose(got[7, grams], 6 / 8) and got[1, grams] == 1 and got[0, grams] == 0


def walk(trees, x):
    total = trees.base
    for t in range(len(trees.feature)):
        node = 0
        while node < trees.feature.shape[1]:
            node = 2 * node + 1 + int(x[trees.feature[t, node]] > trees.cut[t, node])
        total += trees.leaf[t, node - trees.feature.shape[1]]
    return total


def test_flat_trees_and_monotonic_constraints():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(size=600) * 0.7) > 0).astype(float)
    trees = q.fit(x, y, [1, 0, -1, 0], trees=30)
    assert np.allclose(trees.margin(x[:50]), [walk(trees, r) for r in x[:50]])
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.8
    for f, sign in ((0, 1), (2, -1)):
        for base in x[:40]:
            line = np.repeat(base[None], 60, 0)
            line[:, f] = np.linspace(-3, 3, 60)
            assert (sign * np.diff(trees.margin(line)) >= -1e-12).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    x, y = q.labelled_statistics(docs, labels)
    hold = np.arange(len(y)) % 3 == 0
    trees = q.fit(x[~hold], y[~hold], list(q.FEATURES.values()))
    keep = trees.probability(x[hold]) >= q.THRESHOLD
    bad, good = y[hold] == 0, y[hold] == 1
    assert keep[good].mean() > 0.985 and (~keep[bad]).mean() > 0.9


def test_scores_equal_single_documents(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = q.train(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: p for r in rows if (p := trees.probability(stats([r.text]))[0]) >= q.THRESHOLD}
    got = {r.doc_id: r.score for r in q.score(docs, labels).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[i], want[i]) for i in got)


def test_odd_rows(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    odd = spark.createDataFrame([(None, "plain words of a text", 1), (7, None, 2), (7, "", 3), (8, "word " * 200_000, None), (8, "word " * 200_000, None)], "doc_id long, text string, score int")
    every = docs.select("doc_id", "text").unionByName(odd, allowMissingColumns=True).withColumnsRenamed({"score": "quality"}).selectExpr("*", "1 AS score", "2 AS __id")
    kept = q.keep_good(every, labels)
    assert kept.columns == every.columns
    model = q.train(every, labels)
    want = sum(model.probability(stats([r.text or ""]))[0] >= q.THRESHOLD for r in every.select("text").collect())
    assert kept.count() == want == q.score(every, labels).count()
    nobody = labels.limit(0)
    assert q.keep_good(odd, nobody).count() == 5 and {r.score for r in q.score(odd, nobody).collect()} == {1.0}
    mixed = spark.createDataFrame([(7, None, None), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert q.keep_good(odd, mixed).count() == 5
    assert q.keep_good(odd.limit(0), labels).count() == 0 and q.score(odd.limit(0), labels).count() == 0
