import re

from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import url_filter as u


def brute(url):
    words = [w for w in re.split("[^a-z0-9]+", (url or "").lower()) if w]

    def hits(term):
        t = term.split(" ")
        return sum(words[i : i + len(t)] == t for i in range(len(words) - len(t) + 1))

    hard, soft = {t: hits(t) for t in u.STRICT}, {t: hits(t) for t in u.SOFT}
    kinds = sum(n > 0 for n in soft.values())
    score = sum(n * w for t, w in u.STRICT.items() if (n := hard[t])) + sum(n * w for t, w in u.SOFT.items() if (n := soft[t]))
    return sum(hard.values()), sum(soft.values()), kinds, score, sum(hard.values()) > 0 or kinds >= u.MIN_SOFT


def scored(urls):
    import pyarrow as pa

    hard, soft, kinds, score = u.score_urls(pa.array(urls, pa.string()), *u._matcher(u.STRICT, u.SOFT))
    return [(a, b, c, d, a > 0 or c >= u.MIN_SOFT) for a, b, c, d in zip(hard.tolist(), soft.tolist(), kinds.tolist(), score.tolist(), strict=True)]


PIECES = ["adult", "x", "XXX", "sex", "chat", "casino", "win", "online", "free", "bets", "essex", "-", "/", ".", "%20", "é", " ", "\n", "spam", "farm", "spamfarm", "1"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=9).map("".join)), min_size=1, max_size=5))
def test_equals_brute_force(urls):
    assert scored(urls) == [brute(x) for x in urls]


def test_boundaries():
    assert [r[4] for r in scored(["http://a.com/essex", "http://xxx.com", "http://a.com/free", "http://a.com/free-free", "http://a.com/free/win", "adultx.com", "adult.x.com"])] == [False, True, False, False, True, False, True]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "http://porn.example"), (None, "http://porn.example"), (3, "http://a.example/" + "free/" * 30_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS score", "'x' AS rejected")
    got = sorted((r.page_id or 0, r.soft_hits, r.rejected) for r in u.filter_urls(pages).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 0, False), (2, 0, False), (3, 30_000, False)]
    assert u.filter_urls(pages.limit(0)).count() == 0
