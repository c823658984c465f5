"""Operator 2, URL filters: a weighted vocabulary of strict and soft terms matched by Aho-Corasick.

A URL is lower-cased and every run of characters other than a-z and 0-9 becomes one space, so a
term of several words matches whatever separates them. A hit counts only between boundaries: the
character before and after it, if any, is a space. Overlapping hits all count. A page is rejected
on one strict hit, or on `min_soft` distinct soft terms.

Defined cases: a null or empty URL has no hits and is kept; a very long URL is matched whole; repeated rows give repeated rows; a
null page_id is carried through; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from skarn.llm.common import table

#: term -> weight. Terms hold lower-case words with single spaces and don't overlap themselves.
STRICT: dict[str, int] = {
    "porn": 10, "xxx": 10, "adult x": 10, "sex chat": 10, "escort": 9, "camgirls": 10, "spam farm": 10, "spamfarm": 10, "link farm": 9, "cheap pills": 10,
    "viagra": 9, "cialis": 9, "casino win": 9, "online casino": 9, "free bets": 8, "phishing": 9, "malware": 9, "warez": 8, "keygen": 8, "payday loan": 8,
}
SOFT: dict[str, int] = {
    "adult": 4, "sex": 4, "casino": 4, "poker": 3, "bet": 2, "bets": 2, "betting": 3, "slots": 3, "jackpot": 3, "pills": 3, "pharma": 2, "pharmacy": 2, "cheap": 1,
    "free": 1, "win": 1, "bonus": 2, "deal": 1, "deals": 1, "promo": 1, "coupon": 1, "loan": 2, "loans": 2, "crypto": 1, "torrent": 3, "crack": 2, "hack": 2,
    "spam": 3, "ads": 1, "ad": 1, "track": 1, "tracker": 1, "click": 1, "popup": 2, "affiliate": 2, "replica": 2, "dating": 2,
}
MIN_SOFT = 2
SCHEMA = "page_id long, url string, strict_hits long, soft_hits long, soft_distinct long, score long, rejected boolean"


def _matcher(strict: Mapping[str, int], soft: Mapping[str, int]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    terms = [*((t, w, True) for t, w in strict.items()), *((t, w, False) for t, w in soft.items())]
    for i, (term, _, _) in enumerate(terms):
        auto.add_word(term, (i, len(term)))
    auto.make_automaton()
    return auto, np.array([w for _, w, _ in terms], np.int64), np.array([s for _, _, s in terms], np.bool_)


def score_urls(urls: pa.Array, auto, weight: np.ndarray, strict: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hit counts of each URL: the whole batch is one text, so the automaton runs once."""
    norm = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(urls, "")), "[^a-z0-9]+", " "), " ")
    n = len(norm)
    offs = np.concatenate([[0], np.cumsum(pc.utf8_length(norm).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    text = "\n".join(norm.to_pylist()) + "\n"
    rows, terms = [], []
    for end, (i, size) in auto.iter(text):
        before = text[end - size] if end >= size else "\n"
        if before in " \n" and text[end + 1] in " \n":
            rows.append(end)
            terms.append(i)
    row, term = np.searchsorted(offs, np.array(rows, np.int64), "right") - 1, np.array(terms, np.int64)
    s = strict[term]
    pairs = np.unique(row[~s] * len(weight) + term[~s])
    return (
        np.bincount(row[s], minlength=n), np.bincount(row[~s], minlength=n), np.bincount(pairs // len(weight), minlength=n),
        np.bincount(row, weights=weight[term], minlength=n).astype(np.int64),
    )


def filter_urls(pages: DataFrame, strict: Mapping[str, int] = STRICT, soft: Mapping[str, int] = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """(page_id, url, strict_hits, soft_hits, soft_distinct, score, rejected) of every page; no shuffle."""
    strict, soft = dict(strict), dict(soft)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, weight, is_strict = _matcher(strict, soft)
        for b in batches:
            if b.num_rows:
                hard, hits, kinds, score = score_urls(b.column(1), auto, weight, is_strict)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x.astype(np.int64)) for x in (hard, hits, kinds, score)), pa.array((hard > 0) | (kinds >= min_soft))], names=["page_id", "url", "strict_hits", "soft_hits", "soft_distinct", "score", "rejected"])

    return pages.select("page_id", "url").mapInArrow(go, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _values(terms: Mapping[str, int], strict: bool) -> list[str]:
    return [f"('{t}', {w}, {str(strict).lower()})" for t, w in terms.items()]


#: Doubled separators give each occurrence spaces of its own, so that replace() counts every one.
ORACLE = f"""
WITH vocab(term, w, hard) AS (VALUES {", ".join(_values(STRICT, True) + _values(SOFT, False))}),
p AS (SELECT row_number() OVER () AS r, page_id, url, '  ' || regexp_replace(lower(coalesce(url, '')), '[^a-z0-9]+', '  ', 'g') || '  ' AS u FROM pages),
needles AS (SELECT *, ' ' || replace(term, ' ', '  ') || ' ' AS needle FROM vocab),
hits AS (SELECT r, hard, w, CAST((length(u) - length(replace(u, needle, ''))) / length(needle) AS BIGINT) AS n FROM p, needles WHERE contains(u, needle)),
s AS (SELECT r, coalesce(sum(n) FILTER (hard), 0) AS a, coalesce(sum(n) FILTER (NOT hard), 0) AS b, count(*) FILTER (NOT hard) AS c, sum(n * w) AS score FROM hits GROUP BY r)
SELECT page_id, url, CAST(coalesce(a, 0) AS BIGINT) AS strict_hits, CAST(coalesce(b, 0) AS BIGINT) AS soft_hits, CAST(coalesce(c, 0) AS BIGINT) AS soft_distinct,
  CAST(coalesce(score, 0) AS BIGINT) AS score, coalesce(a, 0) > 0 OR coalesce(c, 0) >= {MIN_SOFT} AS rejected
FROM p LEFT JOIN s USING (r)
"""
