import base64

import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import token_counts as tc
from skarn.llm.common import text_parts

CLASSES = tc.char_classes()
ALPHABET = "ab Z'stmdrevl0９é中 \t\n\r  !?.🙂_-"


def split(texts):
    out = []
    for a, z, data, offs in text_parts(pa.array(texts), 40):
        s, e = tc.pre_tokens(data, offs, CLASSES)
        got = [[] for _ in range(z - a)]
        for x, y in zip(s, e, strict=True):
            got[int(np.searchsorted(offs, x, "right")) - 1].append(bytes(data[x:y]).decode())
        out += got
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=25), min_size=1, max_size=6))
def test_pre_tokens_equal_the_pattern(texts):
    assert split(texts) == [regex.findall(tc.PATTERN, t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=25), min_size=1, max_size=6))
def test_pre_tokens_of_any_text(texts):
    assert split(texts) == [regex.findall(tc.PATTERN, t) for t in texts]


def brute(texts):
    import tiktoken

    with open(tc.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=tc.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(enc.encode_ordinary(t or "")) for t in texts]


def test_counts_equal_the_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows]), strict=True))
    assert {r.doc_id: r.n_tokens for r in tc.count_tokens(docs).collect()} == want
    assert {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, head=500).collect()} == want  # most by shuffle
    assert {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, head=0).collect()} == want


def test_odd_rows(spark):
    texts = [None, "", "it's", "it's", " ", "x" * 70_000, "<|endoftext|>"]
    docs = spark.createDataFrame([(None if i == 2 else i // 2, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in tc.count_tokens(docs).collect())
    want = sorted((-1 if i == 2 else i // 2, n) for i, n in enumerate(brute(texts)))
    assert got == want
    assert tc.count_tokens(docs.limit(0)).count() == 0
