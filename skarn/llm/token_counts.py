"""Operator 5, token counts: byte-pair pieces are counted once for each distinct pre-token.

A pre-token is a match of PATTERN. Matches are found by numpy over character classes, which gives
exactly the pattern's matches; a test holds it against the regex. The plan:

1. scan: each task sends the pre-tokens it hasn't sent before, without those that are a piece of the
   vocabulary themselves (one piece, known from the vocabulary, whose size is fixed);
2. one group per distinct pre-token, whose pieces are counted once and stored;
3. scan: each document's pre-token frequencies are joined to the counts and summed. The pre-tokens
   that most tasks met, at most HEAD of them, are joined from a broadcast array; the frequencies of
   all others are joined by a shuffle. No ids are ever made for documents.

Pre-tokens are told apart by 64-bit hashes.

Defined cases: a null or empty text has 0 pre-tokens and 0 tokens; a very long text is counted whole; a null doc_id is carried through;
repeated rows give repeated rows; special tokens' strings are ordinary text; other columns aren't
read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import doc_of, span_hashes, store, table, text_parts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD = 2_000_000
#: A task forgets which pre-tokens it sent once they are so many; it then sends some again.
SEEN = 4_000_000
_LETTER, _NUMBER, _SPACE = 1, 2, 3
_SHORT = {ord(c) for c in "stmd"}
_LONG = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


def char_classes() -> np.ndarray:
    """Class of each code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = 0
    return out


def pre_tokens(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens of valid utf-8 texts, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if int(data.max()) < 128:
        cp, lead, heads = data, None, offs
    else:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.searchsorted(lead, offs)
    c, m = classes[cp], len(cp)
    top = np.zeros(m + 1, np.bool_)  # first character of a text; the end counts as one
    top[heads] = True
    top[m] = True
    change = np.empty(m, np.bool_)
    change[0] = True
    np.not_equal(c[1:], c[:-1], out=change[1:])
    change |= top[:m]
    space = c == _SPACE
    blank = cp == 0x20
    joined = np.zeros(m, np.bool_)  # the character before is a blank of the same text
    joined[1:] = blank[:-1]
    joined &= ~top[:m]
    flag = change & (space | ~joined)
    last = np.zeros(m, np.bool_)  # ends a run of white space before something else in the text
    last[:-1] = space[:-1] & ~space[1:] & ~top[1:m]
    flag |= last
    for i in np.flatnonzero((cp == 0x27) & flag).tolist():
        for k in (1, 2):
            if i + k >= m or top[i + 1 : i + k + 1].any():
                break
            if (k == 1 and int(cp[i + 1]) in _SHORT) or (k == 2 and (int(cp[i + 1]), int(cp[i + 2])) in _LONG):
                flag[i + 1 : i + k + 1] = False
                if i + k + 1 < m and not top[i + k + 1] and c[i + k + 1] == _LETTER:
                    flag[i + k + 1] = True
                break
    starts = np.flatnonzero(flag)
    if lead is not None:
        starts = lead[starts]
    return starts, np.append(starts[1:], n)


def _vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _known(ranks: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the vocabulary's pieces."""
    data = np.frombuffer(b"".join(ranks), np.uint8)
    ends = np.cumsum([len(p) for p in ranks])
    return np.sort(span_hashes(data, np.concatenate([[0], ends[:-1]]), ends))


def _in(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ordered, whether it is there)."""
    if not len(ordered):
        return np.zeros(len(values), np.int64), np.zeros(len(values), np.bool_)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at, ordered[at] == values


def _distinct(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, known = shared.value
        seen = np.zeros(0, np.uint64)
        for b in batches:
            for _, _, data, offs in text_parts(b.column(0), 1 << 22):
                s, e = pre_tokens(data, offs, classes)
                h, first = np.unique(span_hashes(data, s, e), return_index=True)
                new = ~_in(h, known)[1] & ~_in(h, seen)[1]
                h, first = h[new], first[new]
                if len(h):
                    seen = np.union1d(seen, h) if len(seen) < SEEN else h
                    size = e[first] - s[first]
                    ends = np.cumsum(size)
                    at = np.arange(int(ends[-1])) + np.repeat(s[first] - (ends - size), size)
                    text = pa.Array.from_buffers(pa.string(), len(h), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[at])])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), text], names=["h", "token"])

    return go


def _pieces(ranks, pattern: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(n, pa.int32()), b.column("spread")], names=["h", "pieces", "spread"])

    return go


def _frequencies(shared, head):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, known = shared.value
        keys, pieces = head.value
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            for a, z, data, offs in text_parts(b.column(1)):
                n = z - a
                s, e = pre_tokens(data, offs, classes)
                doc = doc_of(s, offs)
                vocab, inv = np.unique(span_hashes(data, s, e), return_inverse=True)
                pair, freq = np.unique(doc * max(1, len(vocab)) + inv, return_counts=True)  # frequencies of each document
                doc, tok = pair // max(1, len(vocab)), pair % max(1, len(vocab))
                at, found = _in(vocab, keys)
                count = np.where(_in(vocab, known)[1], 1, np.where(found, pieces[at] if len(keys) else 0, 0))[tok]
                ids = pa.array(rid + np.arange(n, dtype=np.int64))
                total = np.bincount(doc, weights=freq, minlength=n).astype(np.int64)
                sums = np.bincount(doc, weights=freq * count, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, b.column(0).slice(a, n), pa.array(total), pa.array(sums), pa.nulls(n, pa.int64())], names=["rid", "doc_id", "n_pretokens", "n", "h"])
                rest = np.flatnonzero(count == 0)
                if len(rest):
                    yield pa.RecordBatch.from_arrays([pa.array(rid + doc[rest]), pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.int64()), pa.array(freq[rest].astype(np.int64)), pa.array(vocab[tok[rest]].view(np.int64))], names=["rid", "doc_id", "n_pretokens", "n", "h"])
                rid += n

    return go


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, head: int = HEAD) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row."""
    sc = docs.sparkSession.sparkContext
    ranks = _vocabulary(vocabulary)
    shared = sc.broadcast((char_classes(), _known(ranks)))  # both of a fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    distinct = rows.select("text").mapInArrow(_distinct(shared), "h long, token string").groupBy("h", "token").agg(F.count(F.lit(1)).cast("int").alias("spread"))
    counts = store(distinct.mapInArrow(_pieces(sc.broadcast(ranks), pattern), "h long, pieces int, spread int"), "token-pieces")
    least, taken = 1, 0
    for spread, n in sorted(counts.groupBy("spread").count().collect(), reverse=True):  # one row for each number of tasks
        taken += n
        if taken > head:
            least = spread + 1
            break
    top = counts.filter(F.col("spread") >= least).select("h", "pieces").toArrow()
    keys = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    table_ = sc.broadcast((keys[order], top.column("pieces").to_numpy()[order].astype(np.int32)))
    found = store(rows.mapInArrow(_frequencies(shared, table_), "rid long, doc_id long, n_pretokens long, n long, h long"), "token-frequencies")
    tail = found.filter("h IS NOT NULL").select("rid", "h", "n").join(counts.filter(F.col("spread") < least).select("h", "pieces"), "h")
    tail = tail.select("rid", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_pretokens"), (F.col("n") * F.col("pieces")).alias("n"))
    every = found.filter("h IS NULL").drop("h").unionByName(tail)
    return every.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_pretokens").alias("n_pretokens"), F.sum("n").alias("n_tokens")).drop("rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
