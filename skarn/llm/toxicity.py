"""Operator 8, toxicity: a subsequence string-kernel SVM with Nyström landmarks, trained on labelled sentences.

Units are the words of a text without their outer symbols, lower-cased, every other character than a
letter standing for a gap ('.'); three or more one-letter words in a row, with or without words of
symbols between them, also make a unit, so i.d.i.o.t, 'i - d - i - o - t' and 'd é b i l' are one. The
kernel of two units counts common subsequences of ORDER letters, each weighted by DECAY to the power of
the spans it takes, and is normalised and raised to POWER; gaps match nothing, so gapped and
inserted-character spellings stay close to the plain one. Two sentences are compared by the sum over
their units (a convolution kernel), so a sentence's Nyström features are the sum of its units', and the
SVM's score of a sentence is the sum of its units' scores and the bias. Units that are not NEAR any
toxic landmark count as 0.

Training: sentences of at most MAX_DOCS labelled documents. A unit is a witness if the share of toxic
ones among the documents of its sentences is significantly above the base rate (binomial tail, corrected
by Tarone's method for the number of units that can be significant). Landmarks are witnesses that lie
apart, as many as it takes to have every witness COVERed by one, and the clean units most like them. The
SVM (squared hinge) learns from all sentences with units near them: those of clean documents are clean;
of a toxic document, those with a witness at first, and in each later round the one that scores highest
and those that score above 0 (a multiple-instance SVM, as the label is the document's); and from gapped,
doubled and inserted-character spellings of every witness. A document's score is the sum over its
sentences of what is above 0; the least score of a toxic one is that which makes fewest errors on the
labelled documents, where flagging a clean one counts twice.

Applying it: one scan sends each task's new units, each distinct unit is scored once, and a second scan
matches the sentences of every document with the units that score at least TRACE of the bias: by a
broadcast array if they are at most BROADCAST_ROWS, by a shuffle join beyond.

Defined cases: a null or empty text and units of fewer than three letters are not toxic; a text of any
length is read whole, a sentence of over LONGEST units in parts of so many; units longer than WIDTH bytes
are compared by overlapping windows, of which the likest counts; without witnesses nothing is toxic;
conflicting labels of a document count as toxic; null labels are ignored; a null doc_id is carried
through; repeated rows are reported each; other columns, whatever their names, aren't read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import BROADCAST_ROWS, mix64, runs, span_hashes, store, table, text_parts

#: Labelled documents that train at most, those of smallest hash.
MAX_DOCS = 8_000
ORDER, DECAY, POWER = 3, 0.8, 3
#: Similarity from which a unit is near a landmark, and from which a landmark stands for a witness.
NEAR, COVER = 0.5, 0.7
#: Clean landmarks.
CLEAN_LANDMARKS = 24
WIDTH, STRIDE = 32, 12
LONGEST = 60
ROUNDS = 3
#: Share of the bias under which a unit's score counts as 0.
TRACE = 0.1
SIGNIFICANCE = 0.01
SEEN = 4_000_000
_LETTER = np.zeros(256, np.bool_)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_BLANK = np.zeros(256, np.bool_)
_BLANK[list(b" \t\n\r\f\v")] = True
_STOP = np.zeros(256, np.bool_)
_STOP[list(b".!?")] = True
_CODE = np.where(_LETTER, np.arange(256), 0).astype(np.uint8)


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte is of a letter, whether it is of white space); Latin-1 and general punctuation are neither."""
    letter, blank = _LETTER[data], _BLANK[data]
    if len(data) and int(data.max()) >= 128:
        for lead, most, spaces in ((0xC2, 1, None), (0xE2, 2, 0x80)):
            at = np.flatnonzero(data == lead)
            at = at[at + most < len(data)]
            if spaces is not None:  # U+2000 to U+206F; other signs of this lead byte stay letters
                at = at[(data[at + 1] & 0xFE) == 0x80]
            for k in range(most + 1):
                letter[at + k] = False
            thin = at[data[at + 1] == 0xA0] if spaces is None else at[(data[at + 1] == spaces) & ((data[at + 2] <= 0x8A) | (data[at + 2] == 0xAF))]
            for k in range(most + 1):
                blank[thin + k] = True
    return letter, blank


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, starts, ends) of the units of lower-cased texts; words ascend, then spelled-out runs do."""
    letter, blank = _letters(data)
    norm = np.where(letter, data, ord(".")).astype(np.uint8)
    s, e = runs(~blank, offs)
    at = np.flatnonzero(letter)
    if not len(s) or not len(at):
        return norm, np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.concatenate([[0], np.cumsum(letter & ((data & 0xC0) != 0x80))])  # characters, not bytes
    count = heads[e] - heads[s]
    lo, hi = np.searchsorted(at, s), np.searchsorted(at, e)
    first, last = at[np.minimum(lo, len(at) - 1)], at[np.maximum(hi - 1, 0)] + 1
    word = count >= ORDER
    a, z = runs(count <= 1, np.searchsorted(s, offs))
    ones = np.flatnonzero(count == 1)
    lo, hi = np.searchsorted(ones, a), np.searchsorted(ones, z)
    spelled = hi - lo >= 3
    a, z = ones[lo[spelled]], ones[hi[spelled] - 1]
    return norm, np.concatenate([first[word], first[a]]), np.concatenate([last[word], last[z]])


def _ordered(norm: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the units in order; they never overlap: a spelled-out run holds no words of three letters."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    return span_hashes(norm, s, e), s, e


def sentences(data: np.ndarray, offs: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Number, ascending over all texts, of the sentence of each unit that starts at s.

    A sentence ends at a line break, at a stop that white space or the text's end follows, and after LONGEST units.
    """
    nxt = np.ones(len(data), np.bool_)
    nxt[:-1] = _BLANK[data[1:]]
    ends = np.union1d(np.flatnonzero((_STOP[data] & nxt) | (data == 10)) + 1, offs[1:])
    n = np.searchsorted(ends, s, "right")
    first = np.flatnonzero(np.diff(n, prepend=-1))
    inner = (np.arange(len(n)) - np.repeat(first, np.diff(first, append=len(n)))) // LONGEST
    return np.cumsum((np.diff(n, prepend=-1) != 0) | (np.diff(inner, prepend=0) != 0)) - 1 if len(n) else n


def _encode(texts: list[bytes]) -> np.ndarray:
    """Matrix of letter codes, 0 for gaps and filling."""
    width = max(map(len, texts), default=1)
    raw = np.frombuffer(b"".join(t.ljust(width, b".") for t in texts), np.uint8).reshape(len(texts), width)
    return _CODE[raw]


def kernel(u: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each row of u with each row of t, not normalised."""
    n, la = u.shape
    m, lb = t.shape
    hit = np.zeros((la, lb, n, m), np.float32)
    for a in range(la):
        for b in range(lb):
            np.multiply((u[:, a, None] == t[None, :, b]) & (u[:, a, None] > 0), np.float32(DECAY * DECAY), out=hit[a, b], casting="unsafe")
    level = hit.copy()
    for _ in range(ORDER - 1):
        acc = np.zeros((lb, n, m), np.float32)
        for a in range(la):  # acc: decayed sums over earlier rows; run: over earlier columns of them
            now = level[a].copy()
            run = np.zeros((n, m), np.float32)
            for b in range(lb):
                np.multiply(hit[a, b], run, out=level[a, b])
                run *= np.float32(DECAY)
                run += acc[b]
            acc *= np.float32(DECAY)
            acc += now
    return level.sum((0, 1), dtype=np.float64)


def self_kernel(u: np.ndarray) -> np.ndarray:
    n, la = u.shape
    hit = (((u[:, :, None] == u[:, None, :]) & (u[:, :, None] > 0)) * np.float32(DECAY * DECAY)).transpose(1, 2, 0).astype(np.float32)
    level = hit.copy()
    for _ in range(ORDER - 1):
        acc = np.zeros((la, n), np.float32)
        for a in range(la):
            now = level[a].copy()
            run = np.zeros(n, np.float32)
            for b in range(la):
                np.multiply(hit[a, b], run, out=level[a, b])
                run = run * np.float32(DECAY) + acc[b]
            acc = acc * np.float32(DECAY) + now
    return level.sum((0, 1), dtype=np.float64)


def _likeness(texts: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    parts, of = [], []
    for i, t in enumerate(texts):
        for w in _windows(t):
            parts.append(w)
            of.append(i)
    size = np.array([len(t) for t in parts], np.int64)
    order, own_at = np.argsort(size, kind="stable"), np.array(of, np.int64)
    out, norm = np.zeros((len(texts), len(landmarks))), np.sqrt(self_kernel(landmarks))
    for a in range(0, len(order), 128):  # texts of like length are worked on together
        at = order[a : a + 128]
        u = _encode([parts[i] for i in at])
        own = np.sqrt(self_kernel(u))
        np.maximum.at(out, own_at[at], np.where(own[:, None] > 0, kernel(u, landmarks) / np.maximum(own[:, None] * norm[None], 1e-30), 0))
    return out


@dataclass(frozen=True)
class Model:
    """score of a unit = powers of its similarities with the landmarks @ weight; the first `toxic` landmarks are the toxic ones."""

    landmarks: np.ndarray
    toxic: int
    weight: np.ndarray
    bias: float

    @property
    def texts(self) -> list[bytes]:
        """The landmarks as strings, gaps as dots."""
        return [bytes(np.where(m > 0, m, ord(".")).astype(np.uint8)).rstrip(b".") for m in self.landmarks]

    def similarities(self, texts: list[bytes], near: float | None = None) -> np.ndarray:
        """Normalised kernel with the landmarks, of a long text the highest over its windows.

        near: those that aren't so similar to a toxic landmark are compared with no others and get 0.
        """
        if near is None or self.toxic == len(self.landmarks):
            return _likeness(texts, self.landmarks)
        out = np.zeros((len(texts), len(self.landmarks)))
        out[:, : self.toxic] = _likeness(texts, self.landmarks[: self.toxic])
        close = np.flatnonzero(out.max(1, initial=0) >= near)
        out[close, self.toxic :] = _likeness([texts[i] for i in close], self.landmarks[self.toxic :])
        return out

    def score(self, like: np.ndarray) -> np.ndarray:
        """Scores of units by their similarities; 0 if no toxic landmark is near."""
        near = like[:, : self.toxic].max(1, initial=0) >= NEAR
        return np.where(near, like**POWER @ self.weight, 0.0)


def _windows(text: bytes) -> list[bytes]:
    """The text, or windows of WIDTH bytes that together hold every substring of WIDTH - STRIDE bytes."""
    if len(text) <= WIDTH:
        return [text]
    return [text[a : a + WIDTH] for a in range(0, len(text) - WIDTH + STRIDE, STRIDE)]


def _variants(word: bytes) -> list[bytes]:
    """The word with gaps, with doubled letters, and with one inserted letter."""
    out = [word, b".".join(word[i : i + 1] for i in range(len(word))), b"..".join(word[i : i + 1] for i in range(len(word)))]
    for i in range(1, len(word)):
        out += [word[:i] + b"." + word[i:], word[:i] + word[i - 1 : i] + word[i:], word[:i] + b"x" + word[i:]]
    return list(dict.fromkeys(out))


def _plain(marks: list[bytes]) -> Model:
    return Model(_encode(marks), len(marks), np.zeros(len(marks)), 0.0)


def _apart(texts: list[bytes], cover: float, most: int | None = None) -> list[bytes]:
    """Of the texts, the first, then always the one least like those chosen, until all are at least `cover` like one, or `most` are chosen."""
    if not texts:
        return []
    chosen, like = [0], _plain([texts[0]]).similarities(texts)[:, 0]
    while (most is None or len(chosen) < most) and like.min() < cover:
        chosen.append(int(np.argmin(like)))
        like = np.maximum(like, _plain([texts[chosen[-1]]]).similarities(texts)[:, 0])
    return [texts[i] for i in chosen]


def fit(marks: Model, units_: np.ndarray, sent: np.ndarray, unit: np.ndarray, doc: np.ndarray, toxic: np.ndarray, witness: np.ndarray, spelled: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The SVM over sentences. units_: similarities of the units; (sent, unit): the units of each sentence; doc, toxic: of each sentence; witness: of each unit; spelled: similarities of the witnesses' spellings."""
    value, vector = np.linalg.eigh(marks.similarities(marks.texts) ** POWER)
    good = value > 1e-6
    project = vector[:, good] / np.sqrt(value[good])
    n = len(doc)
    x = np.zeros((n, project.shape[1]))
    near = units_[:, : marks.toxic].max(1, initial=0) >= NEAR
    z = np.where(near[:, None], units_**POWER @ project, 0.0)
    np.add.at(x, sent, z[unit])
    bad = np.where(spelled[:, : marks.toxic].max(1, initial=0)[:, None] >= NEAR, spelled**POWER @ project, 0.0)
    has = np.zeros(n, np.bool_)
    has[sent[witness[unit]]] = True
    chosen, clean = has & (toxic == 1), np.flatnonzero(toxic == 0)
    w = np.zeros(x.shape[1] + 1)
    for r in range(rounds):
        if r:
            score = x @ w[:-1] + w[-1]
            order = np.lexsort((score, doc))
            top = order[np.append(doc[order][1:] != doc[order][:-1], True)] if n else order
            again = np.zeros(n, np.bool_)
            again[top] = True
            again = (again & has | (score > 0)) & (toxic == 1)
            if (again == chosen).all():
                break
            chosen = again
        own = x[chosen]
        rows = np.concatenate([own, bad, x[clean], np.zeros((1, x.shape[1]))])
        y = np.concatenate([np.ones(len(own) + len(bad)), -np.ones(len(clean) + 1)])
        pos = max(1.0, 0.05 * len(clean) / max(1, len(own) + len(bad)))
        weight = np.concatenate([np.full(len(own) + len(bad), pos), np.ones(len(clean)), [max(10.0, 0.1 * len(clean))]])  # the last is the sentence without any unit that matters
        w = _svm(rows, y, weight)
    return Model(marks.landmarks, marks.toxic, project @ w[:-1], float(w[-1]))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> np.ndarray:
    """Weights, bias last, of the squared-hinge SVM by Newton steps on its active rows."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([*[1 / c] * x.shape[1], 1e-6 / c])
    for _ in range(50):
        on = y * (z @ w) < 1
        new = np.linalg.solve(ridge + (z[on] * weight[on, None]).T @ z[on], (z[on] * weight[on, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _labelled_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label = b.column(1).to_numpy(zero_copy_only=False)
        for a, _, data, offs in text_parts(pc.utf8_lower(b.column(0))):
            norm, s, e = units(data, offs)
            h, s, e = _ordered(norm, s, e)
            if len(s):
                sent = sentences(data, offs, s)
                first = np.flatnonzero(np.diff(sent, prepend=-1))
                many = np.diff(first, append=len(h))
                place = (np.arange(len(h)) - np.repeat(first, many)).astype(np.uint64)
                sid = np.repeat(mix64(np.add.reduceat(mix64(h + place), first)), many)
                doc = np.searchsorted(offs, s, "right") - 1 + a
                raw = norm.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(sid.view(np.int64)), pa.array([raw[x:y].decode() for x, y in zip(s.tolist(), e.tolist(), strict=True)]), pa.array(label[doc].astype(np.int32)), b.column(2).take(pa.array(doc))], names=["sid", "unit", "toxic", "doc"])


def _tail(t: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Bound (Chernoff) of the chance of at least t of n at rate p."""
    q = np.clip(t / n, 1e-12, 1 - 1e-12)
    kl = q * np.log(q / p) + (1 - q) * np.log((1 - q) / (1 - p))
    return np.where(q > p, np.exp(-n * kl), 1.0)


def _testable(units_of: dict[int, int], rate: float) -> tuple[int, int]:
    """(fewest documents, units of at least as many) by Tarone's correction.

    A unit of n documents can't be more significant than rate ** n; those that can't be significant
    at all aren't hypotheses and don't count in the correction of the others.
    """
    k, left = 1, sum(units_of.values())
    while left and left * rate**k >= SIGNIFICANCE:
        left -= units_of.get(k, 0)
        k += 1
    return k, left


def _threshold(sums: np.ndarray, toxic: np.ndarray) -> float:
    """The least sum that makes fewest errors on the labelled documents, a clean one flagged counting twice."""
    order = np.argsort(-sums, kind="stable")
    s, y = sums[order], toxic[order]
    cost = 2 * np.concatenate([[0], np.cumsum(y == 0)]) + int(y.sum()) - np.concatenate([[0], np.cumsum(y == 1)])
    can = np.flatnonzero(np.concatenate([s[:1] > 0, (s[1:] < s[:-1]) & (s[:-1] > 0), s[-1:] > 0]))
    if not len(can):
        return 1e-6
    k = int(can[np.argmin(cost[can])])
    low, high = (s[k] if k < len(s) else 0.0), (s[k - 1] if k else s[0] + 1)
    return max(1e-6, float((max(low, 0.0) + high) / 2))


def _measured(rows: DataFrame, model: Model, near: float) -> DataFrame:
    """(unit, like) of the units whose similarity with a toxic landmark is at least `near`."""
    shared = rows.sparkSession.sparkContext.broadcast((model.landmarks, model.toxic, model.weight, model.bias))  # of the size of the landmarks

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                names = b.column(0).slice(at, 4096)
                like = own.similarities([u.encode() for u in names.to_pylist()], near)
                hit = like[:, : own.toxic].max(1, initial=0) >= near
                like = like[hit]
                yield pa.RecordBatch.from_arrays([names.filter(pa.array(hit)), pa.ListArray.from_arrays(pa.array(np.arange(0, like.size + 1, max(1, like.shape[1]), dtype=np.int32)), pa.array(like.ravel()))], names=["unit", "like"])

    return rows.select("unit").mapInArrow(go, "unit string, like array<double>")


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy().reshape(-1, width) if len(col) else np.zeros((0, width))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[Model, float] | None:
    """The model of units and the least score of a toxic document; None if no unit is a witness."""
    seen = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    sample = F.broadcast(store(seen.orderBy(F.xxhash64("id"), "id").limit(max_docs), "toxic-labels"))  # max_docs bounds it
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sample, "id").select("text", "y", "id")
    every = store(rows.mapInArrow(_labelled_sentences, "sid long, unit string, toxic int, doc long").groupBy("sid", "unit").agg(F.min(F.struct("doc", "toxic")).alias("s")).select("sid", "unit", "s.doc", "s.toxic"), "toxic-sentences")
    counts = store(every.groupBy("unit", "doc").agg(F.max("toxic").alias("toxic")).groupBy("unit").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")), "toxic-units")
    total = sample.agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total["t"] or total["t"] == total["n"]:
        return None
    rate = total["t"] / total["n"]
    least, tested = _testable({r["n"]: r["units"] for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("units")).collect()}, rate)  # max_docs bounds it
    some = counts.filter((F.col("n") >= least) & (F.col("t") > 0.5 * F.col("n"))).toPandas()  # the labelled documents bound it, as all that follows
    some = some[_tail(some["t"].to_numpy(float), some["n"].to_numpy(float), rate) * tested < SIGNIFICANCE].sort_values(["t", "unit"], ascending=[False, True])
    if not len(some):
        return None
    witnesses = [u.encode() for u in some["unit"]]
    heads = _apart([w for u in witnesses for w in _windows(u)], COVER)
    usual = counts.filter("t <= 0.5 * n")
    alike = _measured(usual, _plain(heads), NEAR).withColumn("most", F.array_max("like")).orderBy(F.desc("most"), "unit").limit(50 * CLEAN_LANDMARKS)  # to choose landmarks from, not to train on
    tails = _apart([w for u in alike.select("unit").toArrow().column(0).to_pylist() for w in _windows(u.encode())], 0.95, CLEAN_LANDMARKS)
    tails = [t for t in dict.fromkeys(tails) if t not in set(heads)]
    marks = Model(_encode([*heads, *tails]), len(heads), np.zeros(len(heads) + len(tails)), 0.0)
    near = store(_measured(counts, marks, NEAR), "toxic-near")
    table_ = near.orderBy("unit").toArrow()
    names, like = table_.column(0).to_pylist(), _matrix(table_.column(1), len(marks.landmarks))
    number = {u: i for i, u in enumerate(names)}
    pairs = every.join(near.select("unit"), "unit").orderBy("sid", "unit").toPandas()
    sid, sent = np.unique(pairs["sid"].to_numpy(), return_inverse=True)
    doc, toxic = np.zeros(len(sid), np.int64), np.zeros(len(sid), np.int64)
    doc[sent], toxic[sent] = pairs["doc"].to_numpy(), pairs["toxic"].to_numpy()
    known = set(witnesses)
    spelled = marks.similarities([v for w in witnesses for v in _variants(w)])
    model = fit(marks, like, sent, pairs["unit"].map(number).to_numpy(np.int64), doc, toxic, np.array([u.encode() in known for u in names], np.bool_), spelled)
    of = model.score(like)[pairs["unit"].map(number).to_numpy(np.int64)]
    of = np.where(of >= TRACE * -model.bias, of, 0.0)
    score = np.maximum(np.bincount(sent, of, len(sid)) + model.bias, 0)
    ids, back = np.unique(doc, return_inverse=True)
    sums, is_toxic = np.bincount(back, score, len(ids)), np.zeros(len(ids), np.int64)
    np.maximum.at(is_toxic, back, toxic)
    return model, _threshold(sums, is_toxic)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0, np.uint64)
    for b in batches:
        for _, _, data, offs in text_parts(pc.utf8_lower(b.column(0)), 1 << 22):
            norm, s, e = units(data, offs)
            h, s, e = _ordered(norm, s, e)
            h, first = np.unique(h, return_index=True)
            if len(seen):
                new = seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h
                h, first = h[new], first[new]
            if len(h):
                seen = np.union1d(seen, h) if len(seen) < SEEN else h
                size = e[first] - s[first]
                ends = np.cumsum(size)
                at = np.arange(int(ends[-1])) + np.repeat(s[first] - (ends - size), size)
                text = pa.Array.from_buffers(pa.string(), len(h), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(norm[at])])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), text], names=["h", "unit"])


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """(h, unit, score) of the units that count in a sentence."""
    shared = rows.sparkSession.sparkContext.broadcast((model.landmarks, model.toxic, model.weight, model.bias))  # of the size of the landmarks

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                f = np.round(own.score(own.similarities([u.encode() for u in part.column(1).to_pylist()], NEAR)), 6)
                hit = pa.array((f > 0) & (f >= TRACE * -own.bias))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(hit), part.column(1).filter(hit), pa.array(f).filter(hit)], names=["h", "unit", "score"])

    return rows.mapInArrow(go, "h long, unit string, score double")


def toxic_units(docs: DataFrame, model: Model) -> DataFrame:
    """(h, unit, score) of the distinct units of the documents that count in a sentence."""
    distinct = docs.select("text").mapInArrow(_distinct, "h long, unit string").groupBy("h", "unit").count().select("h", "unit")
    return _scored(distinct, model)


def _document_units(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        rid = TaskContext.get().partitionId() << 36
        for b in batches:
            for a, z, data, offs in text_parts(pc.utf8_lower(b.column(1))):
                norm, s, e = units(data, offs)
                h, s, e = _ordered(norm, s, e)
                sent = sentences(data, offs, s)
                if keys is not None and len(h):
                    hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
                    s, h, sent = s[hit], h[hit], sent[hit]
                doc = np.searchsorted(offs, s, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(rid + doc), b.column(0).take(pa.array(doc + a)), pa.array(sent.astype(np.int64)), pa.array(h.view(np.int64))], names=["rid", "doc_id", "sent", "h"])
                rid += z - a

    return go


def find_toxic(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, most: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, hits, score) of the toxic documents: toxic units in the text, counted in each sentence, and the sum over its sentences of what is above 0."""
    schema = "doc_id long, hits long, score double"
    trained = train(docs, labels, max_docs)
    if trained is None:
        return docs.sparkSession.createDataFrame([], schema)
    model, least = trained
    bad = store(toxic_units(docs, model), "toxic-found")
    n = bad.count()
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    few = n <= most
    keys = np.sort(bad.select("h").toArrow().column(0).to_numpy().view(np.uint64)) if few else None
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_document_units(shared), "rid long, doc_id long, sent long, h long")
    side = bad.select("h", "score")
    hits = rows.join(F.broadcast(side) if few else side, "h").groupBy("rid", "sent", "h").agg(F.max("doc_id").alias("doc_id"), F.max("score").alias("score"))
    said = hits.groupBy("rid", "sent").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("hits"), (F.sum("score") + model.bias).alias("score")).filter("score > 0")
    sums = said.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.sum("hits").alias("hits"), F.sum("score").alias("score"))
    return sums.filter(F.col("score") >= least).drop("rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
