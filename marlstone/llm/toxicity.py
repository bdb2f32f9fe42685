"""Toxicity: a convolutional text classifier in numpy with thresholds calibrated by language.

Words and their first letters are hashed to embeddings; filters of several widths run over the word sequence
and their largest value over the whole text is kept; a logistic layer weighs these. The network is trained on
a bounded sample of labelled rows. Each language, guessed from the text's own function words, gets its own
threshold, and scores are shifted so that every threshold lies at the same value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import word_ids
from .quality import labelled_sample
from .scratch import bounded

#: Labelled rows of each class that are learned from at most, and bytes of word numbers that they have together.
SAMPLE, SAMPLE_BYTES = 2000, 64 << 20
WORDS, STEMS = 1 << 15, 1 << 13
SIZE = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 12
RATE = 0.05
THRESHOLD = 0.7
# Frequent function words that tell the languages apart.
FUNCTION_WORDS = (
    ("the", "and", "of", "to", "that"),
    ("le", "et", "les", "des", "une"),
    ("der", "und", "die", "das", "nicht"),
    ("el", "los", "y", "por", "las"),
)


def _guess(column, n: int) -> np.ndarray:
    """Number of the language whose function words a row has most of; the first if it has none."""
    marks = pa.array([" ".join(w) for w in FUNCTION_WORDS])
    sets = [np.zeros(0, np.int64)] * len(FUNCTION_WORDS)
    for _, rows, whole, _, row in word_ids(marks, 1 << 40, 2):
        sets = [whole[row == i] for i in range(rows)]
    out = np.zeros(n, np.int64)
    for lo, rows, whole, _, row in word_ids(column, 1 << 40, 2):
        counts = np.stack([np.bincount(row[np.isin(whole, s)], minlength=rows) for s in sets])
        out[lo : lo + rows] = counts.argmax(0)
    return out


@dataclass
class Net:
    words: np.ndarray
    stems: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS)))
    tables: list | None = None

    def pooled(self, whole: np.ndarray, stem: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value and its place, of each filter over words [first, end) of each row that has words."""
        if self.tables is None:
            self.tables = [[(self.words @ f[j], self.stems @ f[j]) for j in range(len(f))] for f in self.filters]
        n = len(whole)
        best, place = [], []
        for table, bias in zip(self.tables, self.bias):
            v = np.zeros((n, len(bias)), np.float32)
            for j, (a, b) in enumerate(table):
                part = (a[whole] + b[stem])[j:]
                v[: n - j] += part
                late = end - j  # no window reaches into the next row
                for i in range(1, j + 1):
                    if i <= n:
                        at = late + i - 1
                        at = at[(at >= first) & (at < end)]
                        v[at] -= 0 if j == 0 else (a[whole[np.minimum(at + j, n - 1)]] + b[stem[np.minimum(at + j, n - 1)]]) * (at + j < n)[:, None]
            top = np.maximum.reduceat(v, first, axis=0)
            best.append(np.maximum(top + bias, 0))
            place.append((v, top))
        return np.concatenate(best, 1), place

    def logit(self, column) -> np.ndarray:
        n = len(column)
        out = np.full(n, self.base)
        for lo, rows, whole, stem, row in word_ids(column, WORDS, STEMS):
            if not len(row):
                continue
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            h, _ = self.pooled(whole, stem, first, np.r_[first[1:], len(row)])
            out[lo + row[first]] = h @ self.out + self.base
        return out

    def score(self, column) -> np.ndarray:
        z = self.logit(column) + self.shift[_guess(column, len(column))]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5) -> Net:
    """Plain stochastic gradient descent (AdaGrad); only the windows that win the pooling get a gradient."""
    g = np.random.default_rng(seed)
    width = len(WIDTHS) * FILTERS
    net = Net(
        (g.normal(size=(WORDS, SIZE)) * 0.1).astype(np.float32), (g.normal(size=(STEMS, SIZE)) * 0.1).astype(np.float32),
        [(g.normal(size=(w, SIZE, FILTERS)) * 0.4).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        (g.normal(size=width) * 0.3).astype(np.float32), -1.0,
    )
    if not len(texts):
        return net
    square = {id(a): np.full_like(a, 1e-3) for a in (net.words, net.stems, net.out, *net.filters, *net.bias)}
    base_square = 1e-3
    weight = np.where(y == 1, max(1.0, (y == 0).sum() / max(1, (y == 1).sum())), 1.0)

    def move(a: np.ndarray, at, grad: np.ndarray) -> None:
        s = square[id(a)]
        s[at] += grad**2
        a[at] -= RATE * grad / np.sqrt(s[at])

    for _ in range(EPOCHS):
        for t in g.permutation(len(texts)):
            whole, stem = texts[t]
            if not len(whole):
                continue
            x = net.words[whole] + net.stems[stem]
            n = len(x)
            hidden, at = [], []
            for f, b in zip(net.filters, net.bias):
                v = x @ f[0]
                for j in range(1, len(f)):
                    v[: n - j] += x[j:] @ f[j]
                a = v.argmax(0)
                at.append(a)
                hidden.append(np.maximum(v[a, np.arange(FILTERS)] + b, 0))
            h = np.concatenate(hidden)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.base, -30, 30)))
            e = float(p - y[t]) * weight[t]
            dh = e * net.out * (h > 0)
            move(net.out, slice(None), e * h)
            base_square += e * e
            net.base -= RATE * e / np.sqrt(base_square)
            if abs(e) < 0.02:
                continue
            for k, (f, b) in enumerate(zip(net.filters, net.bias)):
                d = dh[k * FILTERS : (k + 1) * FILTERS]
                live = np.flatnonzero(d)
                if not len(live):
                    continue
                move(b, live, d[live])
                for j in range(len(f)):
                    pos = at[k][live] + j
                    ok = pos < n
                    if not ok.any():
                        continue
                    pos, who = pos[ok], live[ok]
                    grad_x = d[who][:, None] * f[j][:, who].T
                    s = square[id(f)]
                    grad_f = d[who] * x[pos].T
                    s[j][:, who] += grad_f**2
                    f[j][:, who] -= RATE * grad_f / np.sqrt(s[j][:, who])
                    for table, index in ((net.words, whole[pos]), (net.stems, stem[pos])):
                        for i, gx in zip(index, grad_x):
                            move(table, i, gx)
    return net


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = SAMPLE) -> Net:
    """A net learned from at most ``sample`` rows of each class of ``labels`` for which ``learn`` holds.

    Rows are taken in the order of a hash of their ids, whole, as long as all have SAMPLE_BYTES at most; of rows
    that repeat an id the one with the least hash of its text. A fifth of the sample is kept from the training
    and sets the languages' thresholds.
    """

    def numbered(batches):
        for batch in batches:
            ids = [b""] * batch.num_rows
            for lo, rows, whole, stem, row in word_ids(batch.column(1), WORDS, STEMS):
                ends = np.searchsorted(row, np.arange(rows + 1))
                both = np.stack([whole, stem], 1).astype("<u2")
                for i in range(rows):
                    ids[lo + i] = both[ends[i] : ends[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(_guess(batch.column(1), batch.num_rows)), batch.column(3)], names=["doc_id", "label", "ids", "language", "mark"])

    picked = labelled_sample(labels.where(F.col(label) == 1), label, learn, sample).unionByName(labelled_sample(labels.where(F.col(label) == 0), label, learn, sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", F.xxhash64("text").alias("mark"))
    rows = rows.mapInArrow(numbered, "doc_id long, label int, ids binary, language long, mark long")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("label", "ids", "language"), "mark").alias("r")).select("doc_id", "r.*")
    so_far = F.sum(F.octet_length("ids").cast("long") + 1).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # 2 * sample rows
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).orderBy("doc_id").collect()  # bounded by both
    texts = [(x[:, 0], x[:, 1]) for r in rows for x in [np.frombuffer(bytes(r["ids"]), "<u2").reshape(-1, 2).astype(np.int64)]]
    y = np.array([r["label"] for r in rows])
    language = np.array([r["language"] for r in rows])
    kept = np.arange(len(rows)) % 5 == 0
    net = fit([t for t, k in zip(texts, kept) if not k], y[~kept] if len(rows) else y)
    calibrate(net, [t for t, k in zip(texts, kept) if k], y[kept] if len(rows) else y, language[kept] if len(rows) else language)
    return net


def calibrate(net: Net, texts: list, y: np.ndarray, language: np.ndarray) -> None:
    """Shifts each language's logits so that its best threshold lies at THRESHOLD."""
    z = np.zeros(len(texts))
    for i, (whole, stem) in enumerate(texts):
        z[i] = net.base if not len(whole) else float((net.pooled(whole, stem, np.array([0]), np.array([len(whole)]))[0] @ net.out)[0] + net.base)
    target = np.log(THRESHOLD / (1 - THRESHOLD))

    def best(at: np.ndarray) -> float:
        pos, neg = np.sort(z[at][y[at] == 1]), np.sort(z[at][y[at] == 0])
        if not len(pos) or not len(neg):
            return 0.0
        cuts = np.unique(np.r_[z[at], 0.0])
        mids = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2]
        wrong = np.searchsorted(pos, mids) / len(pos) + 2 * (len(neg) - np.searchsorted(neg, mids)) / len(neg)
        good = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        return float(mids[good].mean())

    whole = best(np.arange(len(z))) if len(z) else 0.0
    for i in range(len(net.shift)):
        at = np.flatnonzero(language == i)
        own = best(at) if len(at) >= 30 else whole
        n = len(at)
        net.shift[i] = target - (own * n + whole * 100) / (n + 100)


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: from 0 to 1, higher where label 1 is likelier.

    A null or wordless text gets the score of no evidence; nulls elsewhere and repeated rows change nothing. An
    empty table gives an empty table.
    """
    net.tables = None
    bounded(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [held.value.score(batch.column(1).slice(lo, 500)) for lo in range(0, batch.num_rows, 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, "doc_id long, score double")
