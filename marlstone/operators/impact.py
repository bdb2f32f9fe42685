"""The k best passages by BM25 without scoring every posting: block maxima bound what a block of passages can reach.

The index has segments of some thousand passages, each with one row for a term: its passages and counts as packed arrays.
A task that walks a segment bounds every block of BLOCK passages by the largest share that each asked term has in it, and
takes blocks by falling bound until the k-th best score of the query, over all segments the task has seen, is out of reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import written
from .retrieval import EPSILON, K1, B, top

#: Passages and words of a segment at most, but for one longer passage.
SEGMENT_DOCS, SEGMENT_WORDS = 16_384, 4_000_000
#: Passages of a block that has bounds of its own.
BLOCK = 16
#: Blocks that are scored first, to learn what the k-th best must have.
FIRST = 16
#: Terms of all queries together at most, each counted for every query that has it.
MOST_TERMS = 1_000_000
#: Scores are compared after rounding to so many digits, ties by id; bounds leave that much room.
DIGITS = 6
INDEX = "segment long, term string, n long, at binary, counts binary"


def _segment(number: int, ids: list[np.ndarray], words: list[pa.Array], sizes: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of one segment. Its passages are ordered by length, so that those of a block are bounded alike; the row without a term names them."""
    ids, sizes = np.concatenate(ids), np.concatenate(sizes)
    code = pa.chunked_array([w.cast(pa.string()) for w in words]).combine_chunks().dictionary_encode()
    order = np.argsort(sizes, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    pairs, counts = np.unique(code.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + np.repeat(place, sizes), return_counts=True)
    term, at = pairs // len(ids), (pairs % len(ids)).astype("<i4")
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    ends = np.r_[first[1:], len(term)]
    cut = lambda values: [values[a:b].tobytes() for a, b in zip(first, ends)]
    columns = [
        pa.array(np.full(len(first) + 1, number)),
        pa.concat_arrays([code.dictionary.take(pa.array(term[first])), pa.nulls(1, pa.string())]),
        pa.array([*(ends - first).tolist(), len(ids)], pa.int64()),
        pa.array([*cut(at), ids[order].astype("<i8").tobytes()], pa.binary()),
        pa.array([*cut(counts.astype("<i4")), sizes[order].astype("<i4").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "n", "at", "counts"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: Column | None = None) -> DataFrame:
    """The index of ``docs`` by ``terms`` (an array; the words of the text if not given), written once.

    Words are counted where their rows are: no word is shuffled. A null text has no words; ids are not null.
    """
    terms = tokens(F.col(text_col)) if terms is None else terms

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, docs_held, words_held = TaskContext.get().partitionId() << 32, ([], [], []), 0, 0
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            lo = 0
            while lo < batch.num_rows:
                room = np.flatnonzero((np.cumsum(sizes[lo:]) + words_held <= SEGMENT_WORDS) & (np.arange(docs_held, docs_held + batch.num_rows - lo) < SEGMENT_DOCS))
                hi = lo + (int(room[-1]) + 1 if len(room) else 0 if docs_held else 1)
                if hi > lo:
                    for part, values in zip(held, (batch.column(0).slice(lo, hi - lo).to_numpy(), lists.slice(lo, hi - lo).flatten(), sizes[lo:hi])):
                        part.append(values)
                    docs_held, words_held = docs_held + hi - lo, words_held + int(sizes[lo:hi].sum())
                if hi < batch.num_rows:
                    yield _segment(number, *held)
                    number, held, docs_held, words_held = number + 1, ([], [], []), 0, 0
                lo = hi
        if docs_held:
            yield _segment(number, *held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(terms, F.array().cast("array<string>")).alias("t")).where(F.col("id").isNotNull())
    return written(rows.mapInArrow(build, INDEX), "impact")


def _frequencies(index: DataFrame) -> DataFrame:
    """(term, idf): as ``retrieval.statistics`` has it."""
    n_docs = index.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = index.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    df = written(df.withColumn("idf", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "frequency")
    floor = df.agg(F.avg("idf").alias("mean"))  # one row
    return df.join(F.broadcast(floor)).select("term", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))


class Segment:
    """One segment's asked terms, their shares by passage, and bounds by block."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: dict[str, tuple[np.ndarray, np.ndarray]], average: float):
        self.ids, self.blocks = ids, -(-len(ids) // BLOCK)
        norm = K1 * (1 - B + B * sizes / average)
        self.row = {t: i for i, t in enumerate(terms)}
        self.at = [a for a, _ in terms.values()]
        self.share = [c * (K1 + 1) / (c + norm[a]) for a, c in terms.values()]
        self.start = np.stack([np.searchsorted(a, np.arange(self.blocks + 1) * BLOCK) for a in self.at]) if terms else np.zeros((0, self.blocks + 1), np.int64)
        self.bound = np.zeros((len(terms), self.blocks))
        for i, (a, s) in enumerate(zip(self.at, self.share)):
            np.maximum.at(self.bound[i], a // BLOCK, s)

    def best(self, asked: list[tuple[str, float]], k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(ids, scores) of the k best that could beat ``floor``, and how many postings were scored, of how many."""
        asked = [(self.row[t], w) for t, w in asked if t in self.row]
        rows = np.array([i for i, _ in asked], np.int64)
        weight = np.array([w for _, w in asked])
        whole = int(sum(len(self.at[i]) for i in rows))
        if not whole:
            return np.zeros(0, np.int64), np.zeros(0), 0, 0
        # A term may weigh less than nothing where nearly all passages have it; it can only lower a score then.
        bound = np.maximum(weight, 0) @ self.bound[rows]
        hit = (self.start[rows, 1:] > self.start[rows, :-1]).any(axis=0)
        order = np.flatnonzero(hit)[np.argsort(-bound[hit], kind="stable")]
        ids, scores, scored, lo, step = np.zeros(0, np.int64), np.zeros(0), 0, 0, FIRST
        while lo < len(order):
            part = order[lo : lo + step]
            part = part[bound[part] >= floor - 10.0**-DIGITS]
            if not len(part):
                break
            total, met = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
            for i, w in zip(rows, weight):
                a, b = self.start[i, part], self.start[i, part + 1]
                size = b - a
                if n := int(size.sum()):
                    at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(n)
                    here = self.at[i][at]
                    total[here] += w * self.share[i][at]
                    met[here] = True
                    scored += n
            found = np.flatnonzero(met)
            ids, scores = chosen(np.r_[ids, self.ids[found]], np.r_[scores, total[found]], k)
            if len(ids) == k:
                floor = max(floor, float(scores[-1]))
            lo, step = lo + step, step * 2
        return ids, scores, scored, whole


def chosen(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by rounded score, then id."""
    order = np.lexsort((ids, -np.round(scores, DIGITS)))[:k]
    return ids[order], scores[order]


def walked(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, bm25, scored, postings): k rows at most of each query and task; counts are on a task's row without an id.

    ``queries`` (query_id long, term, weight) is a stated set of MOST_TERMS rows at most; ask for more in blocks.
    """
    asked = queries.join(_frequencies(index), "term").select("query_id", "term", (F.col("weight") * F.col("idf")).alias("w"))
    rows = asked.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms at once; ask in blocks")
    of_query: dict[int, list[tuple[str, float]]] = {}
    for q, t, w in rows:
        of_query.setdefault(q, []).append((t, w))
    for q in of_query.values():
        q.sort()
    size = index.where("term is null").agg(F.sum("n")).first()[0] or 0
    spark = index.sparkSession

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            n += sum(int(np.frombuffer(c.as_buffer(), "<i4").sum()) for c in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    total = index.where("term is null").select("counts").mapInArrow(summed, "n long").agg(F.sum("n")).first()[0] or 0
    average = total / max(1, size)
    terms = spark.createDataFrame([(t,) for t in sorted({t for _, t, _ in rows})], "term string")
    wanted = index.join(F.broadcast(terms), "term", "left_semi").unionByName(index.where("term is null")).select("segment", "term", "at", "counts")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q: (np.zeros(0, np.int64), np.zeros(0)) for q in of_query}
        counts = [0, 0]
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        now = None

        def done() -> None:
            named = held.pop(None, None)
            if named is None:
                return
            part = Segment(*named, held, average)
            for q, asked in of_query.items():
                ids, scores = best[q]
                floor = float(scores[-1]) if len(ids) == k else -np.inf
                more, s, scored, whole = part.best(asked, k, floor)
                counts[0] += scored
                counts[1] += whole
                best[q] = chosen(np.r_[ids, more], np.r_[scores, s], k)

        for batch in batches:
            for segment, term, at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if segment != now:
                    done()
                    held, now = {}, segment
                held[term] = np.frombuffer(at.as_buffer(), "<i4" if term is not None else "<i8"), np.frombuffer(n.as_buffer(), "<i4")
        done()
        out = [(q, int(i), float(s), None, None) for q, (ids, scores) in best.items() for i, s in zip(ids, scores)]
        out.append((None, None, None, *counts))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["query_id", "id", "bm25", "scored", "postings"])

    return wanted.repartition("segment").sortWithinPartitions("segment").mapInArrow(walk, "query_id long, id long, bm25 double, scored long, postings long")


def best(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k best passages of each query by BM25, rounded; ties go to the smaller id. A passage without any of the terms isn't ranked."""
    hits = walked(index, queries, k).where("id is not null")
    return top(hits.select("query_id", "id", F.round("bm25", DIGITS).alias("score")), k)
