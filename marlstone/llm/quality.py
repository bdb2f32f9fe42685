"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A bounded sample of labelled rows is turned into term and shape features and these, by a singular value
decomposition, into short latent vectors. They are broadcast; every document's cosine with every one of them
is computed in blocks, and the labels of its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .bytehash import tidy
from .features import SHAPES, TERMS, quality_features
from .scratch import bounded

#: Labelled rows that are learned from at most; also bounds what is broadcast.
SAMPLE = 6000
DIMENSIONS = 40
NEIGHBOURS = 15
#: Documents of one cosine block.
BLOCK = 1024
SHAPE_WEIGHT = 1.0
POWER = 8


@dataclass
class Voter:
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) * self.scale) @ self.axes
        return z / np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), 0.5)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(x), BLOCK):
            cosine = self.latent(x[lo : lo + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** POWER
            out[lo : lo + BLOCK] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, dimensions: int = DIMENSIONS) -> Voter:
    """Latent axes and labelled vectors of the rows of ``x`` with labels ``y``."""
    if not len(x):
        return Voter(np.zeros(TERMS + SHAPES, np.float32), np.ones(TERMS + SHAPES, np.float32), np.zeros((TERMS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    mean = x.mean(0)
    seen = (x[:, :TERMS] > 0).sum(0)
    scale = np.r_[np.log((1 + len(x)) / (1 + seen)) + 0.1, SHAPE_WEIGHT / np.maximum(x[:, TERMS:].std(0), 1e-3) / np.sqrt(SHAPES)].astype(np.float32)
    z = (x - mean) * scale
    _, _, vt = np.linalg.svd(z.T @ z)
    voter = Voter(mean, scale, np.ascontiguousarray(vt[:dimensions].T), np.zeros((0, 1)), y.astype(np.float32))
    voter.vectors = voter.latent(x)
    return voter


def crc_mod(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def labelled_sample(labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """(doc_id, label): at most ``most`` labelled rows, the same ones in every run."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = SAMPLE) -> Voter:
    """A voter learned from at most ``sample`` rows of ``labels`` for which ``learn`` (over doc_id) holds."""

    def featured(batches):
        for batch in batches:
            x = quality_features(batch.column(1)).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    picked = docs.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, label, learn, sample)), "doc_id").select("label", "text", "doc_id")
    rows = picked.select("label", "text").mapInArrow(tidy(featured), "label int, x binary").limit(2 * sample).collect()  # bounded by the sample
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), "<f4").reshape(len(rows), TERMS + SHAPES)
    order = np.lexsort((np.arange(len(rows)), *(x[:, TERMS:].T))) if len(rows) else np.zeros(0, int)
    return fit(x[order], np.array([r["label"] for r in rows], np.float32)[order])


def score(docs: DataFrame, voter: Voter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id, text) with a score from 0 to 1 for each row; higher means that label 1 is likelier.

    A null text counts as empty and gets a score as any other; nulls elsewhere and repeated rows change
    nothing; without labelled rows every score is 0.5. An empty table gives an empty table.
    """
    bounded(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(voter)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [held.value.score(quality_features(batch.column(1).slice(lo, BLOCK))) for lo in range(0, batch.num_rows, BLOCK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(scored), "doc_id long, score double")


def with_score(docs: DataFrame, voter: Voter, name: str) -> DataFrame:
    """``docs`` with all its columns and the score of its ``text`` as one more; nothing is moved."""
    bounded(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(voter)
    at = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, BLOCK) for b in batches for lo in range(0, b.num_rows, BLOCK)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(quality_features(batch.column(at))))], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidy(scored), StructType([*docs.schema.fields, StructField(name, DoubleType())]))
