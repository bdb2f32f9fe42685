"""Substring dedup with a log-structured index of window fingerprints.

The index is a list of immutable runs. A run holds, for each bucket, the sorted fingerprints of the windows
of past documents with the smallest id that each occurred in. A new batch of documents is dealt out by
bucket, merge-joined with every run, and leaves a run of its own; when runs of like size gather they are
compacted into one. The index lives in a folder: the runs, and a manifest of them for each state, so that another
session goes on where one ended. A fingerprint has two parts from independent hashes: the first places and orders
it, the second verifies a match.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .bytehash import chunks, prefix, range_hash, windows, words
from .keys import keyed
from .scratch import bounded, create, folder, listed, read, remove

NO_ID = -(1 << 63)
#: How often ``add`` begins anew because another writer was faster.
ATTEMPTS = 10
CHECK = np.uint64((1 << 24) - 1)
#: kind 0: keys that documents must drop, packed for the place ``bucket``; kind 1: a bucket of a run.
ROWS = "kind int, bucket int, keys binary, ids binary"


def window_keys(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, row of the word) of all windows of k words; the words are those of ``words``."""
    start, end, row = words(data, at)
    h, first = windows(range_hash(prefix(data), start, end), row, k)
    check, _ = windows(range_hash(prefix(data, 1), start, end), row, k)
    return (h & ~CHECK) | (check & CHECK), first, row


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each key in that order, distinct keys, smallest id of each)."""
    order = np.argsort(keys)
    k = keys[order]
    fresh = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    return order, np.cumsum(fresh) - 1, k[starts], np.minimum.reduceat(ids[order], starts) if len(k) else ids


def _plain(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<i8").tobytes())


def _rows(kind: int, buckets: list[int], keys: list[bytes], ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.int32()), pa.array(buckets, pa.int32()), pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], names=["kind", "bucket", "keys", "ids"])


class FingerprintIndex:
    """The runs of all batches so far; ``add`` answers for a batch and takes it in.

    With a ``path`` that holds an index, that index is opened, with its own k and number of buckets. Each state
    is a manifest of its own, one small file that is created after its runs and only if no other writer has its
    number, so a broken ``add`` leaves the state before it, and of two writers the slower one begins anew on what
    the faster one left. ``sweep`` deletes what no manifest names.
    """

    def __init__(self, spark: SparkSession, k: int = 13, fan_in: int = 2, n: int | None = None, path: str | None = None):
        self.spark, self.fan_in, self.k = spark, fan_in, k
        self.n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.private = path is None
        self.path = path or f"{folder(spark)}/index-{uuid.uuid4().hex}"
        self.state, self.runs = 0, []  # (level, name of a run)
        self._open()

    def _open(self) -> None:
        """Takes the last state of the folder, if it has one."""
        states = [int(x.split("-")[1].split(".")[0]) for x in listed(self.spark, self.path) if x.startswith("manifest-") and x.endswith(".json")]
        if states:
            self.state = max(states)
            held = json.loads(read(self.spark, f"{self.path}/manifest-{self.state}.json"))
            self.k, self.n, self.runs = held["k"], held["n"], [(level, name) for level, name in held["runs"]]

    def run(self, name: str) -> DataFrame:
        return self.spark.read.schema("bucket int, keys binary, ids binary").parquet(f"{self.path}/{name}/kind=1").select(F.lit(1).alias("kind"), "bucket", "keys", "ids")

    def _write(self, rows: DataFrame) -> str:
        """Rows of both kinds, in a folder for each."""
        bounded(self.spark)
        name = f"run-{uuid.uuid4().hex}"
        rows.write.partitionBy("kind").parquet(f"{self.path}/{name}")
        return name

    def _manifest(self, runs: list[tuple[int, str]]) -> bool:
        """Whether the state with these runs is the next one; not if another writer's is.

        The manifest before stays: a writer that still builds on it must find its number taken.
        """
        held = json.dumps({"k": self.k, "n": self.n, "runs": runs}).encode()
        if not create(self.spark, f"{self.path}/manifest-{self.state + 1}.json", held):
            return False
        self.state, self.runs = self.state + 1, runs
        return True

    def sweep(self) -> list[str]:
        """Deletes the runs that no state names, such as those of a broken ``add``, with their answers; names them.

        For a time when nobody adds and no answer is read any more.
        """
        self._open()
        named = {name for _, name in self.runs}
        gone = [x for x in listed(self.spark, self.path) if x.startswith("run-") and x not in named]
        for name in gone:
            remove(self.spark, f"{self.path}/{name}")
        for name in named:
            remove(self.spark, f"{self.path}/{name}/kind=0")
        return gone

    def drop(self) -> None:
        """Deletes the index; answers that were given stay."""
        for _, name in self.runs:
            remove(self.spark, f"{self.path}/{name}/kind=1")

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """(place, keys, ids): of the documents of ``docs`` (id, text) the windows that a smaller id has too, packed.

        A batch may hold any ids: those of the index and of the batch both count, but answers for earlier
        batches aren't taken back. With a column ``row``, a key that no two rows share, answers are by it instead of by
        id, so that each row of a repeated id gets its own. With ``last`` no run is written and the index stays as it was.
        """
        for _ in range(ATTEMPTS):
            name, runs = self._answered(docs, last)
            if last:
                break
            runs, merged = self._compact(runs)
            known = {x for _, x in self.runs}
            if self._manifest(runs):
                if self.private:  # elsewhere another writer may still read them; ``sweep`` deletes them
                    for old in merged:
                        remove(self.spark, f"{self.path}/{old}/kind=1")
                break
            for own in {name, *merged, *(x for _, x in runs)} - known:
                remove(self.spark, f"{self.path}/{own}")
            self._open()
        else:
            raise RuntimeError(f"{ATTEMPTS} other writers were faster")
        if "kind=0" not in listed(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], "place int, keys binary, ids binary")
        answers = self.spark.read.schema("bucket int, keys binary, ids binary").parquet(f"{self.path}/{name}/kind=0")
        return answers.select(F.col("bucket").alias("place"), "keys", "ids")

    def _answered(self, docs: DataFrame, last: bool) -> tuple[str, list[tuple[int, str]]]:
        """The folder with the answers for ``docs`` and the runs with the one it leaves."""
        k, n, rowed = self.k, self.n, "row" in docs.columns
        docs = docs.select("id", "text", *(["row"] if rowed else []))

        def fingerprints(batch):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if rowed:
                ids = np.stack([ids, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            for lo, _, data, at in chunks(batch.column(1)):
                keys, first, row = window_keys(data, at, k)
                yield keys, ids[row[first] + lo]

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh: dict[int, tuple[list, list]] = {}
            past: dict[int, list] = {}
            for batch in batches:
                for kind, b, keys, ids in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2), batch.column(3)):
                    if kind:
                        past.setdefault(b, []).append((exchange.unpack_keys(keys.as_buffer()), np.frombuffer(zstandard.ZstdDecompressor().decompress(ids.as_buffer()), "<i8")))
                    else:
                        held = fresh.setdefault(b, ([], []))
                        held[0].append(exchange.unpack_keys(keys.as_buffer()))
                        sent = exchange.unpack_ids(ids.as_buffer())
                        held[1].append(sent.reshape(2, -1) if rowed else sent)
            while fresh:
                b, (keys, ids) = fresh.popitem()
                keys, ids = np.concatenate(keys), np.concatenate(ids, axis=-1)
                ids, askers = ids if rowed else (ids, ids)
                order, group, distinct, least = _least(keys, ids)
                known = least.copy()
                for run_keys, run_ids in past.pop(b, []):  # both sides are sorted
                    at = np.minimum(np.searchsorted(run_keys, distinct), max(0, len(run_keys) - 1))
                    if len(run_keys):
                        known = np.where(run_keys[at] == distinct, np.minimum(known, run_ids[at]), known)
                later = ids[order] > known[group]
                packed = exchange.replies(askers[order][later], [keys[order][later]], n)
                yield _rows(0, [r[0] for r in packed], [r[2][0] for r in packed], [r[1] for r in packed])
                if not last:
                    yield _rows(1, [b], [exchange.pack_keys(distinct)], [_plain(least)])

        rows = exchange.packed(docs, fingerprints, n).select(F.lit(0).alias("kind"), "bucket", "keys", "ids")
        for _, name in self.runs:
            rows = rows.unionByName(self.run(name))
        name = self._write(rows.repartitionById(n, "bucket").mapInArrow(answer, ROWS))
        return name, self.runs if last else [*self.runs, (0, name)]

    def _compact(self, runs: list[tuple[int, str]]) -> tuple[list[tuple[int, str]], list[str]]:
        """``runs`` with those of one level merged, once ``fan_in`` of them are there, into one of the next, and those that are merged."""
        merged_away: list[str] = []
        runs = [r for r in runs if "kind=1" in listed(self.spark, f"{self.path}/{r[1]}")]  # a batch without windows leaves none
        while runs and len(same := [r for r in runs if r[0] == runs[-1][0]]) >= self.fan_in:
            level, n = same[0][0], self.n

            def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held: dict[int, tuple[list, list]] = {}
                for batch in batches:
                    for b, keys, ids in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                        x = held.setdefault(b, ([], []))
                        x[0].append(exchange.unpack_keys(keys.as_buffer()))
                        x[1].append(np.frombuffer(zstandard.ZstdDecompressor().decompress(ids.as_buffer()), "<i8"))
                while held:
                    b, (keys, ids) = held.popitem()
                    _, _, distinct, least = _least(np.concatenate(keys), np.concatenate(ids))
                    yield _rows(1, [b], [exchange.pack_keys(distinct)], [_plain(least)])

            both = self.run(same[0][1])
            for _, name in same[1:]:
                both = both.unionByName(self.run(name))
            merged = self._write(both.repartitionById(n, "bucket").mapInArrow(merge, ROWS))
            merged_away += [name for _, name in same]
            runs = [r for r in runs if r[0] != level] + [(level + 1, merged)]
        return runs, merged_away


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, history: tuple[float, ...] = (0.0625, 0.125)) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each word that lies in a repeated window is removed.

    Words are runs of bytes other than ASCII white space, unchanged. A window of k words is repeated if its
    words also start somewhere in a row with a smaller id; ``kept`` joins what is left by one space. The rows
    go through the index in batches of rising ids that end at the quantiles ``history`` of the ids and at the
    last; where they end changes no result. A null text has no words; a null id is smaller than all others;
    rows of one id don't remove each other's words, and each gets its own answer; texts of fewer than k words stay whole. Other columns
    are ignored. An empty table gives an empty table.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    docs, single = keyed(docs, "id", "row")
    if single:
        docs = docs.drop("row")
    row = "id" if single else "row"
    spark = docs.sparkSession
    ends = docs.select(F.percentile_approx("id", list(history), 1000).alias("q")).first()["q"] or []
    ends = sorted({*ends})
    index = FingerprintIndex(spark, k, n=exchange.buckets(docs))
    found = None
    for i in range(len(ends) + 1):
        part = docs
        if i:
            part = part.where(F.col("id") > ends[i - 1])
        if i < len(ends):
            part = part.where(F.col("id") <= ends[i])
        hits = index.add(part, last=i == len(ends))
        found = hits if found is None else found.unionByName(hits)
    index.drop()
    found = exchange.per_id(found, ["keys"], [8], index.n)

    def small(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([squeeze.compress(x.as_buffer()) if x.is_valid else squeeze.compress(b"") for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z], names=["id", "doc_id", "z"])

    def cut(batches):
        wide = zstandard.ZstdDecompressor()
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            texts = [wide.decompress(x.as_buffer()) for x in batch.column(1)]
            counts, removed, kept = [], [], []
            for text, keys in zip(texts, batch.column(2).to_pylist()):
                tokens = text.split()
                counts.append(len(tokens))
                if keys:
                    data = np.frombuffer(text, np.uint8)
                    mine, first, _ = window_keys(data, np.array([0, len(data)]), k)
                    start = first[np.isin(mine & exchange.MASK, np.frombuffer(keys, "<u8"))]
                    cover = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + k, -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    tokens = list(compress(tokens, stay.tolist()))
                removed.append(counts[-1] - len(tokens))
                kept.append(b" ".join(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    out = docs.select(F.col(row), F.col("id").alias("doc_id"), "text").mapInArrow(small, "id long, doc_id long, z binary").join(found.hint("shuffle_hash"), "id", "left")
    out = out.select("doc_id", "z", "keys").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
