"""Exchange of fingerprints by bucket: packed blobs instead of a row for each fingerprint.

Every task packs the fingerprints of its rows by bucket (a row for a bucket and some million
fingerprints), so a shuffle moves 7 bytes for each fingerprint and JVM work follows the blobs, not the
fingerprints. A bucket and the 56 bits that are sent identify a fingerprint with 56 + log2(buckets) bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .bytehash import mix, tidy

KEY_BYTES = 7
MASK = np.uint64((1 << 8 * KEY_BYTES) - 1)
#: Bytes of input for each bucket at most, as files have them, and the number of buckets beyond which they grow instead.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 100_000
#: What the planner says of rows that no file holds.
UNKNOWN = 1 << 60
#: Fingerprints that a task packs at once.
PACK = 500_000
#: Bytes of answers in one Arrow batch, but for a single larger row.
ANSWER_BYTES = 4 << 20
SCHEMA = "bucket int, keys binary, ids binary"
ARROW = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])


def buckets(df: DataFrame) -> int:
    """A partition for each bucket: as many as the session's shuffle partitions, and more where these would hold too much of ``df``.

    Sizes are those that the planner knows before anything runs, such as the bytes of the files that are read.
    """
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = 0 if known >= UNKNOWN else known
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(known // BUCKET_BYTES, MOST_BUCKETS))


def pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :KEY_BYTES] = raw
    return out.view("<u8").reshape(-1)


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids in the order given, of several columns one after the other; runs of one id cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(ids.T.ravel(), prepend=0).astype("<i8").tobytes())


def unpack_ids(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8"))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.uint16 if n <= 1 << 16 else np.int64)


def joined(parts: tuple[list, ...]) -> list[np.ndarray]:
    """Each list of arrays as one array; the lists are emptied, so that no array is held twice for long."""
    out = []
    for part in parts:
        out.append(np.concatenate(part))
        part.clear()
    return out


def dealt(keys: np.ndarray, ids: np.ndarray, n: int) -> pa.RecordBatch:
    """A row for each bucket that any of the keys falls into."""
    b = bucket_of(keys, n)
    order = np.argsort(b, kind="stable")
    keys, ids, b = keys[order] & MASK, ids[order], b[order]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    ends = np.r_[first[1:], len(b)]
    return pa.RecordBatch.from_arrays(
        [pa.array(b[first].astype(np.int32)), pa.array([pack_keys(keys[s:e]) for s, e in zip(first, ends)], pa.binary()), pa.array([pack_ids(ids[s:e]) for s, e in zip(first, ends)], pa.binary())],
        schema=ARROW,
    )


def packed(df: DataFrame, fingerprints: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], n: int) -> DataFrame:
    """Rows (bucket, keys, ids) of all fingerprints of ``df``, not yet moved.

    ``fingerprints(batch)`` yields pairs of arrays: 64-bit hashes and, for each, the id it belongs to.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0
        for batch in batches:
            for keys, ids in fingerprints(batch):
                held[0].append(keys)
                held[1].append(ids)
                size += len(keys)
                if size >= PACK:
                    yield dealt(*joined(held), n)
                    size = 0
        if size:
            yield dealt(*joined(held), n)

    return df.mapInArrow(tidy(pack), SCHEMA)


def send(df: DataFrame, fingerprints: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], n: int) -> DataFrame:
    """``packed`` rows, each bucket in one partition of n."""
    return packed(df, fingerprints, n).repartitionById(n, "bucket")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, keys, ids) of each bucket of a partition, in no order."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for b, k, i in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            keys, ids = held.setdefault(b, ([], []))
            keys.append(unpack_keys(k.as_buffer()))
            ids.append(unpack_ids(i.as_buffer()))
    for b in list(held):
        yield b, *joined(held.pop(b))


def replies(ids: np.ndarray, columns: list[np.ndarray], n: int) -> list[tuple[int, bytes, list[bytes]]]:
    """(place, ids, columns) of answers packed by the place where an id's answers meet."""
    b = bucket_of(mix(ids.astype(np.uint64)), n)
    order = np.lexsort((ids, b))
    ids, b, columns = ids[order], b[order], [c[order] for c in columns]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    return [(int(b[s]), pack_ids(ids[s:e]), [c[s:e].tobytes() for c in columns]) for s, e in zip(first, np.r_[first[1:], len(b)])]


def reply_batch(rows: list[tuple[int, bytes, list[bytes]]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), *(pa.array([r[2][i] for r in rows], pa.binary()) for i in range(len(names)))],
        names=["place", "ids", *names],
    )


def reply_schema(names: list[str]) -> str:
    return ", ".join(["place int", "ids binary", *(f"{c} binary" for c in names)])


def per_id(answers: DataFrame, names: list[str], sizes: list[int], n: int) -> DataFrame:
    """(id, columns ...): of each id one row, its answers one after the other; ``sizes`` are bytes a value."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], *([] for _ in names))
        for batch in batches:
            for i in range(batch.num_rows):
                held[0].append(unpack_ids(batch.column(1)[i].as_buffer()))
                for c, size, part in zip(batch.columns[2:], sizes, held[1:]):
                    part.append(np.frombuffer(c[i].as_buffer(), np.uint8).reshape(-1, size))
        if not held[0]:
            return
        (ids,) = joined(held[:1])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ends = np.r_[first[1:], len(ids)]
        columns = [joined((part,))[0][order] for part in held[1:]]
        del order
        lo, most = 0, ANSWER_BYTES // sum(sizes)
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + most, "right")))
            part = list(zip(first[lo:hi].tolist(), ends[lo:hi].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first[lo:hi]]), *(pa.array([c[s:e].tobytes() for s, e in part], pa.binary()) for c in columns)], names=["id", *names])
            lo = hi

    return answers.select("place", "ids", *names).repartitionById(n, "place").mapInArrow(tidy(meet), ", ".join(["id long", *(f"{c} binary" for c in names)]))
