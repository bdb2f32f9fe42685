"""Running numbers and running hashes over the sorted rows of each key, with a key spread over as many tasks as it needs.

Rows are dealt out by ranges of (key, order), so a key with a third of all rows lies in many partitions, one after the
other. Every partition is numbered and hashed from its own first row; the driver then chains one row for the first and
one for the last key of each partition (two rows a partition, whatever the input), and a second pass adds what came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bounded, drop, saved

#: Odd multipliers of the two hashes; a further seed gives others.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def multipliers(seed: int) -> tuple[int, ...]:
    return tuple(m * pow(0xD6E8FEB86659FD93, seed, 1 << 64) % (1 << 64) for m in MULTIPLIERS)


def _powers(m: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(m))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _local(batch: pa.RecordBatch, before: tuple, seed: int) -> tuple[np.ndarray, list[np.ndarray], tuple]:
    """Place within its key and the two hashes of each row's key so far; ``before``: (key, count, hashes) of the last row."""
    keys = batch.column(0).to_numpy()
    n = len(keys)
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[start, n])
    k = np.arange(n) - np.repeat(start, sizes)
    words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(n, -1)
    goes_on = sizes[0] if before[0] == keys[0] else 0
    states = []
    for j, m in enumerate(multipliers(seed)):
        down, up = _powers(pow(m, -1, 1 << 64), n), _powers(m, n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words[:, j] * down[:n], dtype=np.uint64)))
        state = (total[1:] - np.repeat(total[start], sizes)) * up[:n]
        state[:goes_on] += np.uint64(before[2][j]) * up[1 : goes_on + 1]
        states.append(state)
    k[:goes_on] += before[1]
    return k, states, (int(keys[-1]), int(k[-1]) + 1, tuple(int(s[-1]) for s in states))


def scan(rows: DataFrame, order: list[Column], seed: int = 0) -> DataFrame:
    """``rows`` (key long, digest binary of 16 bytes or more, ...) with i, last, h0, h1: the row's number in its key, from 0,
    whether it is the key's last, and two hashes of the digests up to it. Written once; ``order`` sorts the rows of a key.
    """
    spark = rows.sparkSession
    bounded(spark)
    names = rows.columns
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows that agree in all of the order are split by their number in the input.
    dealt = rows.withColumn("__n", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(n, F.col("key"), *order, F.col("__n")).sortWithinPartitions(F.col("key"), *order, F.col("__n")).select("key", "digest", *[c for c in names if c not in ("key", "digest")])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        before: tuple = (None, 0, (0, 0))
        held, first = None, None

        def out(batch, last, final=False):  # the last row of a partition is an edge, and so is that of its first key
            keys = batch.column(0).to_numpy()
            ends = np.r_[keys[1:] != keys[:-1], last]
            edge = ends & (keys == first)
            edge[-1] |= final
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends), pa.array(edge), pa.array(np.full(len(keys), pid))], names=[*batch.schema.names, "last", "edge", "pid"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, states, after = _local(batch, before, seed)
            first = int(batch.column(0)[0].as_py()) if first is None else first
            full = pa.RecordBatch.from_arrays([*batch.columns, pa.array(k), *(pa.array(s.view(np.int64)) for s in states)], names=[*batch.schema.names, "i", "h0", "h1"])
            if held is not None:
                yield out(held, before[0] != batch.column(0)[0].as_py())
            held, before = full, after
        if held is not None:
            yield out(held, True, True)

    kept = dealt.schema.simpleString().removeprefix("struct<")[:-1]
    local = saved(dealt.mapInArrow(number, f"{kept}, i: bigint, h0: bigint, h1: bigint, last: boolean, edge: boolean, pid: bigint"), "scan")
    sums: dict[tuple[int, int], tuple] = {}
    before: tuple = (None, 0, (0, 0))
    goes_on: set[tuple[int, int]] = set()
    mult = multipliers(seed)
    was = None
    for r in sorted(local.where("edge").select("pid", "key", "i", "h0", "h1").collect(), key=lambda r: (r.pid, r.key)):
        count, state = r.i + 1, (r.h0 % (1 << 64), r.h1 % (1 << 64))
        if before[0] == r.key:
            goes_on.add(was)
            sums[r.pid, r.key] = before[1:]
            state = tuple((b * pow(m, count, 1 << 64) + s) % (1 << 64) for b, m, s in zip(before[2], mult, state))
            count += before[1]
        before, was = (r.key, count, state), (r.pid, r.key)
    if not sums:
        out = local.drop("edge", "pid")
        out._scratch_path = local._scratch_path
        return out

    def lifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).copy() for c in ("key", "pid", "i", "h0", "h1", "last")}
            for p in np.unique(get["pid"]).tolist():
                for pid, key in ({k for k in sums if k[0] == p} | {k for k in goes_on if k[0] == p}):
                    at = np.flatnonzero((get["pid"] == pid) & (get["key"] == key))
                    if not len(at):
                        continue
                    if (pid, key) in sums:
                        count, state = sums[pid, key]
                        i, least = get["i"][at], int(get["i"][at].min())
                        for c, m, b in zip(("h0", "h1"), mult, state):
                            lift = _powers(m, int(i.max()) - least)[i - least] * np.uint64(b * pow(m, least + 1, 1 << 64) % (1 << 64))
                            get[c][at] += lift.view(np.int64)
                        get["i"][at] += count
                    if (pid, key) in goes_on:
                        get["last"][at] = False
            yield pa.RecordBatch.from_arrays([pa.array(get[c]) if c in ("i", "h0", "h1", "last") else batch.column(batch.schema.get_field_index(c)) for c in wanted], names=wanted)

    wanted = [c for c in local.columns if c not in ("edge", "pid")]
    kinds = dict(local.dtypes)
    out = saved(local.mapInArrow(lifted, ", ".join(f"{c} {kinds[c]}" for c in wanted)), "scan")
    drop(local)
    return out
