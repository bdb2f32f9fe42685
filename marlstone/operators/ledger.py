"""A hash-chained, append-only audit log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "0" * 64


def entry_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), payload), 256)


def payload(*columns: str) -> Column:
    """Canonical text of an entry: JSON of the columns in the order of their names, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def chained(rows: DataFrame, ledger: str = "ledger", heads: DataFrame | None = None) -> DataFrame:
    """``rows`` (ledger, seq, payload) with prev_hash and entry_hash, in order of seq, one ledger at a time.

    A chain begins at its ledger's row of ``heads`` (ledger, head) or at GENESIS. A chain is sequential by
    nature; ledgers are independent and run in parallel. A ledger's rows stream by in order and only its head
    is held, so a long chain takes time and no memory.
    """
    rows = rows.select(ledger, F.col("seq").cast("long").alias("seq"), "payload")
    rows = rows.join(heads.select(ledger, "head"), ledger, "left") if heads is not None else rows.withColumn("head", F.lit(None).cast("string"))
    rows = rows.repartition(ledger).sortWithinPartitions(ledger, "seq", "payload")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        for batch in batches:
            before, after = [], []
            for name, text, head in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                previous = held[1] if held and held[0] == name else head or GENESIS
                fresh = None if text is None else hashlib.sha256(f"{previous}|{text}".encode()).hexdigest()
                before.append(previous)
                after.append(fresh)
                held = (name, fresh or previous)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*batch.schema.names[:3], "prev_hash", "entry_hash"])

    kind = rows.schema[ledger].dataType.simpleString()
    return rows.mapInArrow(walk, f"`{ledger}` {kind}, seq long, payload string, prev_hash string, entry_hash string")


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of the canonical text of some columns."""
    return F.sha2(payload(*columns), 256)


def recent(entries: DataFrame, n: int, ledger: str = "ledger") -> DataFrame:
    """The last n entries of each ledger, newest first, with their place from the end."""
    order = Window.partitionBy(ledger).orderBy(F.desc("seq"))
    return entries.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)


def verified(entries: DataFrame, ledger: str = "ledger") -> DataFrame:
    """(ledger, n, broken_at): the first seq whose link or own hash is wrong, null if none is.

    Hashes are recomputed in parallel; only the look at the entry before is ordered.
    """
    before = F.lag("entry_hash", 1, GENESIS).over(Window.partitionBy(ledger).orderBy("seq"))
    bad = (F.col("prev_hash") != before) | (F.col("entry_hash") != entry_hash(F.col("prev_hash"), F.col("payload")))
    return entries.withColumn("bad", bad).groupBy(ledger).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("broken_at"))


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before of the same key; the first of a key isn't a change but is kept, marked."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    seen = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    out = rows.withColumn("previous", before).withColumn("changed", seen > 1)
    return out.where((F.col("changed") == F.lit(False)) | ~F.col("previous").eqNullSafe(F.col(value)))
