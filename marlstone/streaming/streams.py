"""Structured Streaming twins: scans of a stream, changes by source, and a chained log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.guard import scan
from ..operators.ledger import chained, payload
from ..operators.risk import assess

CHANGE = "key string, seq long, value string, previous string, changed boolean"


def scanned(stream: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """A stream of texts with entities, redaction under a key and verdict; no state."""
    return scan(stream, key, text_col)


def assessed(stream: DataFrame, text_col: str = "text") -> DataFrame:
    return assess(stream, text_col)


def changes(stream: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """(key, seq, value, previous, changed) whenever a key's value differs from its last one; the first isn't a change.

    The state of a key is its last value. Rows of one micro-batch are taken in order of ``seq``.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        known, last = (True, state.get[0]) if state.exists else (False, None)
        out = []
        for s, v in zip(rows["seq"], rows["value"]):
            if not known or v != last:
                out.append((k[0], s, v, last if known else None, known))
            known, last = True, v
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "seq", "value", "previous", "changed"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, CHANGE, "last string", "append", GroupStateTimeout.NoTimeout)


def append_log(stream: DataFrame, path: str, checkpoint: str, ledger: str = "ledger") -> StreamingQuery:
    """Appends each micro-batch of ``stream`` (ledger, seq, event, summary) to a chained log at ``path``.

    The chain of a batch goes on from each ledger's last entry; a table of the heads after each batch spares
    a look at the log itself. Log and heads of a batch lie in folders of its own number, so a batch that runs
    again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(ledger, F.col("seq").cast("long").alias("seq"), payload("event", "seq", "summary").alias("payload"))
        old = spark.read.parquet(f"{path}/_heads/batch={number - 1}") if number else None
        chained(rows, ledger, old).write.mode("overwrite").parquet(f"{path}/batch={number}")
        last = spark.read.parquet(f"{path}/batch={number}").groupBy(ledger).agg(F.max_by("entry_hash", "seq").alias("head"))
        if old is not None:
            last = last.unionByName(old.join(last.select(ledger), ledger, "left_anti"))
        last.write.mode("overwrite").parquet(f"{path}/_heads/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table_as_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
