"""WARC archives and a Merkle fixity audit of their replicas; the audit is of DataFrame functions only.

A record's leaf is the hash of its bytes with its offset range; a node is the hash of up to FAN_OUT nodes that
follow each other. The audit compares the roots of two copies of each archive and descends only into branches
that differ, so what it moves follows the damage and not the archive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import saved

FAN_OUT = 16
#: Ids of one archive file; also bounds what one window or node holds.
PER_ARCHIVE = 4096
LEVELS = 3  # FAN_OUT ** LEVELS == PER_ARCHIVE
END = "\r\n\r\n"
#: The time of records of which none is known, as the format asks for one.
DATE = "1970-01-01T00:00:00Z"
NO_ID_ARCHIVE, NO_ID_SPREAD = -(1 << 60), 1 << 16
#: Bytes of bodies in one batch, but for a single larger one.
READ_BYTES = 4 << 20


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """The bytes of a resource record, as text, without the two line ends that close it."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    return F.concat(head, body)


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """WARC files under ``path``: whole records, each closed by two line ends; ``date`` is the time of all of them."""
    pages.select(record(F.col("page_id"), F.col("url"), F.col("html"), date).alias("value")).write.option("lineSep", END).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of the resource records of WARC files, each as long as its Content-Length says, whatever its body holds.

    A file is read by one task. Bytes that aren't UTF-8 become replacement characters; what follows a record that
    is cut short or has no length is left out.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, size = END.encode(), re.compile(rb"(?i)^Content-Length:[ \t]*([0-9]+)[ \t]*\r?$", re.M)
        uri, kind = re.compile(rb"(?i)^WARC-Target-URI:[ \t]*([^\r\n]*)", re.M), re.compile(rb"(?i)^WARC-Type:[ \t]*resource[ \t]*\r?$", re.M)
        for batch in batches:
            for data in batch.column(0):
                raw, at, out, held = data.as_buffer().to_pybytes(), 0, [], 0
                while (stop := raw.find(end, at)) >= 0:
                    head = raw[at:stop]
                    length = size.search(head)
                    start = stop + len(end)
                    if length is None or start + int(length[1]) > len(raw):
                        break
                    at = start + int(length[1])
                    if kind.search(head):
                        found = uri.search(head)
                        out.append((found[1].decode(errors="replace") if found else None, raw[start:at].decode(errors="replace")))
                        held += at - start
                    at += len(end) * (raw[at : at + len(end)] == end)
                    if held > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["url", "html"])
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["url", "html"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(records, "url string, html string")


def leaves(pages: DataFrame, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """(page_id, archive, position, offset, length, hash) of each page's record; bodies aren't moved."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    # Pages without an id are spread by what they hold over archives of their own.
    unnamed = F.lit(NO_ID_ARCHIVE) - F.pmod(F.xxhash64("url", "html"), F.lit(NO_ID_SPREAD))
    rows = pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / per_archive).cast("long"), unnamed).alias("archive"), (F.octet_length(text) + len(END)).cast("long").alias("length"), F.sha2(text, 256).alias("hash"))
    order = Window.partitionBy("archive").orderBy("page_id", "hash")
    rows = rows.withColumn("position", F.row_number().over(order).cast("long") - 1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def tree(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(level, archive, node, hash): level 0 are the leaves, the last level holds an archive's root.

    Where ids repeat, an archive outgrows FAN_OUT ** levels rows; its last level then has several nodes, which
    are compared one by one.
    """
    nodes = rows.select(F.lit(0).alias("level"), "archive", F.col("position").alias("node"), F.sha2(F.concat_ws(":", "offset", "length", "hash"), 256).alias("hash"))
    out = nodes
    for level in range(1, levels + 1):
        nodes = nodes.groupBy("archive", F.floor(F.col("node") / FAN_OUT).alias("node")).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.col("node").alias("n"), "hash"))), lambda x: x["hash"])), 256).alias("hash"))
        nodes = nodes.select(F.lit(level).alias("level"), "archive", "node", "hash")
        out = out.unionByName(nodes)
    return out


def differing(first: DataFrame, second: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(archive, position) of leaves that differ or that one tree lacks; both are trees by ``tree``."""
    bad = None
    for level in range(levels, -1, -1):
        sides = [t.where(F.col("level") == level).select("archive", "node", F.col("hash").alias(h)) for t, h in ((first, "h1"), (second, "h2"))]
        if bad is not None:
            below = bad.select("archive", F.explode(F.sequence(F.col("node") * FAN_OUT, F.col("node") * FAN_OUT + FAN_OUT - 1)).alias("node"))
            sides = [s.join(below, ["archive", "node"], "left_semi") for s in sides]
        bad = sides[0].join(sides[1], ["archive", "node"], "full").where(~F.col("h1").eqNullSafe(F.col("h2"))).select("archive", "node")
    return bad.withColumnRenamed("node", "position")


def audit(pages: DataFrame, replica: DataFrame, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """(page_id, archive, record_offset, record_length, record_sha256, damaged) of each record of ``pages``.

    ``damaged`` tells whether the replica's record at that place has another hash or offset range, or is
    missing; ``differing`` on the two trees also names places that only the replica has. Null urls and bodies
    are empty; pages with a null id lie in archives of their own, NO_ID_SPREAD of them; repeated pages are records of their own; columns
    but page_id, url and html are ignored. Empty tables give empty tables.
    """
    mine, theirs = saved(leaves(pages, per_archive), "leaves"), saved(leaves(replica, per_archive), "leaves")
    trees = [saved(tree(x), "tree", "level") for x in (mine, theirs)]  # a level is read alone
    bad = differing(*trees).withColumn("bad", F.lit(True))
    out = mine.join(bad, ["archive", "position"], "left")
    return out.select("page_id", "archive", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("hash").alias("record_sha256"), F.coalesce("bad", F.lit(False)).alias("damaged"))
