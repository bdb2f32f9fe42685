"""A hash-chained log that several writers append to in batches.

A batch is written beside the log first and becomes part of it by one small commit file with the next number, which is
created only if no other writer has it; whoever comes second chains its rows anew to what is there now. Commits are signed
and name the signature of the one before. A second file of the same number, in a folder of its own, vouches for the
commit, so that a tail that was cut off shows, also to a reader who never saw it.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ledger import GENESIS, chained, verified

ATTEMPTS = 50
ENTRY = "ledger string, seq long, payload string, prev_hash string, entry_hash string"
HEADS = "ledger string, head string, last long"


class Files:
    """Whole small files in a folder that all sessions share."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        at = self._at("")
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> bytes:
        """The file's bytes; a file that its writer hasn't closed is waited for."""
        for _ in range(ATTEMPTS):
            size = self.fs.getFileStatus(self._at(name)).getLen()
            if size:
                stream = self.fs.open(self._at(name))
                try:
                    return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                finally:
                    stream.close()
            time.sleep(0.05)
        raise OSError(f"{name} stays empty")

    def create(self, name: str, data: bytes) -> bool:
        """Whether the file is new; one that is there already is left as it is."""
        at = self._at(name)
        self.fs.mkdirs(at.getParent())
        if self.fs.getScheme() == "file":  # Hadoop's local files look first and create then; a link does both at once
            nio, local = self.jvm.java.nio.file, at.toUri().getPath()
            paths = self.jvm.java.nio.file.Paths
            none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.lang.String"), 0)
            fresh, target = paths.get(f"{local}.{uuid.uuid4().hex}.part", none), paths.get(local, none)
            self._write(self.jvm.java.io.FileOutputStream(fresh.toString()), data)
            try:
                nio.Files.createLink(target, fresh)
                return True
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            finally:
                nio.Files.delete(fresh)
        try:
            self._write(self.fs.create(at, False), data)
            return True
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise

    def delete(self, name: str) -> None:
        """Deletes a file or a folder; none is deleted already."""
        self.fs.delete(self._at(name), True)

    @staticmethod
    def _write(stream, data: bytes) -> None:
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()


class Log:
    """The log at ``path``; ``key`` signs its commits."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key.encode()
        self.files = Files(spark, path)

    def _signed(self, body: dict) -> str:
        return hmac.new(self.key, json.dumps(body, sort_keys=True).encode(), hashlib.sha256).hexdigest()

    def _names(self, folder: str) -> list[str]:
        return [n for n in self.files.names(folder) if n.endswith(".json")]

    def commits(self) -> list[dict]:
        return [json.loads(self.files.read(f"commits/{n}")) for n in self._names("commits")]

    def _last(self) -> dict | None:
        names = self._names("commits")
        return json.loads(self.files.read(f"commits/{names[-1]}")) if names else None

    def append(self, rows: DataFrame, *order: Column | str) -> dict:
        """Appends ``rows`` (ledger, payload, ...) in ``order`` within each ledger; gives the commit, which is a receipt.

        Numbers of a ledger's entries go on without a gap. Nothing is appended for no rows (an empty receipt). Rows without
        a ledger are refused. An attempt that lost leaves a folder that no commit names; ``orphans`` lists them.
        """
        rows = rows.select(F.col("ledger").cast("string").alias("ledger"), "payload", F.row_number().over(Window.partitionBy("ledger").orderBy(*order)).alias("place"))
        if rows.where("ledger is null").limit(1).count():
            raise ValueError("every entry needs a ledger")
        for attempt in range(ATTEMPTS):
            last = self._last()
            number, folder = (last["number"] if last else 0) + 1, uuid.uuid4().hex
            old = self.spark.read.schema(HEADS).parquet(f"{self.path}/heads/{last['folder']}") if last else self.spark.createDataFrame([], HEADS)
            numbered = rows.join(old.select("ledger", "last"), "ledger", "left").select("ledger", (F.coalesce("last", F.lit(0)) + F.col("place")).alias("seq"), "payload")
            chained(numbered, heads=old).write.parquet(f"{self.path}/entries/{folder}")
            fresh = self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries/{folder}")
            ends = fresh.groupBy("ledger").agg(F.max_by("entry_hash", "seq").alias("head"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))
            n = ends.agg(F.sum("n")).first()[0] or 0
            if not n:
                return {}
            ends.drop("n").unionByName(old.join(ends.select("ledger"), "ledger", "left_anti")).write.parquet(f"{self.path}/heads/{folder}")
            body = {"number": number, "folder": folder, "rows": n, "before": last["signature"] if last else GENESIS}
            commit = body | {"signature": self._signed(body)}
            if self.files.create(f"commits/{number:012d}.json", json.dumps(commit).encode()):
                self.files.create(f"vouched/{number:012d}.json", json.dumps(commit).encode())
                return commit
            time.sleep(0.01 * (attempt + 1))
        raise RuntimeError(f"{ATTEMPTS} other writers were faster")

    def entries(self) -> DataFrame:
        """(ledger, seq, payload, prev_hash, entry_hash) of all commits that are there now."""
        folders = [f"{self.path}/entries/{c['folder']}" for c in self.commits()]
        return self.spark.read.schema(ENTRY).parquet(*folders) if folders else self.spark.createDataFrame([], ENTRY)

    def faults(self, receipt: dict | None = None) -> list[str]:
        """What is wrong with the log: a missing or changed commit, a lost tail, a broken chain; empty for a whole log.

        ``receipt`` is a commit that ``append`` gave and that must be there.
        """
        found, before, commits = [], GENESIS, self.commits()
        for i, c in enumerate(commits, 1):
            body = {k: c.get(k) for k in ("number", "folder", "rows", "before")}
            if c.get("number") != i or c.get("before") != before or not hmac.compare_digest(c.get("signature", ""), self._signed(body)):
                found.append(f"commit {i} isn't the one that was made")
                break
            before = c["signature"]
        vouched = [json.loads(self.files.read(f"vouched/{n}")) for n in self._names("vouched")]
        most = max([v["number"] for v in vouched] + [receipt["number"] if receipt else 0, 0])
        if len(commits) < most:
            found.append(f"commits after {len(commits)} are lost; there were {most}")
        if receipt and receipt not in commits:
            found.append("the receipt's commit isn't in the log")
        if not found and commits:
            entries = self.entries()
            if entries.count() != sum(c["rows"] for c in commits):
                found.append("entries are missing or too many")
            bad = verified(entries).where("broken_at is not null").orderBy("ledger").limit(10).collect()
            found += [f"ledger {r.ledger} is broken at {r.broken_at}" for r in bad]
        return found

    def orphans(self) -> list[str]:
        """Folders of attempts that lost or broke off; no reader sees them."""
        named = {c["folder"] for c in self.commits()}
        return [n for n in self.files.names("entries") if n not in named]
