"""A table in versions: a reader has one whole version, whatever a writer does meanwhile.

Rows of a version are written to a folder of their own and counted there. The version begins to exist with one small
file that names the folder and is created only if no other writer has its number; nothing is renamed, so at no moment
is the table missing or half there.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Files

ATTEMPTS = 50


class Refused(ValueError):
    """A write that would leave no rows, or fewer than there are."""


class Snapshots:
    """The versions of the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, path)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("versions") if n.endswith(".json")]

    def entry(self, version: int) -> dict:
        """version, folder, rows and schema of a version."""
        return json.loads(self.files.read(f"versions/{version:012d}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named; later writes don't change what was read."""
        held = self.entry(self.versions()[-1] if version is None else version)
        return self.spark.read.schema(held["schema"]).parquet(f"{self.path}/rows/{held['folder']}")

    def write(self, df: DataFrame, allow_fewer: bool = False) -> int:
        """Makes ``df`` the next version and gives its number, unless it has no rows or fewer than the newest has.

        The rows are written once. If another writer takes the number first, they are held against its version and
        offered again. What a refused write or a broken one left is listed by ``orphans``.
        """
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/rows/{folder}")
        n = self.spark.read.schema(df.schema).parquet(f"{self.path}/rows/{folder}").count()
        for attempt in range(ATTEMPTS):
            known = self.versions()
            there = self.entry(known[-1])["rows"] if known else 0
            if n == 0 or (n < there and not allow_fewer):
                self._delete(folder)
                raise Refused(f"refused to write {n} rows over {there}")
            version = (known[-1] if known else 0) + 1
            held = {"version": version, "folder": folder, "rows": n, "schema": df.schema.toDDL()}
            if self.files.create(f"versions/{version:012d}.json", json.dumps(held).encode()):
                return version
            time.sleep(0.01 * (attempt + 1))
        raise RuntimeError(f"{ATTEMPTS} other writers were faster")

    def changes(self, old: int, new: int, key: str) -> DataFrame:
        """(key, change) of the rows that were added, removed or changed between two versions; a key names one row.

        Columns that only one version has count as null in the other.
        """
        a, b = self.read(old), self.read(new)
        names = sorted({*a.columns, *b.columns} - {key})

        def packed(df: DataFrame, side: str) -> DataFrame:
            return df.select(key, F.struct(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names), F.lit(0).alias("")).alias(side))

        both = packed(a, "old").join(packed(b, "new"), key, "full")
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
        return both.select(key, change.alias("change")).where("change is not null")

    def orphans(self) -> list[str]:
        """Folders of rows that no version names: of writers still at work, or of broken ones."""
        named = {self.entry(v)["folder"] for v in self.versions()}
        return [n for n in self.files.names("rows") if n not in named]

    def expire(self, keep: int) -> list[int]:
        """Forgets all but the newest ``keep`` versions and deletes their rows; names them. Readers of these must be done."""
        gone = self.versions()[: -max(1, keep)]
        for version in gone:
            folder = self.entry(version)["folder"]
            self.files.delete(f"versions/{version:012d}.json")
            self._delete(folder)
        return gone

    def _delete(self, folder: str) -> None:
        self.files.delete(f"rows/{folder}")
