"""Scans and guarded sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import html_lines

CHUNK = "chunk_id string, text string, doc_id string, doc_title string, issuer string, section string, effective_date string, url string, doc_type string, authority_tier int, sha256 string, char_len int, ordinal int, tags array<string>"
LEDGER = "seq bigint, ts string, event string, summary string, prev_hash string, entry_hash string"
MOST_CHARS = 20_000
#: Characters that a text written by hand needs to be taken for a document.
AUTHORED_CHARS = 4000


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file by a given schema; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_log(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """Rows of a log; lines that aren't JSON of the schema's shape are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text, sha256, n_bytes) of raw files: each tag of markup becomes a line end, PDF pages need another reader.

    Tags go from every text, whatever its kind, as a page may lack the head that shows what it is. Bytes that aren't UTF-8 become replacement characters; a PDF has a null text. The scan
    leaves empty files out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    head = F.make_valid_utf8(F.substring("content", 1, 5).cast("string"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    kind = F.when(head == "%PDF-", "pdf").when(F.lower(F.substring(text, 1, 2000)).rlike(r"<(!doctype|html)"), "html").otherwise("text")
    return raw.select("path", kind.alias("kind"), F.when(kind != "pdf", html_lines(text)).alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def admitted(rows: DataFrame, text_col: str = "text", most: int = MOST_CHARS, blank: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with a text of 1 to ``most`` characters, the others with a reason); without ``blank`` also texts of white space alone are refused."""
    n = F.length(text_col)
    reason = F.when(n.isNull(), "missing").when(n == 0, "empty").when(n > most, "too long")
    if not blank:
        reason = reason.when(F.col(text_col).rlike(r"\A\s*\z"), "blank")
    judged = rows.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def gate(text: Column, is_page: Column, tokens: Column) -> Column:
    """Why a fetched text isn't the document asked for, or null: too short, an index page, or not naming what it must (``tokens``, in lower case)."""
    low = F.lower(text)
    listed = (F.length(low) - F.length(F.replace(low, F.lit("advisory no."), F.lit("")))) / len("advisory no.")
    named = F.forall(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.contains(low, t))
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 2000, "too little text").when(is_page & (listed >= 8), "index page").when(~named, "another document")


def adopted(copies: DataFrame, key: str, kind: str = "kind", size: str = "n_chars", authored: str | None = None) -> DataFrame:
    """Of each key's copies the one to use: a PDF, else a page, else plain text; authored ones need AUTHORED_CHARS, other kinds are none."""
    place = F.when(F.col(kind) == "pdf", 1).when(F.col(kind) == "html", 2).when(F.col(kind) == "md", 3)
    good = place.isNotNull() & ((F.col(size) >= AUTHORED_CHARS) | ~F.col(authored) if authored else F.lit(True))
    order = Window.partitionBy(key).orderBy(place, F.desc(size), *(c for c in copies.columns if c not in (key, kind, size)))
    return copies.where(good).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def upsert(new: DataFrame, old: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """``new`` with the columns ``keep`` taken from ``old`` where ``new`` has none."""
    before = old.select(key, *(F.col(c).alias(f"__old_{c}") for c in keep))
    out = new.join(before, key, "left")
    return out.select(*(F.coalesce(c, f"__old_{c}").alias(c) if c in keep else F.col(c) for c in new.columns))


def missing_blocks(spark: SparkSession, total: int, block: int, present: DataFrame) -> DataFrame:
    """(start, end) of the fixed blocks of [0, total) that ``present`` (start and, if known, content) lacks; a block of zeros alone is missing."""
    if "content" in present.columns:
        present = present.where(~F.hex("content").rlike("^(?:00)*$"))
    want = spark.range(0, total, block).select(F.col("id").alias("start"), F.least(F.col("id") + block, F.lit(total)).alias("end"))
    return want.join(present.select("start"), "start", "left_anti")


def write_guarded(df: DataFrame, path: str, allow_fewer: bool = False) -> int:
    """Writes Parquet to ``path`` unless that would leave no rows, or fewer than are there; gives the count.

    The rows are written beside the target first and counted there. The target is then renamed aside and the
    fresh folder takes its place; a call after a break between the two finds the old rows aside and puts them back.
    """
    spark = df.sparkSession
    beside, aside = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    target, fresh, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, aside))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)
    df.write.mode("overwrite").parquet(beside)
    n = spark.read.parquet(beside).count()
    there = spark.read.parquet(path).count() if fs.exists(target) else 0
    if n == 0 or (n < there and not allow_fewer):
        fs.delete(fresh, True)
        raise ValueError(f"refused to write {n} rows over {there}")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)
    return n
