"""From raw documents to token ids: five stages over whole tables, each written before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontaminate, ngram_join, pii, quality
from marlstone.llm.keys import keyed
from marlstone.llm.scratch import saved, settle
from marlstone.llm.tables import table

#: Ids of at most so many rows that go are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000
#: Documents of a lower score go.
QUALITY = 0.3


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (__key, ...) without the rows whose key is in ``gone`` (id), and without the key."""
    gone = saved(gone.select(F.col("id").alias("__gone")).distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, F.col("__key") == F.col("__gone"), "left_anti").drop("__key")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, doesn't reject.

    A null text is scored as an empty one; ids may be null or repeat, as rows are judged by their texts alone;
    without labels nothing is rejected. An empty table gives an empty table.
    """
    voter = quality.train(docs, table(spark, sf_dir, "labels"), quality.crc_mod("doc_id", 5) != 0)
    return quality.with_score(docs, voter, "__score").where(F.col("__score") >= QUALITY).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id (a null one first); rows are told apart whatever their ids.

    Texts that are null or without words are near copies of nothing and stay.
    """
    docs, plain = keyed(docs, "doc_id", "__key")
    groups = saved(ngram_join.near_duplicates(docs, "__key").select(F.col("doc_id").alias("id"), F.col("component_id").alias("part")), "groups")
    if plain:
        return without(docs, groups.where("id <> part"))
    ids = docs.select(F.col("__key").alias("id"), F.struct(F.col("doc_id"), F.col("__key")).alias("rank"))
    best = groups.join(ids, "id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank")).where("n > 1")
    return without(docs, groups.join(best, "part").where(F.col("id") != F.col("rank.__key")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts stay, and with no items all documents."""
    docs, _ = keyed(docs, "doc_id", "__key")
    return without(docs, decontaminate.contaminated(docs.select(F.col("__key").alias("id"), "text"), table(spark, sf_dir, "benchmark")))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the words that disclose it generalised or removed.

    A null text stays null; equal texts come out equal, whatever their ids; n_chars follows the text.
    """
    return pii.rewritten(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids as little-endian 32-bit numbers; none for a null or empty text. Each row is encoded, whatever its id."""
    return bpe.encode(docs)


def settled(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` on executors that don't hold memory which the stages before it no longer need."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", settled(keep_quality)),
    ("n-gram Jaccard join", settled(drop_near_copies)),
    ("benchmark decontamination", settled(drop_contaminated)),
    ("PII", settled(hide_private)),
    ("byte-level BPE", settled(encode)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on ``documents``. Columns of the table must not begin with two underscores."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0])
    return docs
