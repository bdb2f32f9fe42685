"""Screening of narratives against the catalogue of typologies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.window import Window

from ..functions.text import collapsed, excerpt
from ..sources.scratch import written
from . import impact, retrieval
from .rules import RULES

SEVERITY = {"critical": 5, "high": 4, "medium": 3, "low": 2, "none": 1}
FLAG = "array<struct<severity:int,id:string,tier:string,exposure:array<string>,doc_id:string,anchor:string,regulator:string,evidence:string>>"


@F.arrow_udf(ArrayType(StructType().add("rule", IntegerType()).add("evidence", StringType())))
def tripped(text: pa.Array) -> pa.Array:
    """Of each text the rules that it trips, by number, and the leftmost match of the first pattern of each that matches.

    A block of texts meets the patterns in Arrow, whose expressions take time in proportion to a text, however many patterns
    a rule has: one look for each rule, and its patterns one by one only on the texts that it hits.
    """
    rows, rules, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [pa.array([], pa.string())]
    for number, rule in enumerate(RULES):
        left = np.flatnonzero(pc.match_substring_regex(text, "|".join(f"(?:{p})" for p in rule[5]), ignore_case=True).fill_null(False).to_numpy(zero_copy_only=False))
        for p in rule[5]:
            said = pc.struct_field(pc.extract_regex(text.take(pa.array(left)), f"(?i)(?P<e>{p})"), "e")
            hit = pc.greater(pc.binary_length(said), 0).fill_null(False)
            at = hit.to_numpy(zero_copy_only=False)
            rows, rules, found, left = [*rows, left[at]], [*rules, np.full(at.sum(), number, np.int32)], [*found, said.filter(hit).cast(pa.string())], left[~at]
            if not len(left):
                break
    at = np.concatenate(rows)
    order = np.argsort(at, kind="stable")
    parts = pa.StructArray.from_arrays([pa.array(np.concatenate(rules)[order]), pa.concat_arrays(found).take(pa.array(order))], names=["rule", "evidence"])
    ends = np.cumsum(np.bincount(at, minlength=len(text))) if len(text) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), parts)


def flags(text: Column) -> Column:
    """All typologies that a text trips, most severe first, then by falling id; none for a null or blank text."""
    def one(rule) -> Column:
        name, tier, exposure, (doc, anchor), regulator, _ = rule
        parts = F.array(*(F.lit(x) for x in (("bank", "customer") if exposure == ("both",) else exposure)))
        return F.struct(F.lit(SEVERITY[tier]).alias("severity"), F.lit(name).alias("id"), F.lit(tier).alias("tier"), parts.alias("exposure"), F.lit(doc).alias("doc_id"), F.lit(anchor).alias("anchor"), F.lit(regulator).alias("regulator"))

    known = F.array(*(one(r) for r in RULES))
    hits = F.transform(tripped(text), lambda x: F.get(known, x["rule"]).withField("evidence", F.trim(x["evidence"])))
    return F.when(F.trim(text) != "", F.sort_array(hits, asc=False)).otherwise(F.array().cast(FLAG))


def assess(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with flags, tier, exposed (sorted) and n_flags of a text column."""
    df = df.withColumn("flags", F.coalesce(flags(F.col(text_col)), F.array().cast(FLAG)))
    tier = F.coalesce(F.try_element_at("flags", F.lit(1))["tier"], F.lit("none"))
    exposed = F.array_sort(F.array_distinct(F.flatten(F.transform("flags", lambda x: x["exposure"]))))
    return df.withColumn("tier", tier).withColumn("exposed", exposed).withColumn("n_flags", F.size("flags").cast("long"))


def _wanted(spark: SparkSession) -> DataFrame:
    """(doc_id, anchor) that rules name."""
    return spark.createDataFrame(sorted({r[3] for r in RULES if r[3][0] != "GAP"}), "doc_id string, anchor string")


def _anchored(chunks: DataFrame) -> DataFrame:
    """Every row of ``chunks`` with each anchor of its document, and whether it holds it; white space collapses once for a text."""
    low = chunks.withColumn("text", collapsed(F.lower("text")))
    return low.join(F.broadcast(_wanted(chunks.sparkSession)), "doc_id").withColumn("exact", F.contains("text", F.col("anchor"))).drop("text")


def _passages(chunks: DataFrame) -> DataFrame:
    """(doc_id, anchor, chunk_id, exact): the passage for each anchor that rules name, as ``cited`` has it."""
    first = Window.partitionBy("doc_id", "anchor").orderBy(F.desc("exact"), "rank", "chunk_id")
    return _anchored(chunks).withColumn("n", F.row_number().over(first)).where("n = 1").select("doc_id", "anchor", "chunk_id", "exact")


def cited(assessed: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """(id, flag, doc_id, chunk_id, exact, degraded): the passage that each flag's rule can be read in.

    The first passage of the flag's document that holds its anchor, else the document's best ranked passage as
    an approximate one, else none. A rule without a document, or with none found, degrades the assessment.
    ``chunks`` has chunk_id, doc_id, text and rank. Few rules name few documents, so the anchors are resolved
    once for each rule and not for each row.
    """
    rows = assessed.select(F.col(id_col).alias("id"), F.explode("flags").alias("f")).select("id", F.col("f.id").alias("flag"), F.col("f.doc_id").alias("doc_id"), F.col("f.anchor").alias("anchor"))
    out = rows.join(F.broadcast(_passages(chunks)), ["doc_id", "anchor"], "left")
    return out.select("id", "flag", "doc_id", "chunk_id", F.coalesce("exact", F.lit(False)).alias("exact"), F.col("chunk_id").isNull().alias("degraded"))


#: Hits of an anchor's search that a citation may be taken from, characters of a quote, and those around an anchor that lies beyond.
HITS, QUOTE, PAD = 20, 600, 300


def citations(assessed: DataFrame, chunks: DataFrame, id_col: str, hits: int = HITS) -> DataFrame:
    """(id, flag, doc_id, anchor, chunk_id, exact, degraded, score, quote, excerpt): each flag's passage, found by a search for its anchor.

    Of the ``hits`` best passages of all ``chunks`` (number long and unique, chunk_id, doc_id, text) for the anchor's words,
    those of the flag's document count: the best that holds the anchor, else the best as an approximate one. If none of
    them is of that document, nothing is quoted and the flag is degraded. The quote is the passage's first QUOTE
    characters, or, where the anchor lies beyond them, as many around it; the excerpt is cut closer. All anchors of the
    catalogue are asked at once; they are few, and so are the passages found, which go to every row.
    """
    spark = assessed.sparkSession
    rows = assessed.select(F.col(id_col).alias("id"), F.explode("flags").alias("f")).select("id", F.col("f.id").alias("flag"), F.col("f.doc_id").alias("doc_id"), F.col("f.anchor").alias("anchor"))
    named = sorted({r[3] for r in RULES if r[3][0] != "GAP"})
    wanted = spark.createDataFrame([(i, *x) for i, x in enumerate(named)], "query_id long, doc_id string, anchor string")
    found = impact.best(impact.index(chunks, "number", "text"), retrieval.query_terms(wanted, "query_id", "anchor", stemmed=False), hits)
    held = chunks.select("number", "chunk_id", "doc_id", collapsed(F.col("text")).alias("text"))
    held = held.join(F.broadcast(found.select("query_id", F.col("id").alias("number"), "rank", F.round("score", 4).alias("score"))), "number").join(F.broadcast(wanted), ["query_id", "doc_id"])
    held = held.withColumn("exact", F.contains(F.lower("text"), collapsed(F.lower("anchor"))))
    best = held.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "rank"))).where("n = 1")
    beyond = F.col("exact") & ~F.contains(F.lower(F.substring("text", 1, QUOTE)), collapsed(F.lower("anchor")))
    best = best.withColumn("text", F.when(beyond, excerpt(F.col("text"), F.col("anchor"), PAD)).otherwise(F.col("text")))
    best = written(best.select("doc_id", "anchor", "chunk_id", "exact", "score", F.substring("text", 1, QUOTE).alias("quote"), excerpt(F.col("text"), F.col("anchor")).alias("excerpt")), "cited")
    out = rows.join(F.broadcast(best), ["doc_id", "anchor"], "left")
    return out.select("id", "flag", "doc_id", "anchor", "chunk_id", F.coalesce("exact", F.lit(False)).alias("exact"), F.col("chunk_id").isNull().alias("degraded"), "score", "quote", "excerpt")


#: What a flag of each tier asks for.
ACTIONS = {"critical": "Stop and escalate at once.", "high": "Hold for review by compliance.", "medium": "Record and watch.", "low": "Record."}
NO_ACTION = "Continue normal monitoring."


def summary(tier: Column, n: Column, evidence: Column, exposed: Column) -> Column:
    """One sentence or three on an assessment; ``exposed`` are the sorted parties."""
    who = F.when(F.size(exposed) == 0, "the bank").when(F.size(exposed) == 1, F.concat(F.lit("the "), exposed[0])).otherwise(F.array_join(exposed, " and "))
    some = F.concat(F.upper(tier), F.lit(" risk. "), n.cast("string"), F.when(n == 1, " indicator matched").otherwise(" indicators matched"), F.lit('; the strongest on the words "'), evidence, F.lit('". Exposed: '), who, F.lit("."))
    return F.when(n == 0, "No indicator matched; that is not a clearance.").otherwise(some)


def reports(assessed: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """(id, tier, n_flags, n_citations, n_gaps, degraded, actions, summary) of rows of ``assess``.

    Actions are those of the flags in their order, each once. A flag whose rule has no document is a gap; a gap
    or a flag without a passage degrades the report. Without ``chunks`` all flags are without a passage.
    """
    gaps = [r[0] for r in RULES if r[3][0] == "GAP"]
    found = _passages(chunks).agg(F.collect_set(F.struct("doc_id", "anchor")).alias("__found"))  # one row, of as many anchors as rules name
    rows = assessed.join(F.broadcast(found))
    held = F.filter("flags", lambda f: F.array_contains("__found", F.struct(f["doc_id"], f["anchor"])))
    number = lambda c: F.size(c).cast("long")
    said = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    actions = F.array_distinct(F.transform("flags", lambda f: F.element_at(said, f["tier"])))
    return rows.select(
        F.col(id_col).alias("id"), "tier", "n_flags", number(held).alias("n_citations"), number(F.filter("flags", lambda f: f["id"].isin(gaps))).alias("n_gaps"), (F.size(held) < F.size("flags")).alias("degraded"),
        F.when(F.size("flags") == 0, F.array(F.lit(NO_ACTION))).otherwise(actions).alias("actions"),
        summary(F.col("tier"), F.col("n_flags"), F.try_element_at("flags", F.lit(1))["evidence"], F.col("exposed")).alias("summary"),
    )


def missing_anchors(chunks: DataFrame) -> DataFrame:
    """(doc_id, anchor) that rules name and no passage of ``chunks`` (doc_id, text) of that document holds."""
    held = _anchored(chunks.select("doc_id", "text")).where("exact").select("doc_id", "anchor").distinct()
    return _wanted(chunks.sparkSession).join(held, ["doc_id", "anchor"], "left_anti")


def catalogue(spark: SparkSession) -> DataFrame:
    """The rules without their patterns."""
    rows = [(r[0], r[1], list(r[2]), r[3][0], r[3][1], r[3][0] == "GAP", r[4], len(r[5])) for r in RULES]
    return spark.createDataFrame(rows, "id string, tier string, exposure array<string>, doc_id string, anchor string, is_gap boolean, regulator string, n_patterns int")
