"""Recognised identifiers together with spans that another model found, as a table of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.spans import overlaps

SPAN = "struct<start:int,end:int,type:string,score:double,reasons:array<string>,stage:string>"
#: What an agreeing span of higher confidence lends to the one it agrees with.
LENT = 0.9


def confidence(score: Column, validated: Column, boost: Column) -> Column:
    """Fixed weights of validation, score and context; half goes to the even digit."""
    return F.bround(F.least(0.45 * F.when(validated, 1.0).otherwise(0.6) + 0.35 * score + 0.20 * boost, F.lit(0.99)), 3)


def together(recognised: DataFrame, outside: DataFrame) -> DataFrame:
    """(id, start, end, type, score, reasons, stage): both kinds of spans of each text, a row for each that is kept.

    ``recognised`` has id and entities as ``guard.scan`` or ``recognizers.detect`` leave them (start, end, type, score,
    reasons); ``outside`` is (id, n, start, end, type, score, validated, boost), with n the order in which a text's spans
    are taken. An outside span that meets none taken before is added. One that meets some isn't: each of those notes that
    it agrees, and is raised to LENT of its confidence if that is higher than its own. A null score or boost counts as 0,
    a null validation as none; spans of no length or without a text's id are left out.

    The two tables are merged by a sweep over starts: spans that reach each other, directly or through others, form a
    cluster, and clusters are judged apart, so that a text with very many spans is never gathered.
    """
    # The outer form keeps a filter on the array from being pushed through the steps that recognition takes.
    taken = recognised.select("id", F.explode_outer("entities").alias("e")).where("e.start is not null").select(
        "id", F.lit(0).alias("side"), F.lit(0).cast("long").alias("n"), F.struct("e.start", "e.end", "e.type", F.col("e.score").cast("double").alias("score"), F.col("e.reasons").cast("array<string>").alias("reasons"), F.lit("recognised").alias("stage")).cast(SPAN).alias("s")
    )
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sure = confidence(zero("score"), F.coalesce("validated", F.lit(False)), zero("boost"))
    more = outside.where("id is not null and `end` > start").select(
        "id", F.lit(1).alias("side"), F.col("n").cast("long").alias("n"), F.struct("start", "end", "type", sure.alias("score"), F.array().cast("array<string>").alias("reasons"), F.lit("outside").alias("stage")).cast(SPAN).alias("s")
    )
    rows = taken.unionByName(more)
    sweep = Window.partitionBy("id").orderBy("s.start", "s.end", "side", "n")
    reached = F.max("s.end").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", (reached.isNull() | (F.col("s.start") >= reached)).cast("int")).withColumn("cluster", F.sum("fresh").over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = rows.groupBy("id", "cluster").agg(F.array_sort(F.collect_list(F.struct("side", "n", "s"))).alias("all"))
    spans = lambda side: F.transform(F.filter("all", lambda x: x["side"] == side), lambda x: x["s"])

    def agreed(m: Column, x: Column) -> Column:
        raised = m.withField("score", F.when(x["score"] > m["score"], F.greatest(m["score"], LENT * x["score"])).otherwise(m["score"]))
        return F.when(overlaps(m, x), raised.withField("reasons", F.concat(m["reasons"], F.array(F.lit("outside agrees"))))).otherwise(m)

    def take(done: Column, x: Column) -> Column:
        return F.when(F.exists(done, lambda m: overlaps(m, x)), F.transform(done, lambda m: agreed(m, x))).otherwise(F.concat(done, F.array(x)))

    held = held.select("id", F.explode(F.aggregate(spans(1), spans(0).cast(f"array<{SPAN}>"), take)).alias("s"))
    return held.select("id", "s.*")
