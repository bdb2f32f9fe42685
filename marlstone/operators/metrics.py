"""Quality figures as queries: precision, recall, reciprocal ranks and nearest-rank quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def precision_recall(rows: DataFrame, expected: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of two 0/1 columns, 0 where there is nothing to divide by."""
    e, p = F.col(expected) == 1, F.col(predicted) == 1
    out = rows.groupBy(*(by or [])).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def reciprocal_rank(cases: DataFrame, ranks: DataFrame) -> DataFrame:
    """n, recall_1, recall_3 and mrr over all ``cases`` (query_id); a case without a rank counts as 0."""
    first = ranks.groupBy("query_id").agg(F.min("rank").alias("rank"))
    rows = cases.join(first, "query_id", "left")
    hit = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))
    return rows.agg(F.count(F.lit(1)).alias("n"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def nearest_rank(rows: DataFrame, group: str, value: str, share: float = 0.95, ranges: int | None = None) -> DataFrame:
    """(group, n, p50, p95, mean) with the values at n // 2 and at max(0, int(share * n) - 1) of a group's sorted values.

    Equal values are counted first. The counts lie in ranges of (group, value); sums of whole ranges tell in
    which one a rank falls, and only within that range rows are numbered: no task sees all values of a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("m"))
    counts = counts.repartitionByRange(*([ranges] if ranges else []), group, value).withColumn("part", F.spark_partition_id())
    counts = written(counts, "counts")
    whole = counts.groupBy(group, "part").agg(F.sum("m").alias("s"))
    so_far = F.sum("s").over(Window.partitionBy(group).orderBy("part")) - F.col("s")
    places = whole.withColumn("before", so_far).withColumn("n", F.sum("s").over(Window.partitionBy(group)))
    places = places.select(group, "part", "before", "n", F.floor(F.col("n") / 2).alias("mid"), F.greatest(F.lit(0), F.floor(share * F.col("n")) - 1).alias("high"), "s")
    held = lambda i: (F.col("before") <= F.col(i)) & (F.col(i) < F.col("before") + F.col("s"))
    numbered = counts.join(places.where(held("mid") | held("high")), [group, "part"])
    numbered = numbered.withColumn("last", F.col("before") + F.sum("m").over(Window.partitionBy(group, "part").orderBy(value)))
    at = lambda i: F.max(F.when((F.col(i) < F.col("last")) & (F.col(i) >= F.col("last") - F.col("m")), F.col(value)))
    found = numbered.groupBy(group).agg(F.max("n").alias("n"), at("mid").alias("p50"), at("high").alias("p95"))
    mean = rows.groupBy(group).agg(F.avg(value).alias("mean"))
    return found.join(mean, group)


def span_hits(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``expected`` (key, type, value) with a flag ``hit``: a span of ``found`` (key, type, text) of that type holds the value."""
    spans = found.select(F.col(key).alias("__key"), F.col("type").alias("__type"), "text")
    rows = expected.withColumn("__row", F.xxhash64(key, "type", "value"))
    hit = rows.join(spans, (F.col(key) == F.col("__key")) & (F.col("type") == F.col("__type")) & F.contains("text", F.col("value")), "left_semi").select("__row").distinct().withColumn("hit", F.lit(True))
    return rows.join(hit, "__row", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).drop("__row")


def wrong_finds(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of ``found`` (key, type, text) of a key with expected values that neither hold nor lie in any of these."""
    values = expected.select(F.col(key).alias("__key"), "value")
    meets = (F.col(key) == F.col("__key")) & (F.contains("text", F.col("value")) | F.contains("value", F.col("text")))
    return found.join(values.select("__key").distinct(), F.col(key) == F.col("__key"), "left_semi").join(values, meets, "left_anti")


def by_type(hits: DataFrame, wrong: DataFrame) -> DataFrame:
    """(type, support, tp, fp, fn, precision, recall, f1) of ``span_hits`` and ``wrong_finds``."""
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    rows = hits.select("type", F.col("hit").cast("int").alias("tp"), (~F.col("hit")).cast("int").alias("fn"), F.lit(0).alias("fp"))
    rows = rows.unionByName(wrong.select("type", F.lit(0).alias("tp"), F.lit(0).alias("fn"), F.lit(1).alias("fp")))
    out = rows.groupBy("type").agg(one("tp").alias("tp"), one("fp").alias("fp"), one("fn").alias("fn")).withColumn("support", F.col("tp") + F.col("fn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(types: DataFrame) -> DataFrame:
    """One row: the mean f1 of the types that were expected at all, and how many they are."""
    return types.where("support > 0").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.count(F.lit(1)).alias("n_types"))


def scenario_scores(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Scores of screened scenarios with labels.

    ``rows`` has expected and found (arrays of ids), severity and expected_severity, exposed and expected_exposed
    (arrays), negative. A tier at or above the label counts, and so do exposed parties that include the labelled
    ones; negatives count where nothing at all was raised.
    """
    both, extra, missing = F.size(F.array_intersect("expected", "found")), F.size(F.array_except("found", "expected")), F.size(F.array_except("expected", "found"))
    positive = ~F.col("negative")
    share = lambda good: F.coalesce(F.avg(F.when(positive, good.cast("double"))), F.lit(0.0))
    out = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(both).cast("long").alias("tp"), F.sum(extra).cast("long").alias("fp"), F.sum(missing).cast("long").alias("fn"),
        share(F.col("severity") >= F.col("expected_severity")).alias("tier_accuracy"), share(F.size(F.array_except("expected_exposed", "exposed")) == 0).alias("exposure_accuracy"),
        F.coalesce(F.avg(F.when(F.col("negative"), (F.size("found") > 0).cast("double"))), F.lit(0.0)).alias("false_positive_rate"),
    )
    return out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
