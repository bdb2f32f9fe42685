"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

The index keeps, for each term that a test item uses, where the training documents have it: (term, doc, pos). It
is written once, from one look at the texts: each task stores the postings of its documents sorted by term, so that
a lookup reads the row groups of its terms only, and a hot term is spread over all segments.
A test window is looked up from its rarest terms: their lists, shifted by the term's offset in the window, are
intersected first; then the lists of its other terms, in documents that survive. A hot term is therefore joined
only where a rare one of the same window stands beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import keyed
from .scratch import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A table of at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: Ends a document's words in the index, as no word can be it; its number, below those of the terms.
MARK, COUNT = "\0", -1
#: How many of a window's rarest terms open a lookup.
OPENING = 2


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none if it is null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), ""), F.array().cast("array<string>"))


def small(df: DataFrame) -> DataFrame:
    """Hints a broadcast for a written table of few rows only."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def vocabulary(terms: DataFrame) -> DataFrame:
    """(term, term_id): a number for each of ``terms`` (term), and COUNT for the mark that closes a document."""
    marked = terms.sparkSession.range(1).select(F.lit(MARK).alias("term"), F.lit(COUNT).cast("long").alias("term_id"))  # createDataFrame would start Python workers
    return saved(terms.distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms").unionByName(marked)


def postings(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The positional index (term_id, id, pos) of ``docs`` (id, text) for the terms of a ``vocabulary``, written.

    The row of a document with the number COUNT has the count of its words as ``pos``.
    """
    every = F.concat(words(F.col("text")), F.array(F.lit(MARK)))
    rows = docs.select("id", F.posexplode(every).alias("pos", "term")).join(small(known), "term")
    return saved(rows.select("term_id", "id", "pos").sortWithinPartitions("term_id", "id", "pos"), "postings")


def windows(benchmark: DataFrame, item_col: str, text_col: str, k: int) -> DataFrame:
    """(window, w, items): distinct runs of k words of the items, shorter items whole, with their item ids."""
    w = benchmark.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.slice("w", i, k))).alias("w"))
    return w.distinct().groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("window", F.monotonically_increasing_id())


def indexed(docs: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, index): the terms of all windows (window, length, offset, term_id), and the index of ``docs`` (id, text) for them."""
    slots = tests.select("window", F.size("w").alias("length"), F.posexplode("w").alias("offset", "term"))
    known = vocabulary(slots.select("term"))
    return saved(slots.join(known, "term").drop("term"), "slots"), postings(docs, known)


def occurrences(slots: DataFrame, index: DataFrame) -> DataFrame:
    """(id, start, window, length): every place where all words of a window follow each other in a document."""
    often = saved(index.where(F.col("term_id") != COUNT).groupBy("term_id").count(), "frequency")
    # A window with a term that no document has can't occur.
    ranked = slots.join(small(often), "term_id").withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy("count", "offset")))
    ranked = saved(ranked.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("window"))).where("found = length").drop("found", "count"), "ranked")
    opening = saved(ranked.where(F.col("rank") <= OPENING).select("term_id", "window", "offset", "length"), "opening")
    lists = index.join(small(opening), "term_id").where("pos >= offset").select("id", (F.col("pos") - F.col("offset")).alias("start"), "window", "length", "offset")
    both = lists.groupBy("id", "start", "window").agg(F.count_distinct("offset").alias("n"), F.first("length").alias("length"))
    candidates = saved(both.where(F.col("n") == F.least(F.lit(OPENING), "length")).drop("n"), "candidates")
    # The lists of the other terms, in the surviving documents alone.
    rest = saved(ranked.where(F.col("rank") > OPENING).select("window", "offset", "term_id"), "rest")
    alive = saved(candidates.where(F.col("length") > OPENING).select("id").distinct(), "alive")
    held = index.join(small(alive), "id", "left_semi").join(small(saved(rest.select("term_id").distinct(), "asked")), "term_id", "left_semi")
    wanted = candidates.join(small(rest), "window").select("id", (F.col("start") + F.col("offset")).alias("pos"), "term_id", "start", "window", "length", "offset")
    met = wanted.join(held, ["id", "pos", "term_id"]).groupBy("id", "start", "window").agg(F.count_distinct("offset").alias("n"), F.first("length").alias("length"))
    met = met.where(F.col("n") == F.col("length") - OPENING).select("id", "start", "window", "length")
    return candidates.where(F.col("length") <= OPENING).select("id", "start", "window", "length").unionByName(met)


def near(docs: DataFrame, first: str, second: str, within: int) -> DataFrame:
    """(doc_id, pos, other): places of two terms at most ``within`` words apart, in either order.

    The rarer term's list is shifted by each distance and intersected with the other's: an equi-join on (id,
    pos). ``docs`` has columns id and text, a text for each id.
    """
    asked = docs.sparkSession.createDataFrame([(first,), (second,)], "term string")
    known = vocabulary(asked)
    number = {r["term"]: r["term_id"] for r in known.collect()}  # two terms and the mark
    index = postings(docs, known)
    lists = {t: index.where(F.col("term_id") == number[t]).select("id", "pos") for t in (first, second)}
    swapped = lists[first].count() > lists[second].count()
    rare, common = (lists[second], lists[first]) if swapped else (lists[first], lists[second])
    shifted = rare.select("id", F.col("pos").alias("at"), F.explode(F.sequence(F.col("pos") - within, F.col("pos") + within)).alias("pos"))
    met = shifted.where("pos <> at").join(common, ["id", "pos"])
    return met.select(F.col("id").alias("doc_id"), *(F.col(c).alias(x) for c, x in zip(("pos", "at") if swapped else ("at", "pos"), ("pos", "other"))))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>) for every row of ``docs``.

    A window is k consecutive words of an item (an item of fewer words is one window); a word that lies in
    any occurrence of a window is hit; ``items`` are the ids, as strings in order, of items with a window that
    occurs. A null or wordless text has no words and no hits, as has an item without words; a null item id is
    left out of ``items`` but its windows count; an item of one or two words has every place of its rarest word as a
    candidate; every row is judged by its own text, whatever its id. Other columns are ignored. An empty table on either side gives
    no hits.
    """
    docs, plain = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "id")
    tests = saved(windows(benchmark, item_col, item_text_col, k), "windows")
    slots, index = indexed(docs, tests)
    met = saved(occurrences(slots, index), "occurrences")
    hit = met.select("id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_hit"))
    items = met.select("id", "window").distinct().join(small(tests.select("window", "items")), "window")
    items = items.select("id", F.explode("items").alias("item")).distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    found = saved(hit.join(items, "id", "left"), "found")
    counted = index.where(F.col("term_id") == COUNT).select("id", F.col("pos").cast("long").alias("n_words"))  # a row for each document
    counted = counted.withColumn("doc_id", F.col("id")) if plain else counted.join(docs.select("id", "doc_id"), "id")
    out = counted.join(small(found), "id", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 10) -> DataFrame:
    """(id) of the documents (id, text), with a key for each row, in which a window of ``benchmark`` (item_id, text) occurs."""
    met = occurrences(*indexed(docs, saved(windows(benchmark, "item_id", "text", k), "windows")))
    return met.select("id").distinct()
