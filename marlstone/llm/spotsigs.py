"""Fingerprints by spot signatures: chains of content words that follow common words, compared as sets.

Every occurrence of a common word (an anchor) with the next CHAIN words that are not common is a spot signature. Layout and
boilerplate have few common words, so that the set of signatures follows a text's prose. Lists and codes have hardly any:
where GAP words in a row are not common, the next such word is an anchor too. A text in which no chain ends has one
signature, all its words; a text without words has none. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import keyed
from .scratch import saved

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als "
    "de la le et les des en un du une que pour est par qui dans avec sur pas au "
    "de la que el en y los se del las un por con no su una para es al lo"
).split()
#: Content words in a chain.
CHAIN = 2
#: Words without an anchor after which a word that isn't common becomes one.
GAP = 5
#: Hexadecimal digits of a signature's MD5 that stand for it.
DIGITS = 16
#: Near copies have at least this likeness.
NEAR = 0.75
#: Ranges of ids for each shuffle partition, so that their hashes fill all partitions.
RANGES = 4
#: Bounds of ranges that are looked at one by one; the others are skipped over by every so many.
STRIDE = 64
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_signatures(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """``docs`` with the sorted set ``name`` of the signatures of ``text``; a null text has none.

    Projections one after the other: words, places of content words, signatures, their set. Each is used more than once
    by the next, so that the optimizer doesn't move it into a lambda or a branch. Write the result before filtering by
    ``name``: a filter is moved below the projections with all of them spelled out in it.
    """
    w, at, full = f"__w_{name}", f"__at_{name}", f"__full_{name}"
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = docs.withColumn(w, F.filter(F.split(lower, _NOT_WORD), lambda x: x != ""))
    docs = docs.withColumn(at, F.array_compact(F.transform(w, lambda x, i: F.when(~x.isin(ANCHORS), i + 1))))
    words, places = F.col(w), F.col(at)
    none = F.array().cast("array<string>")

    def of_gap(k: Column) -> Column:
        """Signatures of the anchors between content words k - 1 and k, and of content word k - 1 if no common word is near before it.

        Words are taken one by one: a slice inside a lambda would copy the whole text each time.
        """
        here, before = F.element_at(places, k), F.when(k > 1, F.element_at(places, k - 1)).otherwise(0)
        before = before - F.when(k > GAP + 1, F.when(F.element_at(places, k - 1 - GAP) == before - GAP, 1).otherwise(0)).otherwise(0)
        chain = [F.element_at(words, F.element_at(places, k + j)) for j in range(CHAIN)]
        of_anchor = lambda i: F.substring(F.md5(F.concat_ws(":", F.element_at(words, i), *chain)), 1, DIGITS)
        return F.when(here - before > 1, F.transform(F.sequence(before + 1, here - 1), of_anchor)).otherwise(none)

    gaps = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(places) - (CHAIN - 1), F.lit(1))), of_gap))
    docs = docs.withColumn(full, F.when(F.size(places) >= CHAIN, F.array_distinct(gaps)).otherwise(none))
    whole = F.array(F.substring(F.md5(F.concat_ws(" ", words)), 1, DIGITS))
    found = F.when(F.size(full) > 0, F.sort_array(full)).when(F.size(words) > 0, whole).otherwise(none)
    return docs.withColumn(name, found).drop(w, at, full)


def fingerprint(signatures: Column | str) -> Column:
    return F.array_join(signatures, ",")


def likeness(a: Column | str, b: Column | str) -> Column:
    """Jaccard of two sets; two empty sets are alike."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


def _ranged(docs: DataFrame) -> DataFrame:
    """``docs`` (key, ...) dealt out by ranges of the key and sorted in them, with __range and __guest.

    The first row of each range is also the last of the range before it, as a guest; the first of all follows the last.
    Bounds of ranges are quantiles of the keys: RANGES numbers for each shuffle partition reach the driver, and the first key of each.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = RANGES * n
    bounds = sorted(set(docs.agg(F.percentile_approx("key", [i / steps for i in range(1, steps)], 100 * steps)).first()[0] or []))
    some = F.array(*(F.lit(x).cast("long") for x in bounds)) if bounds else F.array().cast("array<bigint>")
    coarse = F.array(*(F.lit(x).cast("long") for x in bounds[STRIDE - 1 :: STRIDE])) if len(bounds) >= STRIDE else F.array().cast("array<bigint>")
    blocks = F.size(F.filter(coarse, lambda x: x <= F.col("key")))
    docs = docs.withColumn("__block", blocks).withColumn("__range", F.col("__block") * STRIDE + F.size(F.filter(F.slice(some, F.col("__block") * STRIDE + 1, F.lit(STRIDE)), lambda x: x <= F.col("key")))).drop("__block")
    firsts = sorted((r["__range"], r["first"]) for r in docs.groupBy("__range").agg(F.min("key").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    spark = docs.sparkSession
    host = F.broadcast(spark.createDataFrame(list(before.items()), "__first long, __host int"))
    guests = docs.join(host, F.col("key") == F.col("__first")).withColumn("__range", F.col("__host")).drop("__first", "__host")
    return docs.withColumn("__guest", F.lit(False)).unionByName(guests.withColumn("__guest", F.lit(True))).repartition(n, "__range").sortWithinPartitions("__range", "__guest", "key")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, signatures, next_text, next_signatures): every row with the next one by id; after the last comes the first.

    Texts are shuffled once, by ranges of ids. Rows with a null or repeated id come first, in the order in which they
    are written once.
    """
    docs, _ = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", "key")
    docs = with_signatures(_ranged(docs), F.col("text"), "signatures")
    each = Window.partitionBy("__range").orderBy("__guest", "key")
    following = F.lead(F.struct("text", "signatures")).over(each)
    return docs.withColumn("__next", following).where(~F.col("__guest")).select("doc_id", "text", "signatures", F.col("__next.text").alias("next_text"), F.col("__next.signatures").alias("next_signatures"))


def with_edited(docs: DataFrame) -> DataFrame:
    """``with_next`` rows with ``edited`` and its signatures: the last quarter of the characters gives way to as many first ones of the next text."""
    size = F.length("text")
    n = F.floor(size / 4).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), size - n), F.substring(F.col("next_text"), F.lit(1), n)))
    return with_signatures(docs, F.col("edited"), "edited_signatures")


def classes(size: Column, near: float = NEAR) -> Column:
    """Class of a set's length: sets whose lengths differ by less than the likeness allows are in one class or in adjacent ones."""
    return F.floor(F.log(size) / F.log(F.lit(1 / near)) + 1e-9).cast("int")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, set_id) and pairs (a, b, likeness) of the sets with a likeness of ``near`` or more, a < b.

    Rows with one set of signatures are one set, named by the smallest id; rows without words are in none, and null ids
    take no part. Sets meet where one of their rarest signatures is the same, in their own length class or the one
    below; lengths, then positions of the shared signature, rule pairs out before sets are compared.
    """
    rows = with_signatures(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull()), F.col("text"), "s")
    # Written before it is filtered: a filter would be moved below the projections and work the signatures out in lambdas.
    rows = saved(rows.select("doc_id", F.sha2(fingerprint("s"), 256).alias("name"), "s"), "spots").where(F.size("s") > 0)
    firsts = rows.groupBy("name").agg(F.min("doc_id").alias("set_id"))
    member = rows.select("doc_id", "name").join(firsts, "name").select("doc_id", "set_id")
    sets = saved(rows.join(firsts.select(F.col("set_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "s"), "sets")
    spots = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("g"))
    rank = Window.partitionBy("id").orderBy("df", "g")
    spots = spots.join(spots.groupBy("g").agg(F.count(F.lit(1)).alias("df")), "g").withColumn("k", F.row_number().over(rank))
    # The k-th rarest can only be the first shared one of a pair if enough signatures are left.
    rare = saved(spots.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * near) + 1).select("id", "n", "g", "k", classes(F.col("n"), near).alias("c")), "rare")
    own = rare.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("k").alias("kx"), "g", F.explode(F.array("c", F.col("c") - 1)).alias("c"))
    other = rare.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("k").alias("ky"), "g", "c")
    order = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y")))
    least = F.ceil((F.col("nx") + F.col("ny")) * near / (1 + near))
    left = 1 + F.least(F.col("nx") - F.col("kx"), F.col("ny") - F.col("ky"))
    met = own.join(other, ["g", "c"]).where(order & (F.col("ny") >= near * F.col("nx")) & (left >= least)).select("x", "y").distinct()
    sx, sy = sets.select(F.col("id").alias("x"), F.col("s").alias("sx")), sets.select(F.col("id").alias("y"), F.col("s").alias("sy"))
    pairs = met.join(sx, "x").join(sy, "y").withColumn("likeness", likeness("sx", "sy")).where(F.col("likeness") >= near)
    return member, pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")
