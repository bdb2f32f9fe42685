"""Redaction of recognised identifiers with keyed pseudonyms, checked again until nothing is left, and a verdict."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recognizers import applied, resolved, steps

PASSES = 3
# The tag of each type in its pseudonym; other types are tagged REDACTED.
TAGS = {
    "PH_MOBILE": "PHONE", "GCASH_MOBILE": "GCASH", "CARD_PAN": "PAN", "CARD_CVV": "CVV", "PH_SSS": "SSS", "PH_TIN": "TIN", "EMAIL": "EMAIL", "PH_IBAN": "IBAN",
    "BANK_ACCOUNT": "ACCT", "REMITTANCE_REF": "REMIT", "PASSPORT": "PASSPORT", "DRIVERS_LICENSE": "DL", "PHILSYS_ID": "PHILSYS", "DATE_OF_BIRTH": "DOB", "SALARY": "AMOUNT",
}


def hmac_sha256(value: Column, key: str) -> Column:
    """Lower-case hex of HMAC-SHA256 of a text under a key, by built-in functions."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in raw) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def pseudonym(kind: Column, raw: Column, key: str) -> Column:
    tag = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in TAGS.items() for x in pair)), kind), F.lit("REDACTED"))
    return F.concat(F.lit("["), tag, F.lit("-"), F.upper(F.substring(hmac_sha256(raw, key), 1, 4)), F.lit("]"))


def redacted(text: Column, entities: Column, key: str) -> Column:
    """``text`` with each entity replaced by its pseudonym; entities don't meet and are in order."""
    risky = F.filter(entities, lambda x: x["type"] != "PERSON")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(x["end"].alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]), pseudonym(x["type"], x["text"], key)).alias("out"))
    walked = F.aggregate(risky, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(risky) > 0, walked).otherwise(text)


REDACTION = "array<struct<type:string,start:int,end:int,length:int,replacement:string,mode:string,score:double,pass:int,out_start:int,out_end:int>>"


def redactions(before: Column, entities: Column, key: str, number: int) -> Column:
    """The redaction map after one more pass: ``before`` is the map so far, ``entities`` those that the pass replaces in its own text.

    start and end are offsets of the original text, out_start and out_end of the text after the pass; an entity that meets
    an earlier replacement reaches over all of what that stands for, and that replacement's place is then its own.
    """
    risky = F.filter(entities, lambda x: x["type"] != "PERSON")
    growth = lambda x: F.length(pseudonym(x["type"], x["text"], key)) - (x["end"] - x["start"])
    total = lambda rows, f: F.aggregate(rows, F.lit(0), lambda acc, x: acc + f(x))

    def original(at: Column, end: bool) -> Column:
        """A place of the pass's text in the original one."""
        inside = F.filter(before, lambda m: (m["out_start"] < at) & (at < m["out_end"]))
        shift = total(F.filter(before, lambda m: m["out_end"] <= at), lambda m: (m["end"] - m["start"]) - (m["out_end"] - m["out_start"]))
        return F.when(F.size(inside) > 0, F.try_element_at(inside, F.lit(1))["end" if end else "start"]).otherwise(at + shift)

    def moved(at: Column) -> Column:
        return at + total(F.filter(risky, lambda x: x["end"] <= at), growth)

    def kept(m: Column) -> Column:
        over = F.filter(risky, lambda x: (x["start"] < m["out_end"]) & (m["out_start"] < x["end"]))
        first = F.try_element_at(over, F.lit(1))
        start = F.when(F.size(over) > 0, moved(first["start"])).otherwise(moved(m["out_start"]))
        end = F.when(F.size(over) > 0, moved(first["start"]) + F.length(pseudonym(first["type"], first["text"], key))).otherwise(moved(m["out_start"]) + m["out_end"] - m["out_start"])
        return m.withField("out_start", start).withField("out_end", end)

    def fresh(x: Column) -> Column:
        token, at = pseudonym(x["type"], x["text"], key), moved(x["start"])
        return F.struct(
            x["type"].alias("type"), original(x["start"], False).alias("start"), original(x["end"], True).alias("end"), (x["end"] - x["start"]).alias("length"), token.alias("replacement"),
            F.lit("hmac-pseudonym").alias("mode"), F.round(x["score"].cast("double"), 3).alias("score"), F.lit(number).alias("pass"), at.alias("out_start"), (at + F.length(token)).alias("out_end"),
        )

    return F.when(F.size(risky) > 0, F.concat(F.transform(before, kept), F.transform(risky, fresh)).cast(REDACTION)).otherwise(before)


def notes(types: Column, n: Column, leaks: Column) -> Column:
    """What led to the verdict, in one sentence; ``types`` are the distinct ones and n the number of all finds."""
    has = lambda *kinds: F.arrays_overlap(types, F.array(*(F.lit(k) for k in kinds)))
    bundle = has("CARD_PAN") & has("CARD_CVV") & has("PH_SSS", "BANK_ACCOUNT", "PH_IBAN")
    some = F.concat(n.cast("string"), F.when(n == 1, " identifier").otherwise(" identifiers"), F.lit(" replaced, and the text read again: "), F.array_join(F.array_sort(types), ", "), F.lit("."))
    said = (
        F.when(leaks, "Identifiers are still found in the redacted text; it needs a person's review.").when(F.size(types) == 0, "No regulated identifier was found.")
        .when(bundle, "A card number stands with its CVV and an account or national number: all that a payment needs.").when(has("PH_SSS", "PH_TIN"), "A national number (SSS or TIN) is present.").otherwise(some)
    )
    return F.array(said)


def verdict(types: Column, leaks: Column) -> Column:
    """Block what leaks, a whole card and national numbers; redact other finds; else the text is safe."""
    has = lambda *kinds: F.arrays_overlap(types, F.array(*(F.lit(k) for k in kinds)))
    bundle = has("CARD_PAN") & has("CARD_CVV") & has("PH_SSS", "BANK_ACCOUNT", "PH_IBAN")
    return F.when(leaks, "BLOCK_ESCALATE").when(F.size(types) == 0, "SAFE_TO_SEND").when(bundle | has("PH_SSS", "PH_TIN"), "BLOCK_ESCALATE").otherwise("REDACT_THEN_SEND")


def scan(df: DataFrame, key: str, text_col: str = "text", passes: int = PASSES, report: bool = False) -> DataFrame:
    """``df`` with entities, redacted, residual_leakage and verdict of a text column.

    Entities are those of the original text. Each further pass reads only rows in which the one before found
    something; what the last pass still finds is redacted once more and counts as a leak. A null text is safe.
    Pseudonyms are only as secret as ``key``, which the caller must bring. With ``report`` also redaction_map (see
    ``redactions``), passes (of redaction, at least one), verified_clean and notes.
    """
    stages = [*steps("__again", "__found"), {"__left": resolved(F.col("__found"))}]
    mapped = lambda df, number: df.withColumn("redaction_map", redactions(F.col("redaction_map"), F.col("__left"), key, number)) if report else df
    df = applied(df.withColumn("__again", F.col(text_col)), stages)
    df = df.withColumns({"entities": F.col("__left"), "redacted": redacted(F.col(text_col), F.col("__left"), key)})
    if report:
        df = mapped(df.withColumns({"redaction_map": F.array().cast(REDACTION), "passes": F.lit(1)}), 1)
    once_more = redacted(F.col("redacted"), F.col("__left"), key)
    for i in range(passes):
        df = applied(df.withColumn("__again", F.when(F.size("__left") > 0, F.col("redacted"))), stages).withColumn("redacted", once_more)
        df = mapped(df, i + 2)
        if report and i + 1 < passes:
            df = df.withColumn("passes", F.col("passes") + (F.size("__left") > 0).cast("int"))
    df = df.drop("__again", "__found")
    leaks = F.size(F.filter("__left", lambda x: x["type"] != "PERSON")) > 0
    risky = F.filter("entities", lambda x: x["type"] != "PERSON")
    types = F.array_distinct(F.transform(risky, lambda x: x["type"]))
    if report:
        df = df.withColumns({"verified_clean": ~leaks, "notes": notes(types, F.size(risky), leaks)})
    return df.withColumn("residual_leakage", leaks.cast("int")).withColumn("verdict", verdict(types, leaks)).drop("__left")


def entity_rows(scanned: DataFrame, *keys: str) -> DataFrame:
    """(keys, e): a row for each entity of ``scan``."""
    # The outer form keeps a filter on the array from being pushed through, and with it spelled out in, every step of the scan.
    return scanned.select(*keys, F.explode_outer("entities").alias("e")).where("e.type IS NOT NULL")


def type_counts(scanned: DataFrame) -> DataFrame:
    """(type, n) over all rows of ``scan``."""
    return entity_rows(scanned).where("e.type <> 'PERSON'").groupBy(F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
