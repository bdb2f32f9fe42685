"""Spans of pattern matches as columns: arrays of structs with 0-based code point offsets, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"


def finditer(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches; Spark has no offsets, so they are rebuilt from the parts between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    step = lambda acc, x: F.struct(
        (acc["pos"] + F.length(x["b"]) + F.length(x["m"])).alias("pos"),
        F.concat(acc["out"], F.array(F.struct((acc["pos"] + F.length(x["b"])).alias("start"), (acc["pos"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), x["m"].alias("text")))).alias("out"),
    )
    first = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))
    walked = F.aggregate(F.arrays_zip(between.alias("b"), found.alias("m")), first, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(SPAN))  # one look for the many texts without a match


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def unclaimed(spans: Column, claimed: Column) -> Column:
    """Spans that meet none of the claimed ones."""
    return F.filter(spans, lambda x: ~F.exists(claimed, lambda c: overlaps(x, c)))


def around(text: Column, span: Column, pad: int) -> Column:
    """The text from ``pad`` code points before a span to as many after it."""
    left = F.greatest(span["start"] - pad, F.lit(0))
    return F.substring(text, left + 1, span["end"] + pad - left)


def tail_group(span: Column, pattern: str) -> Column:
    """The span of group 1 of a pattern that ends with it."""
    group = F.regexp_extract(span["text"], pattern, 1)
    return F.struct((span["end"] - F.length(group)).alias("start"), span["end"].alias("end"), group.alias("text"))


def merged(spans: Column) -> Column:
    """Sorted by (start, longest, best score); of spans that meet the last one kept, the longer stays.

    A longer span that starts later takes the place of the shorter one, whose left part is then free again;
    the better score and the reasons of both stay.
    """
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).otherwise(F.signum(b["score"] - a["score"])).cast("int")

    def put(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        both = lambda y: y.withField("score", F.greatest(last["score"], x["score"])).withField("reasons", F.array_sort(F.array_union(last["reasons"], x["reasons"])))
        kept = F.when(x["end"] - x["start"] > last["end"] - last["start"], both(x)).otherwise(both(last))
        meets = (F.size(acc) > 0) & (x["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(kept))).otherwise(F.concat(acc, F.array(x)))

    return F.when(F.size(spans) > 1, F.aggregate(F.array_sort(spans, order), F.slice(spans, 1, 0), put)).otherwise(spans)
