"""One text for one value, however deep: keys in order at every level, no blanks, the same on every machine.

The text is the one that JSON with sorted keys has: numbers with a point print as the shortest digits that read back
(1e-07, 1e+16), strings keep letters beyond ASCII, dates, times and decimals are strings.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: Characters with a short escape; other control characters have one of four hexadecimal digits.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
WHOLE = (t.ByteType, t.ShortType, t.IntegerType, t.LongType)


def _names(kind: t.StructType) -> list[str]:
    if len(set(kind.names)) < len(kind.names):
        raise ValueError(f"fields of one name: {kind.names}")
    return sorted(kind.names)


def built_in(kind: t.DataType) -> bool:
    """Whether Spark's own functions can write values of a type; they print floating numbers otherwise than JSON does."""
    if isinstance(kind, t.StructType):
        return all(built_in(f.dataType) for f in kind)
    if isinstance(kind, t.ArrayType):
        return built_in(kind.elementType)
    if isinstance(kind, t.MapType):
        return isinstance(kind.keyType, t.StringType) and built_in(kind.valueType)
    return isinstance(kind, (*WHOLE, t.StringType, t.BooleanType, t.DateType, t.TimestampNTZType, t.DecimalType, t.NullType))


def quoted(x: Column) -> Column:
    """A string as JSON writes it."""
    escaped = x
    for c, to in SHORT.items():
        escaped = F.replace(escaped, F.lit(c), F.lit(to))
    rare = escaped
    for n in range(32):
        if chr(n) not in SHORT:
            rare = F.replace(rare, F.lit(chr(n)), F.lit(f"\\u{n:04x}"))
    escaped = F.when(x.rlike(r'["\\\x00-\x1f]'), F.when(x.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(escaped)).otherwise(x)
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _text(x: Column, kind: t.DataType) -> Column:
    if isinstance(kind, t.StructType):
        parts = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), _text(x[n], kind[n].dataType)) for n in _names(kind)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, t.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: _text(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, t.MapType):
        entries = F.array_sort(F.map_keys(x))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda k: F.concat(quoted(k), F.lit(":"), _text(x[k], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, t.StringType):
        out = quoted(x)
    elif isinstance(kind, t.TimestampNTZType):
        part = F.date_format(x, ".SSSSSS")
        out = F.concat(F.lit('"'), F.date_format(x, "yyyy-MM-dd HH:mm:ss"), F.when(part != ".000000", part).otherwise(""), F.lit('"'))
    elif isinstance(kind, (t.DateType, t.DecimalType)):
        out = F.concat(F.lit('"'), x.cast("string"), F.lit('"'))
    else:
        out = x.cast("string")
    return F.when(x.isNull(), F.lit("null")).otherwise(out)


def plain(x: Any) -> Any:
    """A value of a row as dictionaries, lists and scalars."""
    if isinstance(x, t.Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return plain(x.toPython()) if isinstance(x, t.VariantVal) else x


def dumped(x: Any) -> str:
    return json.dumps(plain(x), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def text(x: Column, kind: t.DataType) -> Column:
    """The canonical text of a column of a type; a null is the text null.

    Types with floating numbers, variants, binary values, zoned times or keys that aren't strings go through Python in
    Arrow batches, all others stay in Spark's expressions. Maps count as sets of entries; fields of one name are refused.
    """
    return _text(x, kind) if built_in(kind) else F.udf(dumped, "string", useArrow=True)(x)


def digest(x: Column, kind: t.DataType) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(text(x, kind), 256)
