"""Canonical texts against Python's JSON, and versions of a table under contention."""

import datetime
import hashlib
import json
import random
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marlstone.operators import canonical
from marlstone.sources.snapshots import Refused, Snapshots

WHOLE = "b struct<z:int,a:array<struct<y:string,x:boolean>>>, `a \"q\"` map<string,array<string>>, d date, t timestamp_ntz, m decimal(9,2), s string"
TEXTS = ['plain "quoted" \\ back', "é😀 \x7f", "".join(map(chr, range(33))), "", None]


def want(row):
    return json.dumps(canonical.plain(row), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def test_spark_text_is_json_with_sorted_keys(spark):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    rows = [((i, [(s, True), None, (None, None)]), {"b": [s, None], "a": None, "é": [], "Z\n": ["x"]}, datetime.date(2024, 2, 29), at + datetime.timedelta(microseconds=120 * i), Decimal("1.50"), s) for i, s in enumerate(TEXTS)]
    rows += [(None,) * 6, ((1, []), {}, None, None, Decimal("-0.05"), "x")]
    df = spark.createDataFrame(rows, WHOLE).select(F.struct("*").alias("v"))
    assert canonical.built_in(df.schema["v"].dataType)
    got = df.select("v", canonical.text(F.col("v"), df.schema["v"].dataType).alias("x"), canonical.digest(F.col("v"), df.schema["v"].dataType).alias("h")).collect()
    for r in got:
        assert r.x == want(r.v) and r.h == hashlib.sha256(want(r.v).encode()).hexdigest()


def test_floating_numbers_and_variants(spark):
    g = random.Random(3)
    numbers = [1e-7, 1e16, 1e22, 123456789.0, 1e-4, 0.00012345, -0.0, 2**-44, 2e23, 5e-324, 0.1, float("inf"), float("nan"), None] + [g.uniform(-1, 1) * 10 ** g.randint(-20, 20) for _ in range(300)]
    df = spark.createDataFrame([((x, {"k": [x]}),) for x in numbers], "v struct<b:double,a:map<string,array<double>>>")
    got = df.select("v", canonical.text(F.col("v"), df.schema["v"].dataType).alias("x")).collect()
    assert len(got) == len(numbers) and all(r.x == want(r.v) for r in got) and got[0].x == '{"a":{"k":[1e-07]},"b":1e-07}'
    v = spark.createDataFrame([('{"b": {"d": 1, "c": [true, null]}, "a": "é"}',), (None,)], "j string").select(F.parse_json("j").alias("v"))
    assert [r.x for r in v.select(canonical.text(F.col("v"), v.schema["v"].dataType).alias("x")).collect()] == ['{"a":"é","b":{"c":[true,null],"d":1}}', "null"]


def test_fields_of_one_name_are_refused(spark):
    kind = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.lit(2).alias("a")).alias("v")).schema["v"].dataType
    with pytest.raises(ValueError):
        canonical.text(F.col("v"), kind)


def test_reader_sees_one_whole_version(spark, tmp_path):
    """While versions of ever more rows are written, each read holds rows of one version only, and as many as it has."""
    table = Snapshots(spark, f"file://{tmp_path}/t")
    make = lambda v: spark.range(100 * v).select("id", F.lit(v).alias("v"))
    table.write(make(1))
    pinned = table.read()
    with ThreadPoolExecutor(1) as pool:
        writing = pool.submit(lambda: [table.write(make(v)) for v in range(2, 7)])
        seen = []
        while not writing.done() or not seen:
            seen += [tuple(r) for r in Snapshots(spark, table.path).read().groupBy("v").count().collect()]
            assert seen[-1][1] == 100 * seen[-1][0]
        assert writing.result() == [2, 3, 4, 5, 6]
    assert seen == sorted(seen) and pinned.count() == 100 and table.read(3).count() == 300
    assert table.expire(2) == [1, 2, 3, 4] and table.versions() == [5, 6] and table.read(5).count() == 500


def test_guard_holds_among_writers(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t")
    assert table.versions() == [] and table.write(spark.range(10)) == 1
    for n in (0, 9):
        with pytest.raises(Refused):
            table.write(spark.range(n))
    assert table.orphans() == [] and table.read().count() == 10
    with ThreadPoolExecutor(3) as pool:
        made = list(pool.map(lambda _: Snapshots(spark, table.path).write(spark.range(20)), range(3)))
    assert sorted(made) == [2, 3, 4] and table.write(spark.range(3), allow_fewer=True) == 5
    spark.range(3).write.parquet(f"{table.path}/rows/broken")
    assert table.orphans() == ["broken"]


def test_changes_between_versions(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t")
    table.write(spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "k int, x string"))
    table.write(spark.createDataFrame([(1, "a", None), (2, "b", None), (4, None, 1), (5, None, None)], "k int, x string, y int"))
    assert {tuple(r) for r in table.changes(1, 2, "k").collect()} == {(2, "changed"), (3, "removed"), (4, "changed"), (5, "added")}
