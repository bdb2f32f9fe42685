"""Appending to a log under contention, and what a damaged log shows."""

import json
import pathlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from marlstone.functions.text import html_lines
from marlstone.operators import chunking
from marlstone.sources.log import Log


def rows(spark, *entries):
    return spark.createDataFrame([(n, f'{{"n": {i}}}', i) for n, i in entries], "ledger string, payload string, at long")


def test_two_writers_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/log"

    def write(who):
        log = Log(spark, path, "key")
        return [log.append(rows(spark, *(("shared", 10 * k + who), (f"own{who}", k), ("shared", 10 * k + who + 5))), "at") for k in range(3)]

    with ThreadPoolExecutor(2) as pool:
        receipts = [c for done in pool.map(write, (1, 2)) for c in done]
    log = Log(spark, path, "key")
    assert sorted(c["number"] for c in receipts) == [1, 2, 3, 4, 5, 6] and log.faults() == []
    entries = log.entries().collect()
    for name, n in (("shared", 12), ("own1", 3), ("own2", 3)):
        assert sorted(r.seq for r in entries if r.ledger == name) == list(range(1, n + 1))
    assert all(log.faults(c) == [] for c in receipts[:2]) and len(log.orphans()) >= 0


def test_damage_shows(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", "key")
    assert log.faults() == [] and log.entries().count() == 0 and log.append(rows(spark).limit(0), "at") == {}
    receipts = [log.append(rows(spark, ("a", k), ("b", k)), "at") for k in range(3)]
    assert log.faults(receipts[2]) == []
    with pytest.raises(ValueError):
        log.append(rows(spark, (None, 1)), "at")
    commits = pathlib.Path(tmp_path, "log", "commits")
    last = commits / "000000000003.json"
    kept = last.read_text()
    last.unlink()
    assert any("lost" in x for x in log.faults())  # a tail cut off, seen without a receipt
    for f in pathlib.Path(tmp_path, "log", "vouched").glob("*3.json"):
        f.unlink()
    assert log.faults() == [] and log.faults(receipts[2]) != []  # with all traces gone only a receipt shows it
    last.write_text(json.dumps(json.loads(kept) | {"rows": 7}))
    assert log.faults() == ["commit 3 isn't the one that was made"]
    last.write_text(kept)
    assert Log(spark, f"file://{tmp_path}/log", "other").faults() != []
    log.spark.read.parquet(f"{log.path}/entries/{receipts[1]['folder']}").withColumn("payload", F.lit("x")).coalesce(1).write.parquet(f"{log.path}/forged")
    folder = pathlib.Path(tmp_path, "log", "entries", receipts[1]["folder"])
    for f in folder.iterdir():
        f.unlink()
    for f in pathlib.Path(tmp_path, "log", "forged").iterdir():
        f.rename(folder / f.name)
    assert log.faults() == ["ledger a is broken at 2", "ledger b is broken at 2"]


def test_headers_of_a_page_and_after_a_tab(spark):
    page = "<html><h1>SECTION 1. Scope of these words</h1><p>Text of it.</p><script>x</script><h1>\tSection 2. Further duties</h1><p>More.</p></html>"
    docs = spark.createDataFrame([(1, page)], "doc_id long, html string").select("doc_id", html_lines(F.col("html")).alias("text"))
    got = {r.section_no: (r.label, r.body) for r in chunking.sections(docs).collect()}
    assert [got[k][1] for k in sorted(got)] == ["Text of it.", "More."] and all("\t" not in x for x, _ in got.values())
