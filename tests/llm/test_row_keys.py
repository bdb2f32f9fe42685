"""Rows with null or repeated ids are documents of their own."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import decontaminate, pii, queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def words(a, n):
    return " ".join(f"{a}{i}" for i in range(n))


def test_suffix_dedup_of_shared_ids(spark):
    shared = words("s", 40)
    rows = [(None, words("a", 50) + shared), (None, "short"), (None, words("b", 9) + shared + words("c", 70)), (7, words("d", 30)), (7, shared), (7, words("e", 60)), (None, words("f", 50)), (None, words("f", 50)), (8, words("g", 30) + shared)]
    got = Counter((r.doc_id, bytes(r.kept)) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=60, gram=16).collect())
    seen = Counter(t[k : k + 60] for _, t in rows for k in range(len(t) - 59))
    want = []
    for i, t in rows:
        gone = {p for k in range(len(t) - 59) if seen[t[k : k + 60]] > 1 for p in range(k, k + 60)}
        want.append((i, "".join(c for p, c in enumerate(t) if p not in gone).encode()))
    assert got == Counter(want)


def test_decontamination_of_shared_ids(spark):
    item = words("t", 10).split()
    rows = [(None, " ".join(item)), (None, "clean"), (None, " ".join(item[:5]) + " x x x x x"), (None, "x x x x x " + " ".join(item[5:])), (3, "y " + " ".join(item)), (3, "clean too")]
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), tests).collect())
    assert got == Counter([(None, 10, 10), (None, 1, 0), (None, 10, 0), (None, 10, 0), (3, 11, 10), (3, 2, 0)])


def test_pipeline_keeps_rows_of_shared_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 15)
    own = [(None, words("a", 40)), (None, words("b", 40)), (None, item), (4, words("c", 40)), (4, words("d", 40)), (2, words("c", 40)), (4, words("c", 40)), (9, words("e", 40)), (8, words("e", 40))]
    docs = docs.unionByName(spark.createDataFrame(own, "doc_id long, text string"), allowMissingColumns=True)
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    left = [x for x in own if x not in {(4, words("c", 40)), (9, words("e", 40))}]
    assert near.columns == docs.columns and Counter((r.doc_id, r.text) for r in near.collect()) == Counter(left)
    clean = corpus_pipeline.drop_contaminated(spark, near, SF)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(x for x in left if x[1] != item)


def test_terms_of_shared_ids(spark):
    rows = [(None, "ask zarquon at ann@one.example"), (None, "zarquon alone")] + [(i, f"plain words {i}") for i in range(50)]
    got = {r.text for r in pii.rewritten(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("doc_id").isNull()).collect()}
    assert "zarquon alone" in got and not any("ann@" in t for t in got)


def test_rows_without_an_id_are_not_held_out(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    tables = {"documents": docs.unionByName(spark.createDataFrame([(None, "no id here"), (None, None)], "doc_id long, text string")), "labels": spark.read.parquet(f"{SF}/labels.parquet")}
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: tables[name])
    rows = queries.op3_quality_classifier(spark, SF).where("doc_id is null").collect()
    assert len(rows) == 2 and all(r.held_out is False and 0 <= r.score <= 1 for r in rows)
