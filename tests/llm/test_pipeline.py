"""Each stage of the pipeline on its own input, against the plain reading of what it decides."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, decontaminate, ngram_join, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    docs = docs.unionByName(spark.createDataFrame([(None, "call +1 (555) 123-4567 now", None, None, None), (9001, None, "en", "x", None), (9002, "", "en", "x", 0)], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE"]

    def ran(name, given):
        out = stages[name](spark, given, SF)
        path = corpus_pipeline.saved(out, "test")
        return path

    first = ran("quality classifier", docs)
    assert first.columns == columns
    voter = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality.crc_mod("doc_id", 5) != 0)
    want = {r.doc_id for r in quality.score(docs, voter).where(F.col("score") >= 0.3).collect()}
    assert {r.doc_id for r in first.collect()} == want
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good - want) <= 0.03 * len(good)

    second = ran("n-gram Jaccard join", first)
    groups = ngram_join.near_duplicates(first).collect()
    assert second.columns == columns and sorted(map(repr, (r.doc_id for r in second.collect()))) == sorted({repr(r.component_id) for r in groups})

    third = ran("benchmark decontamination", second)
    hit = {r.doc_id for r in decontaminate.contamination(second, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert third.columns == columns and {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - hit and hit

    fourth = ran("PII", third)
    before, after = ({r.doc_id: r for r in x.collect()} for x in (third, fourth))
    assert fourth.columns == columns and set(before) == set(after)
    for i, r in after.items():
        spans = pii.base_spans(before[i].text or "")
        assert all((before[i].text or "")[s:e] not in r.text for s, _, e in spans)
        assert spans or r.text == before[i].text or "[" in r.text
        assert r.n_chars == (len(r.text) if r.text is not None else None)

    last = {r.doc_id: r for r in ran("byte-level BPE", fourth).collect()}
    model = bpe.model()
    assert set(last) == set(after)
    for i, r in last.items():
        assert model.decode(bytes(r["ids"])).decode() == (after[i].text or "") and r.n_tokens == len(np.frombuffer(r["ids"], "<u4"))
