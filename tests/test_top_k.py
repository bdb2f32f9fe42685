"""Block maxima and blocked products against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import impact, retrieval


@pytest.mark.parametrize("seed, docs_of_segment, block", [(1, 16384, 16), (2, 40, 4), (3, 7, 1)])
def test_pruned_top_k_is_that_of_all_scores(spark, monkeypatch, seed, docs_of_segment, block):
    monkeypatch.setattr(impact, "SEGMENT_DOCS", docs_of_segment)
    monkeypatch.setattr(impact, "BLOCK", block)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(150)]
    texts[50:90] = [texts[50]] * 40  # copies tie; the smaller ids win
    docs = spark.createDataFrame([(i, t if i else None) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, w, float(rng.randint(1, 3))) for q in range(12) for w in rng.sample([*words, "none"], 5)], "query_id long, term string, weight double")
    scores = retrieval.bm25(asked, retrieval.postings(docs, stemmed=False), docs.count()).withColumn("score", F.round("bm25", 6))
    want = {(r.query_id, r.id, r["rank"]): r.score for r in retrieval.top(scores, 5).collect()}
    got = {(r.query_id, r.id, r["rank"]): r.score for r in impact.best(impact.index(docs), asked, 5).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_postings_are_skipped(spark):
    """A word that few passages repeat often: blocks without such a passage aren't scored."""
    text = lambda i: f"u{i} " + "rare " * ((i % 10 == 7) + 30 * (i % 500 == 7)) + "and words " * (i % 3) + "other " * (i % 9)
    docs = spark.createDataFrame([(i, text(i)) for i in range(4000)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(1, "rare", 1.0), (1, "words", 1.0)], "query_id long, term string, weight double")
    r = impact.walked(impact.index(docs), asked, 5).where("id is null").agg(F.sum("scored").alias("scored"), F.sum("postings").alias("postings")).first()
    assert r.postings == 400 + sum(i % 3 > 0 for i in range(4000)) and r.scored < r.postings / 2


def test_pruned_top_k_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (None, "a")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a", 1.0)], "query_id long, term string, weight double")
    assert impact.best(impact.index(docs), asked, 3).collect() == []
    assert impact.best(impact.index(docs.limit(0)), asked, 3).collect() == []
    assert impact.best(impact.index(spark.createDataFrame([(1, "a b")], "doc_id long, text string")), asked.limit(0), 3).collect() == []


def test_nearest_is_that_of_a_plain_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)]  # many ties
    vectors = spark.createDataFrame([*rows, (900, None), (901, [1.0]), (None, [9.0, 9.0, 9.0, 9.0])], "id long, v array<float>").repartition(5)
    asked = [(q, [float(x) for x in rng.integers(-2, 3, 4)]) for q in range(7)]
    queries = spark.createDataFrame(asked, "query_id long, v array<double>")
    want = {(q, i, n + 1) for q, v in asked for n, (_, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows)[:6])}
    assert {(r.query_id, r.id, r["rank"]) for r in retrieval.nearest(queries, vectors, 6).collect()} == want
    pairs = retrieval.cosines(queries, vectors).where("id < 300")
    assert pairs.count() == 7 * 300
    assert retrieval.nearest(queries.limit(0), vectors, 6).collect() == [] == retrieval.nearest(queries, vectors.limit(0), 6).collect()
    with pytest.raises(ValueError):
        retrieval.nearest(queries, vectors, 6, most=3)
