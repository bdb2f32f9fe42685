"""What round 4's findings named."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.functions.text import SUFFIXES, excerpt, section_tokens, stem, stem_word
from marlstone.operators import answer, retrieval, risk
from marlstone.operators.rules import RULES
from marlstone.plans import catalogue
from marlstone.plans.catalogue import SECTION_SQL


def test_flags_are_those_of_sql(spark):
    """patterns are read as RE2 reads them, in Arrow; letters beyond ASCII end no word there, and fold as Unicode has it."""
    texts = ["óscreening hit ó", "the Watchliſt, and a CVV²", "claimed to be\nfrom the bank; posing as a bank officer", "cash\t1,000,000 split the cash", " ", "", None, "PIN", "parcel never arrived. Refuses to explain", "ask the customer for the otp, sent overſeas"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {(r.i, r.id, r.evidence) for r in risk.assess(spark.createDataFrame(rows, "i int, text string").repartition(3)).select("i", F.explode("flags").alias("f")).select("i", "f.id", "f.evidence").collect()}
    want = set()
    for i, t in rows:
        for r in RULES:
            found = [x for p in r[5] if t and t.strip(" ") and (x := duckdb.execute("SELECT regexp_extract(?, ?, 0, 'i')", [t, p]).fetchall()[0][0])]
            want |= {(i, r[0], found[0].strip(" "))} if found else set()
    assert got == want and len({i for i, _, _ in want}) >= 5


def test_excerpt_spells_its_text_out_once(spark):
    """an excerpt of an excerpt, as citations cut them, stays a small expression."""
    rows = spark.createDataFrame([("a b " * 90 + "the anchor " + "c d " * 90, "The  anchor"), (None, "a"), ("a", None)], "text string, anchor string")
    twice = rows.select(excerpt(excerpt(F.upper("text"), F.col("anchor"), 100), F.col("anchor"), 20).alias("e"))
    assert str(twice._jdf.queryExecution().optimizedPlan()).count("upper(") == 1
    assert [r.e for r in twice.collect()] == ["...B A B A B A B A B THE ANCHOR C D C D C D C D C...", None, "A"]


def test_section_numbers_end_where_sql_ends_words(spark):
    """a letter beyond ASCII is no part of a word, nor is a vertical tab white space."""
    texts = ["óra 56.48", "éRA 10173é", "ñ1234ñ a1234 1234_ _1234 ٣1234", "RA\v12 IRR\t34", "DſA 77, BSP ñ 55", "cırcular 99 CİRCULAR 98 Circular No. 0016–03", "ra 56é ra 57a", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = sorted((r.i, r.n) for r in rows.select("i", F.explode(section_tokens(F.col("text"))).alias("n")).collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE t (i INTEGER, text VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    assert got == sorted(c.sql(f"SELECT i, unnest({SECTION_SQL.format('text')}) FROM t").fetchall()) and (0, "56") in got


def test_a_report_is_that_of_its_row(spark):
    """what a report counts lies in its own row, so nothing is grouped by id; repeated and null ids get reports of their own."""
    rows = [(1, "There was a screening hit on the watchlist"), (1, "The customer cannot explain the source of funds"), (None, "split the deposit"), (2, "A routine visit")]
    chunks = spark.createDataFrame([("c1", "RA-9160", "the true  Identity of its clients", 1), ("c2", "RA-9160", None, 0)], "chunk_id string, doc_id string, text string, rank long")
    out = risk.reports(risk.assess(spark.createDataFrame(rows, "id int, text string")), chunks, "id")
    got = sorted(((r.id, r.n_flags, r.n_citations, r.n_gaps, r.degraded) for r in out.collect()), key=str)
    assert got == sorted([(1, 1, 0, 1, True), (1, 1, 1, 0, False), (None, 1, 1, 0, False), (2, 0, 0, 0, False)], key=str)


SEARCHES = ("bm25_topk", "bm25_expanded_topk", "answered_questions", "cited_answers", "hybrid_vectors_topk", "hybrid_topk", "reciprocal_ranks")


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_write_no_words_and_no_pairs(spark, monkeypatch, name):
    """F3 to F9: what is written for a search has a row for a document, a term or a result, none for a word of a document."""
    rows = {}

    def noted(df, what, write=retrieval.written):
        rows[what] = (out := write(df, what)).count()
        return out

    for module in (retrieval, answer):
        monkeypatch.setattr(module, "written", noted, raising=False)
    sf = "/root/testdata/sf0.001"
    got = catalogue.queries()[name](spark, sf)
    n, m = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "benchmark"))
    assert got.count() and rows and all(rows[x] <= {"best": 20 * m, "hits": 20 * m}.get(x, n) for x in rows if x not in ("frequency", "queries"))


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"running{i}s" if i % 3 else f"walks{i}" for i in range(40)] + ["1234", "runner", "runs", "running"]
    out = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(44)], k=rng.randint(0, 30))) for _ in range(n)]
    return [*out[: n // 2], *[out[0]] * (n // 4), *out[n // 2 + n // 4 :]], words, rng  # copies tie


@pytest.mark.parametrize("stemmed, small", [(False, False), (True, False), (False, True), (True, True)])
def test_best_is_that_of_all_scores(spark, monkeypatch, stemmed, small):
    """the same rows as from an index of all words, whatever fits a task at once; the queries in several blocks too."""
    if small:
        for name, value in (("WORDS", 20), ("ROOM", 30), ("MOST_TERMS", 12)):
            monkeypatch.setattr(retrieval, name, value)
    said, words, rng = texts(3, 120)
    docs = spark.createDataFrame([(i, t if i != 5 else None) for i, t in enumerate(said)], "id long, text string").repartition(3)
    asked = [(q, w, float(rng.randint(1, 3))) for q in range(9) for w in rng.sample([*words, "none"], 5)]
    asked = spark.createDataFrame(sorted({(q, stem_word(w)): (q, stem_word(w), x) for q, w, x in asked}.values()) if stemmed else asked, "query_id long, term string, weight double")
    scores = retrieval.bm25(asked, retrieval.postings(docs, "id", stemmed=stemmed), docs.count()).withColumn("score", F.round("bm25", 6))
    want = {(r.query_id, r.id, r["rank"], r.score) for r in retrieval.top(scores, 4).collect()}
    assert {(r.query_id, r.id, r["rank"], r.score) for r in retrieval.best(asked, docs, 4, stemmed).collect()} == want and len(want) > 20
    assert retrieval.best(asked.limit(0), docs, 4).collect() == [] == retrieval.best(asked, docs.limit(0), 4).collect()


def test_a_word_is_stemmed_as_a_column_is(spark):
    """in a task as by Spark's expressions."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("aers1", k=rng.randint(1, 7))) + "".join(rng.choices([*SUFFIXES, "r", "y", "x"], k=rng.randint(0, 4))) for _ in range(3000)})
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert [(r.w, stem_word(r.w)) for r in got] == [(r.w, r.s) for r in got] and sum(r.w != r.s for r in got) > 1000


@pytest.mark.parametrize("with_vectors, small", [(False, False), (True, False), (True, True)])
def test_best_fused_is_that_of_all_parts(spark, monkeypatch, with_vectors, small):
    """F5 to F8: instruments, vectors and kinds in the tasks that score, as when every part is a table of pairs."""
    if small:
        for name, value in (("WORDS", 20), ("ROOM", 30)):
            monkeypatch.setattr(retrieval, name, value)
    said, words, rng = texts(7, 80)
    kinds = ["statute", "sop", None, "unheard of"]
    docs = spark.createDataFrame([(i, (t + (f" RA {i % 5}0173" if i % 3 == 0 else "")) if i != 4 else None, kinds[i % 4]) for i, t in enumerate(said)], "id long, text string, kind string").repartition(3)
    asks = spark.createDataFrame([(q, " ".join(rng.sample(words, 4)) + f" RA {q}0173") for q in range(6)] + [(6, "RA 10173")], "query_id long, text string")
    terms = retrieval.query_terms(asks, "query_id", "text", stemmed=False)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    vectors = spark.createDataFrame([(i, vector()) for i in range(60)] + [(61, None), (62, [1.0]), (999, vector())], "id long, v array<float>")
    points = spark.createDataFrame([(q, vector()) for q in range(4)], "query_id long, v array<float>")
    numbers = asks.select("query_id", F.explode(section_tokens(F.col("text"))).alias("number"))
    unit = lambda df: df.withColumn("v", retrieval.unit(F.col("v")))
    cosine = retrieval.cosines(unit(points), unit(vectors.join(docs.select("id"), "id"))) if with_vectors else None
    bm = retrieval.bm25(terms, retrieval.postings(docs, "id", stemmed=False), docs.count())
    fused = retrieval.hybrid(bm, cosine, retrieval.sections(asks, docs), docs.select("id", "kind")).withColumn("score", F.round("score", 6))
    want = {(r.query_id, r.id, r["rank"], r.score) for r in retrieval.top(fused, 15).collect()}
    searched = docs.withColumn("numbers", section_tokens(F.col("text")))
    out = retrieval.best(terms, searched, 15, numbers=numbers, vectors=vectors if with_vectors else None, asked=points if with_vectors else None)
    assert {(r.query_id, r.id, r["rank"], r.score) for r in out.collect()} == want and len(want) > 60
