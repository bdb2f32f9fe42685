import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, bytehash, decontaminate, exchange, ngram_join


@pytest.fixture
def encoder():
    return bpe.Bpe(bpe.default_path(), bpe.default_pattern())


def counted(model, name):
    """What ``name`` of ``model`` is called with from now on."""
    seen, plain = [], getattr(model, name)
    setattr(model, name, lambda x: seen.append(x) or plain(x))
    return seen


def test_pairs_stay_known_from_task_to_task(encoder):
    g = random.Random(7)
    texts = [" ".join("".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(4, 12))) for _ in range(300)) for _ in range(10)]
    tried = counted(encoder, "fits")
    first = encoder.encode_all(texts)
    before = len(tried)
    encoder.forget(everything=True)  # as a task does at its end
    assert encoder.encode_all(texts) == first
    assert before > 1000 and len(tried) - before < before / 20
    assert first == [b"".join(map(encoder.piece, encoder.pattern.findall(x))) for x in texts]


def test_a_task_leaves_no_model_but_its_slots():
    key = (bpe.default_path(), bpe.default_pattern())
    model = bpe.model()
    codes = model.encode("hedgerows qwpozxqj")
    bpe.leave()
    assert key not in bpe._models and bpe._slots[key] is model._slots and model._slots.nbytes <= 2 << 20
    other = bpe.model()
    tried = counted(other, "fits")
    assert other is not model and other._slots is model._slots and other.encode("hedgerows qwpozxqj") == codes and not tried


def test_tables_of_powers_go_at_the_end_of_a_task():
    def work(batches):
        for x in batches:
            bytehash.range_hash(bytehash.prefix(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))
            assert sum(t.nbytes for t in bytehash._tables.values()) > 1 << 22
            yield x

    assert list(bytehash.tidy(work)([b"abc", b"de"])) == [b"abc", b"de"] and not bytehash._tables


def test_slots_may_be_few(encoder, monkeypatch):
    text = "unquestionably overgrown hedgerows; zxqj vbnm qwpo lkjhg"
    right = encoder.encode(text)
    monkeypatch.setattr(bpe, "SLOT_BITS", 2)
    other = bpe.Bpe(bpe.default_path(), bpe.default_pattern())
    assert len(other._slots) == 4 and [other.encode(text) for _ in range(2)] == [right, right]


def test_pieces_that_keep_coming_are_not_learned_again(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 20_000)
    learned = counted(encoder, "_learn")
    texts = [" ".join(["alwaysthere", *(f"w{chr(97 + i % 26)}x{i}q{k}" for k in range(20))]) for i in range(30)]
    codes = [encoder.encode(x) for x in texts]
    assert encoder._held <= 20_000 + 20 * 5 * 300  # one text more than half
    assert sum("alwaysthere" in x for x in learned) == 1
    assert [encoder.decode(x).decode() for x in codes] == texts


def test_rows_of_answers_do_not_grow_with_the_square_of_the_partitions(spark, monkeypatch):
    g = random.Random(3)
    shared = [f"w{g.randrange(10**6)}" for _ in range(2000)]
    rows = [(i, " ".join(shared[i:])) for i in range(40)]  # each shares nearly all with the others
    rows += [(i, " ".join(f"u{i}x{g.randrange(10**6)}" for _ in range(50))) for i in range(40, 60)]
    asked, plain = [], exchange.per_id
    monkeypatch.setattr(exchange, "per_id", lambda answers, *more: asked.append(answers.count()) or plain(answers, *more))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == {i: 0 if i < 40 else i for i, _ in rows}
    buckets = ngram_join.BUCKETS * 40
    assert len(asked) == 2 and max(asked) <= buckets * spark.sparkContext.defaultParallelism < buckets * 30


def test_places_follow_the_shingles(spark, monkeypatch):
    sizes = spark.range(10).select("id", F.lit(1000).cast("long").alias("n"))
    least = spark.sparkContext.defaultParallelism
    assert ngram_join._places(sizes, 500) == least and ngram_join._places(sizes, 2) == min(2, least) and ngram_join._places(sizes.limit(0), 500) == least
    monkeypatch.setattr(ngram_join, "PLACE", 100)
    assert ngram_join._places(sizes, 500) == 100 and ngram_join._places(sizes, 50) == 50


def test_each_stage_begins_with_the_garbage_of_the_last_collected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)

    def full():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(x.getCollectionCount() for x in beans if "Old" in x.getName() or "MarkSweep" in x.getName())

    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, "/root/testdata/sf0.001")
        assert full() - before >= spark.sparkContext.defaultParallelism


def test_a_vocabulary_starts_no_python_workers(spark):
    known = decontaminate.vocabulary(spark.range(3).select(F.col("id").cast("string").alias("term")))
    assert known.dtypes == [("term", "string"), ("term_id", "bigint")] and (decontaminate.MARK, decontaminate.COUNT) in map(tuple, known.collect())
    assert "ExistingRDD" not in known._jdf.queryExecution().executedPlan().toString()
