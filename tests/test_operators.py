import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.text import clean_lines, excerpt, repaired, section_tokens, stem
from marlstone.operators import answer, chunking, ledger, metrics, retrieval, risk
from marlstone.sources import files
from marlstone.streaming import streams


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_text(spark):
    for word, want in {"registration": "regist", "registered": "regist", "policies": "policy", "data": "data", "12345": "12345"}.items():
        assert one(spark, word, stem) == want
    assert one(spark, "a  \r\n\r\n\r\n\r\nb ", clean_lines) == "a\n\nb"
    assert one(spark, "it�s a � b", repaired) == "it’s a — b"
    assert sorted(one(spark, "NPC Circular No. 16-03 and RA 10173", section_tokens)) == ["10173", "16-03"]


def test_cleaning(spark):
    noise = "Title\u00a0one  \r\nPage 3\n - 4 - \n©\n| a | b |\n\n \n\nit\ufffds here \ufffd yes\t\nPage 3 of the book\n"
    assert one(spark, noise, clean_lines) == "Title one\n\nit’s here — yes\nPage 3 of the book"
    assert one(spark, None, clean_lines) is None and one(spark, "", clean_lines) == ""


def test_excerpt(spark):
    text = "The first words of a long text that goes on and on about covered transactions of every kind and their reports to the council"
    at = lambda anchor, pad: one(spark, text, lambda c: excerpt(c, F.lit(anchor), pad))

    def plain(anchor, pad):
        needle = " ".join(anchor.lower().split())
        i = text.lower().find(needle)
        if i < 0:
            return text[: 2 * pad]
        s, e = max(0, i - pad), min(len(text), i + len(needle) + pad)
        if s > 0 and 0 <= (k := text.find(" ", s)) < e:
            s = k + 1
        if e < len(text) and (k := text.rfind(" ", s, e)) > s:
            e = k
        return ("..." if s else "") + text[s:e].strip() + ("..." if e < len(text) else "")

    for anchor in ("Covered  Transactions", "the first", "council", "nowhere", "x"):
        for pad in (0, 3, 20, 500):
            assert at(anchor, pad) == plain(anchor, pad), (anchor, pad)


def test_pieces(spark):
    def plain(body):
        start, out = 0, []
        if len(body) <= chunking.TARGET:
            return [body]
        while start < len(body):
            end = min(start + chunking.TARGET, len(body))
            stop = body.rfind(". ", start, end) - start if end < len(body) else -1
            end = start + stop + 1 if stop > chunking.TARGET // 2 else end
            out.append(body[start:end].strip())
            if end >= len(body):
                return out
            start = max(end - chunking.OVERLAP, start + 1)

    for body in ("Short.", "A sentence of words. " * 400, "x" * 9000, "é😀 o. " * 2000, "a" * 1101 + ". " + "b" * 5000, "y" * chunking.TARGET):
        assert one(spark, body, chunking.pieces) == plain(body), body[:20]


def test_sections_and_chunks(spark):
    body = "The quick controller keeps the records. " * 80
    text = f"Opening words that come before any header at all, long enough.\nSection 1. Scope\n{body}\nSection 2. requires that\nSection 3. Terms\nshort tail text that is folded into the chunk before it."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    rows = chunking.sections(docs).where("id = 1").orderBy("section_no").collect()
    assert [r.label for r in rows] == ["Preamble", "Section 1. Scope", "Section 3. Terms"]
    assert "Section 2. requires that" in rows[1].body
    out = chunking.chunks(docs).orderBy("ordinal").collect()
    assert {r.doc_id for r in out} == {1} and [r.ordinal for r in out] == list(range(len(out)))
    assert out[-1].text.endswith("before it.") and all(r.char_len <= 2 * chunking.TARGET for r in out)


def test_risk(spark):
    texts = [("The caller claimed to be from the bank and asked for the OTP",), ("A routine visit",), (" ",), (None,)]
    rows = risk.assess(spark.createDataFrame(texts, "text string")).collect()
    assert rows[0].tier == "critical" or rows[0].tier == "high"
    assert [r.n_flags for r in rows[1:]] == [0, 0, 0] and rows[1].tier == "none"
    order = [(f.severity, f.id) for f in rows[0].flags]
    assert order == sorted(order, reverse=True)
    assert risk.catalogue(spark).count() == 20


def test_gate(spark):
    q = spark.createDataFrame([("May we ask the customer for the CVV?",), ("what is for lunch",)], "t string")
    rows = q.select(answer.in_domain(F.col("t")).alias("d"), answer.needs_scope_note(F.col("t")).alias("n"), answer.expanded(F.col("t")).alias("e")).collect()
    assert [(r.d, r.n) for r in rows] == [(True, True), (False, False)] and len(rows[0].e) > len(rows[1].e)


def test_ledger_breaks_where_it_is_altered(spark):
    rows = spark.createDataFrame([(1, i, f"e{i}") for i in range(20)] + [(2, 5, "x")], "ledger int, seq int, payload string")
    chain = ledger.chained(rows)
    assert {(r.ledger, r.n, r.broken_at) for r in ledger.verified(chain).collect()} == {(1, 20, None), (2, 1, None)}
    bad = chain.withColumn("payload", F.when((F.col("ledger") == 1) & (F.col("seq") == 7), "no").otherwise(F.col("payload")))
    assert {(r.ledger, r.broken_at) for r in ledger.verified(bad).collect()} == {(1, 7), (2, None)}


def test_recent_entries_and_heads(spark):
    rows = spark.createDataFrame([(1, i, f"e{i}") for i in range(7)] + [(2, 0, None), (2, 1, "x")], "ledger int, seq int, payload string")
    whole = {(r.ledger, r.seq): r.entry_hash for r in ledger.chained(rows).collect()}
    assert whole[2, 0] is None and whole[2, 1] == hashlib.sha256(f"{ledger.GENESIS}|x".encode()).hexdigest()
    heads = spark.createDataFrame([(1, whole[1, 3])], "ledger int, head string")
    later = {(r.ledger, r.seq): r.entry_hash for r in ledger.chained(rows.where("seq > 3"), heads=heads).collect()}
    assert later == {k: v for k, v in whole.items() if k[1] > 3}
    assert [(r.seq, r.back) for r in ledger.recent(rows.where("ledger = 1"), 3).orderBy("back").collect()] == [(6, 1), (5, 2), (4, 3)]


def test_guarded_sink(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert files.write_guarded(spark.range(5), path) == 5
    for n in (0, 3):
        with pytest.raises(ValueError):
            files.write_guarded(spark.range(n), path)
    assert spark.read.parquet(path).count() == 5 and files.write_guarded(spark.range(3), path, allow_fewer=True) == 3


def test_guarded_sink_after_a_break(spark, tmp_path):
    """A break between the two renames leaves the old rows aside; the next call finds them."""
    path = f"file://{tmp_path}/t"
    files.write_guarded(spark.range(5), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    with pytest.raises(ValueError):
        files.write_guarded(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()


def test_raw_files(spark, tmp_path):
    raw = {"latin.txt": "caf\xe9 au lait".encode("latin-1"), "a.pdf": b"%PDF-1.7 \xff\xfe", "empty.txt": b"", "p.html": b"<!doctype html><p>Hi <b>you</b></p><script>x</script>", "big.txt": b"word " * 400_000, "odd.bin": b"\xff\xfe%PD"}
    for name, data in raw.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, f"file://{tmp_path}").collect()}
    assert {n: r.kind for n, r in got.items()} == {"latin.txt": "text", "a.pdf": "pdf", "p.html": "html", "big.txt": "text", "odd.bin": "text"}
    assert got["latin.txt"].text == "caf\ufffd au lait" and got["a.pdf"].text is None and got["p.html"].text.split() == ["Hi", "you"] and "\n" in got["p.html"].text and len(got["big.txt"].text) == 2_000_000
    assert all(r.n_bytes == len(raw[n]) for n, r in got.items())


def test_logs_and_arrays(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"seq": 1, "ts": "t", "event": "e", "summary": "s", "prev_hash": "p", "entry_hash": "h"}\n\nnot json\n{"seq": "x"}\n')
    assert [r.seq for r in files.read_log(spark, f"file://{tmp_path}/log.jsonl").collect()] == [1]
    (tmp_path / "m.json").write_text('[{"doc_id": "a"},\n {"doc_id": "b"}]')
    assert sorted(r.doc_id for r in files.read_json_array(spark, f"file://{tmp_path}/m.json", "doc_id string").collect()) == ["a", "b"]
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "tags": ["x"]}\n\n{"chunk_id": "b"}\n')
    assert sorted(r.chunk_id for r in files.read_jsonl(spark, f"file://{tmp_path}/c.jsonl", files.CHUNK).collect()) == ["a", "b"]


def test_gates(spark):
    rows = [(1, "short", True, None), (2, "Advisory No. 1 " * 200, True, None), (3, "Advisory No. 1 " * 200, False, ["missing token"]), (4, "the Data Privacy Act " * 200, False, ["data privacy act"]), (5, None, False, None)]
    df = spark.createDataFrame(rows, "id int, text string, page boolean, needs array<string>")
    got = {r.id: r.why for r in df.select("id", files.gate(F.col("text"), F.col("page"), F.col("needs")).alias("why")).collect()}
    assert got == {1: "too little text", 2: "index page", 3: "another document", 4: None, 5: "too little text"}
    good, bad = files.admitted(spark.createDataFrame([(1, " \n"), (2, "x"), (3, "")], "id int, text string"), blank=False)
    assert [r.id for r in good.collect()] == [2] and {r.id: r.reason for r in bad.collect()} == {1: "blank", 3: "empty"}


def test_quantiles_in_ranges(spark):
    g = random.Random(3)
    rows = [(k, float(g.randint(0, 30 if k == "hot" else 10_000))) for k in ["hot"] * 900 + ["a"] * 101 + ["b"]] + [("hot", None), ("none", None)]
    for ranges in (1, 3, 40):
        got = {r.k: (r.n, r.p50, r.p95) for r in metrics.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v", ranges=ranges).collect()}
        for k in ("hot", "a", "b"):
            v = sorted(x for name, x in rows if name == k and x is not None)
            assert got[k] == (len(v), v[len(v) // 2], v[max(0, int(0.95 * len(v)) - 1)]), (k, ranges)


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([([[3.0, 4.0], [1.0, 0.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "v array<array<double>>, m array<double>")
    got = df.select(retrieval.pooled(F.col("v"), F.col("m")).alias("c"), retrieval.pooled(F.col("v"), F.col("m"), "mean").alias("a")).first()
    assert got.c == [0.6, 0.8] and [round(x, 6) for x in got.a] == [round(x / 8**0.5, 6) for x in (2, 2)]
    with pytest.raises(ValueError):
        retrieval.pooled(F.col("v"), F.col("m"), "max")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "id long, text string")
    made = []

    def encode(t):
        made.append(1)
        return t.select("id", F.array(F.length("text").cast("double")).alias("v"))

    ask = lambda t: retrieval.cached_vectors(t, f"file://{tmp_path}/vectors", encode, "id", "id", "text").count()
    assert (ask(texts), ask(texts), len(made)) == (9, 9, 1)
    edited = texts.withColumn("text", F.when(F.col("id") == 4, "text X").otherwise(F.col("text")))
    assert (ask(edited), len(made)) == (9, 2) and (ask(edited.where("id < 8")), len(made)) == (8, 3)
    with pytest.raises(ValueError):
        retrieval.cosines(texts.select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("v")), texts.select("id", F.array(F.lit(1.0)).alias("v")), most=3)


def test_citations_pass_over_what_overlaps(spark):
    same = "Keep the consent register for each caller. "
    passages = [(1, same + "More words follow it here."), (2, same), (3, "No time is stated but consent is required to register anything at all."), (4, "Notify within 72 hours of the consent being withdrawn by a caller."), (5, "zzz")]
    texts = spark.createDataFrame([(i, t, f"D{i}", "s" * 80) for i, t in passages], "id int, text string, doc_id string, section string")
    ranked = spark.createDataFrame([(q, i, r, 1.0 / r) for q in (7, 8) for r, i in enumerate((1, 2, 3, 4, 5), 1)], "query_id int, id int, rank int, score double")
    asked = spark.createDataFrame([(7, "consent register caller"), (8, "how many hours after consent is withdrawn by a caller")], "query_id int, text string")
    got = {r.query_id: [(c.rank, c.id) for c in r.citations] for r in answer.citations(ranked, asked, texts).collect()}
    assert got == {7: [(1, 1), (2, 3), (3, 4)], 8: [(1, 4), (2, 1), (3, 3)]}
    first = answer.citations(ranked, asked, texts).where("query_id = 7").first().citations[0]
    assert first.label == "[D1 " + "s" * 60 + "]" and first.score == 1.0


def test_catalogue_reports_without_passages(spark):
    rows = risk.assess(spark.createDataFrame([(1, "The caller claimed to be from the bank and asked for the OTP"), (2, "A routine visit"), (3, None)], "id int, text string"))
    none = spark.createDataFrame([], "chunk_id string, doc_id string, text string, rank int")
    got = {r.id: r for r in risk.reports(rows, none, "id").collect()}
    assert got[1].degraded and got[1].n_citations == 0 and got[1].actions and len(set(got[1].actions)) == len(got[1].actions)
    assert not got[2].degraded and got[2].actions == [risk.NO_ACTION] and got[3].n_flags == 0


def test_missing_blocks(spark):
    held = spark.createDataFrame([(0, b"\0\0"), (4, b"\0\1"), (8, b"")], "start long, content binary")
    assert [(r.start, r.end) for r in files.missing_blocks(spark, 10, 4, held).orderBy("start").collect()] == [(0, 4), (8, 10)]
    assert [(r.start, r.end) for r in files.missing_blocks(spark, 10, 4, spark.createDataFrame([(4,)], "start long")).orderBy("start").collect()] == [(0, 4), (8, 10)]


def test_streams(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "z"), ("a", 5, "y"), ("b", 6, None)]
    spark.createDataFrame(rows, "k string, seq long, v string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.read_table_as_stream(spark, f"{tmp_path}/in", "k string, seq long, v string")
    query = streams.changes(stream, "k", "seq", "v").writeStream.format("memory").queryName("moves").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.key, r.seq, r.changed) for r in spark.table("moves").collect()}
    assert got == {("a", 1, False), ("a", 3, True), ("b", 4, False), ("b", 6, True)}
    for name, made in (("scanned", streams.scanned(stream, "key", "v")), ("judged", streams.assessed(stream, "v"))):
        made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        assert spark.table(name).count() == 6
    for part in (1, 2):
        spark.createDataFrame([("l", 10 * part + i, "e", "s") for i in range(3)], "ledger string, seq long, event string, summary string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log_in")
        events = streams.read_table_as_stream(spark, f"{tmp_path}/log_in", "ledger string, seq long, event string, summary string", files=10)
        streams.append_log(events, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination(120)
    out = ledger.verified(spark.read.parquet(f"{tmp_path}/log")).collect()
    assert [(r.ledger, r.n, r.broken_at) for r in out] == [("l", 6, None)]
