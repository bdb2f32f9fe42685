"""Search, classifiers, PII, BPE and WARC against brute force, held-out rows, libraries and round trips."""

import random
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from marlstone.llm import bpe, pii, quality, topk, toxicity, warc

SF = "/root/testdata/sf0.01"


def test_top_k(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(700, 8)).astype(np.float32)
    x[200:400] = x[0]  # a hot vector
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(900, None, 1), (920, [float("nan")] * 8, 1), (940, [None] * 8, 1), (None, [1.0] * 8, 1), (960, [1.0, 2.0], 1), (980, [3.0, 4.0], 1), (20, rows[20][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()}
    ids = np.arange(700)
    v = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    want = {}
    for q in range(0, 700, 20):
        s = v @ v[q]
        for rank, i in enumerate([i for i in np.lexsort((ids, -s)) if i != q][:5], 1):
            want[q, rank] = (int(i), int(s[i]))
    want[960, 1], want[980, 1] = (980, 64 * 64 * 11), (960, 64 * 64 * 11)
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_cover_tree_bounds():
    x = np.floor(np.random.default_rng(1).normal(size=(900, 4)) * 64)
    todo = [topk.cover_tree(x)]
    while todo:
        n = todo.pop()
        assert np.sqrt(((x[n.rows] - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-9
        if n.children:
            centres, worst = np.array([c.centre for c in n.children]), max(np.sqrt(((x[c.rows] - c.centre) ** 2).sum(1)).max() for c in n.children)
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[~np.eye(len(centres), dtype=bool)]
            assert apart.min() >= worst - 1e-9 and (worst <= n.radius / 2 + 1e-9 or len(centres) == max(2, -(-len(n.rows) // topk.LEAF)))
            assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
        todo += n.children


def test_bounds_spare_products_where_vectors_have_structure():
    """On clusters most products are never computed; on noise few are spared, and the result is the same either way."""
    g = np.random.default_rng(2)
    centres = g.normal(size=(40, 16)) * 300
    for spread, least in ((10, 0.8), (400, 0.0)):
        x = np.floor(centres[g.integers(0, 40, 6000)] + g.normal(size=(6000, 16)) * spread)
        q, ids = np.arange(0, 6000, 20), np.arange(6000)
        best, count = topk.Best(len(q), 20, np.full(len(q), -np.inf)), topk.Count()
        topk.dual_search(x[q], ids[q], topk.cover_tree(x[q]), x, ids, topk.cover_tree(x), best, count)
        assert count.by_nodes + count.in_leaves + count.computed == len(q) * 6000 and count.share >= least, count
        for i, j in enumerate(q):
            s = x @ x[j]
            want = [k for k in np.lexsort((ids, -s)) if k != j][:20]
            assert best.ids[i].tolist() == want and (best.scores[i] == s[want]).all()


def test_ids_with_several_vectors(spark):
    df = spark.createDataFrame([(20, [2.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 5.0]), (4, [9.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 4, 64 * 64 * 9), (20, 2, 3, 64 * 64)]


@pytest.mark.parametrize("module, label, mod, held, threshold, least", [(quality, "quality", 5, 0, 0.3, 0.95), (toxicity, "toxic", 3, 1, 0.7, 0.8)])
def test_classifier_on_held_out_rows(spark, module, label, mod, held, threshold, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    part = quality.crc_mod("doc_id", mod)
    model = module.train(docs, labels, part != held)
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000, None), (5001, ""), (None, "x" * 50_000)], "doc_id long, text string"))
    rows = module.score(odd.withColumn("score", F.lit(1)), model).collect()
    assert len(rows) == docs.count() + 3 and all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows}
    truth = [(r.doc_id, r[label]) for r in labels.where(part == held).collect()]
    assert np.mean([(score[i] >= threshold) == y for i, y in truth]) >= least
    none = module.train(docs, labels.limit(0), part != held)
    assert module.score(docs.limit(0), none).count() == 0 and module.score(docs.limit(3), none).count() == 3


def test_identifiers():
    kinds = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def plain(t):
        out = []
        for k, p in enumerate(kinds):
            for m in p.finditer(t):
                d = re.sub("[^0-9]", "", m.group())
                if (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    g = random.Random(2)
    for _ in range(20_000):
        t = "".join(g.choice("ab@@..-+0123456789  (é%") for _ in range(g.randint(0, 40)))
        assert pii.base_spans(t) == plain(t), t


def test_sanitise(spark):
    g = random.Random(1)
    filler = lambda n: " ".join("".join(g.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, f"{filler(8)} zarquon {filler(g.randint(1, 3))} bob@corp.example {filler(6)}") for i in range(8)]
    rows += [(i, f"{filler(30)}") for i in range(8, 200)] + [(300, None), (301, ""), (None, "call +1 (555) 123-4567"), (302, "zarquon alone"), (0, "10.0.0.1")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, terms string")
    out = pii.sanitise(df).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t or "" for i, t in rows if i == r.doc_id and pii.listed(pii.base_spans(t or "")) == r.base)
        if "bob@" in text:
            at = text.index("zarquon")
            assert f"term:{at}:{at + 7}" in r.spans and r.base in ",".join(s for s in r.spans.split(",") if not s.startswith("term"))
            assert "zarquon" not in r.text and "bob@" not in r.text and "[EMAIL]" in r.text
        elif not r.base:
            assert r.spans == "" and r.text == text  # clean documents are left alone, the term too
    assert pii.sanitise(df.limit(0)).count() == 0


def test_bpe_is_that_of_the_library(spark):
    import public_tokenizers

    model = bpe.model()
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    texts += ["", "a" * 3000, " " * 500 + "x", "日本語テキスト" * 50, "don't  we'll\n\n x", "😀é\x00", "<|endoftext|>", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    out = bpe.encode(df, decoded=True)
    for r in out.collect():
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == other.encode_ordinary(t) and r.n_tokens == len(r["ids"]) // 4
        assert bytes(r.decoded).decode() == t
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in bpe.decode(out).collect())
    assert bpe.encode(df.limit(0)).count() == 0


def test_bpe_edits():
    model, g = bpe.model(), random.Random(1)
    for _ in range(60):
        e = bpe.Editable(model, "".join(g.choice(["the ", "don't", "  ", "12", "é", "\n", "ab"]) for _ in range(30)))
        for _ in range(5):
            i = g.randint(0, len(e.text))
            e.replace(i, min(len(e.text), i + g.randint(0, 5)), g.choice([" ", "ab", "'s", "12", "\n ", "é", ""]))
            assert e.ids() == model.encode(e.text)
        e.append(" more")
        assert e.ids() == model.encode(e.text)
    p = bpe.Prefixes(model, b"register")
    p.append(b"ed")
    assert p.ids() == bpe.Prefixes(model, b"registered").ids()
    p.replace(2, 4, b"xx")
    assert p.ids() == bpe.Prefixes(model, b"rexxstered").ids()
    for a, b in [(g.randrange(50_000), g.randrange(50_000)) for _ in range(3000)]:
        x, y = model.tokens[a], model.tokens[b]
        assert model.fits(a << 32 | b) == (model.merged(x + y) == [x, y])


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html>é {i} " + "x" * (i % 50)) for i in range(5000)] + [(None, None, None), (7, "http://h/7", "<html>again")]
    pages = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, hash int")
    assert warc.audit(pages, pages).where("damaged").count() == 0
    hurt = pages.withColumn("html", F.when(F.col("page_id").isin(3, 4100), F.expr("concat('#', substring(html, 2))")).otherwise(F.col("html")))
    out = warc.audit(pages, hurt)
    assert sorted(r.page_id for r in out.where("damaged").collect()) == [3, 4100] and out.count() == len(rows)
    lost = warc.audit(pages, pages.where("page_id <> 4999 OR page_id IS NULL")).where("damaged").collect()
    assert [r.page_id for r in lost] == [4999]
    assert warc.audit(pages.limit(0), pages.limit(0)).count() == 0
    warc.write(pages.where("page_id < 300"), f"file://{tmp_path}/w")
    back = {(r.url, r.html) for r in warc.read(spark, f"file://{tmp_path}/w").collect()}
    assert back == {(u, h) for i, u, h in rows if i is not None and i < 300}
    nested = spark.createDataFrame([(1, "http://a", "one\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc"), (2, "http://b", ""), (3, None, "\r\n\r\n"), (4, "http://d", "é" * 9)], "page_id long, url string, html string")
    warc.write(nested, f"file://{tmp_path}/n")
    assert {(r.url or None, r.html) for r in warc.read(spark, f"file://{tmp_path}/n").collect()} == {(r.url, r.html) for r in nested.collect()}
    (tmp_path / "cut.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nok\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 99\r\n\r\ncut")
    assert [r.html for r in warc.read(spark, f"file://{tmp_path}/cut.warc").collect()] == ["ok"]
    unnamed = spark.createDataFrame([(None, f"u{i}", "x" * i) for i in range(400)], "page_id long, url string, html string")
    hurt = unnamed.withColumn("html", F.when(F.col("url") == "u9", "y").otherwise(F.col("html")))
    assert [r.record_length for r in warc.audit(unnamed, hurt).where("damaged").collect()] == [warc.audit(unnamed.where("url = 'u9'"), hurt).first().record_length]
    assert warc.leaves(unnamed).select("archive").distinct().count() > 300
