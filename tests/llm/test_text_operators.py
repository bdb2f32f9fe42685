"""Operators on texts against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, ngram_join, substring_dedup, suffix_dedup
from marlstone.llm.deepshallow import lce, shallow, shared_spans, suffix_order

SCHEMA = "doc_id long, text string, lang string, id long, keys string, z binary"  # names that operators use inside
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts(seed=7, n=60):
    g = random.Random(seed)
    vocabulary = ["".join(g.choice("abcdeé") for _ in range(g.randint(1, 7))) for _ in range(60)]
    passage = " ".join(g.choice(vocabulary) for _ in range(90))
    out = []
    for i in range(n):
        words = [g.choice(vocabulary) for _ in range(g.choice((0, 3, 20, 120, 300)))]
        if i % 3 == 0:  # a third holds one passage
            words.insert(g.randint(0, len(words)), passage)
        out.append(" ".join(words).capitalize())
    near = out[9].split()
    out += [" ".join(near[:50] + ["new"] + near[51:]), " ".join(near) + " end", out[9], out[9], "", " \t\n", "of " * 400, "😀é" * 300, "x" * 3000]
    return list(enumerate(out, 1)) + [(1000, None), (None, "lone words of a document without an id " * 3)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 5, "k", b"z") for i, t in rows], SCHEMA)


def test_ngram_join(spark):
    rows = texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}
    sets = {}
    for i, t in rows:
        w = BLANK.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    part = {i: i for i in sets}
    order = lambda i: -1 if i is None else i
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a != b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b], key=order)
    assert got == {i: (len(sets[i]), part[i]) for i in sets}


def test_ngram_join_group_larger_than_a_leaders_reach(spark):
    """A chain whose ends don't link, and copies of every member."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(12):
        words = [f"n.{i}" if i < 4 * step else w for i, w in enumerate(base)]
        rows += [(10 * step + c, " ".join(words)) for c in range(3)]
    got = {r.component_id for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == {0}


def test_suffix_dedup(spark):
    rows = texts()
    out = suffix_dedup.dedup(frame(spark, rows), length=60, gram=16, reported=40).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out}
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[k : k + 60] for b in data.values() for k in range(len(b) - 59))
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 59):
            if seen[b[k : k + 60]] > 1:
                gone[k : k + 60] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        assert got[i] == (len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])), i
    seen = Counter(b[k : k + 40] for b in data.values() for k in range(len(b) - 39))
    shared = {r.doc_id: r.n_shared for r in out}
    for i, b in data.items():
        covered = {p for k in range(len(b) - 39) if seen[b[k : k + 40]] > 1 for p in range(k, k + 40)}
        assert shared[i] == len(covered), i


def test_quicksort_parts_and_tries_order(spark):
    """With the parameters in use, on the places of real texts: quicksort parts places of one gram, tries order what it leaves."""
    texts = [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    grams: dict[int, list[bytes]] = {}
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        _, place, _, end, h, _ = suffix_dedup.named_places(data, np.array([0, len(data)]), (suffix_dedup.REPORTED, 400), suffix_dedup.GRAM)
        for p, e, g in zip(place.tolist(), end.tolist(), h.tolist()):
            grams.setdefault(g, []).append(t[p:e])
    groups = [x for x in grams.values() if len(x) > 1]
    parts = [shallow(x) for x in groups]
    parted, ordered = sum(len(p) > 1 for p in parts), sum(len(q) > 1 for p in parts for q in p)
    assert len(groups) > 100 and parted > 0.05 * len(groups) and ordered > 100
    every = [x for g in groups for x in g]
    assert [every[i] for i in suffix_order(every)] == sorted(every)


def test_suffix_order_and_spans():
    g = random.Random(3)
    for t in range(200):
        base = bytes(g.choice(b"ab") for _ in range(60))
        left, right = [], []
        for _ in range(g.randint(2, 12)):
            x = bytearray(base)
            for _ in range(g.randint(0, 3)):
                x[g.randrange(60)] = g.choice(b"abc")
            left.append(bytes(x[g.randint(0, 10) : 20]))
            right.append(bytes(x[20 : 60 - g.randint(0, 10)]))
        assert [right[i] for i in suffix_order(right)] == sorted(right)
        least = g.randint(5, 40)
        cover = lambda spans: {(i, k) for i, a, b in spans for k in range(-a, b)}
        want = [(i, a, b) for i in range(len(left)) for j in range(len(left)) if i != j for a, b in [(lce(left[i][::-1], left[j][::-1]), lce(right[i], right[j]))] if a + b >= least]
        assert cover(shared_spans(left, right, least)) == cover(want), t


@pytest.mark.parametrize("history", [(), (0.2, 0.4, 0.6, 0.8)])
def test_substring_dedup(spark, history):
    rows = texts()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(frame(spark, rows), history=history).collect()}
    order = lambda i: -1 if i is None else i
    words = {i: BLANK.findall(t or "") for i, t in rows}
    first: dict[tuple, int] = {}
    for i in sorted(words, key=order):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), order(i))
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < order(i) for p in range(k, k + 13)}
        assert got[i] == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)), i


def test_substring_index_is_opened_again(spark, tmp_path):
    """A new session goes on from the folder: same answers as one index that sees all batches, whatever breaks in between."""
    rows = sorted((r for r in texts() if r[0] is not None), key=lambda r: r[0])
    path = f"file://{tmp_path}/index"
    parts = [rows[i::5] for i in range(5)]

    def answered(hits):
        out = set()
        for r in hits.collect():
            out |= set(zip(substring_dedup.exchange.unpack_ids(bytes(r["ids"])).tolist(), np.frombuffer(bytes(r["keys"]), "<u8").tolist()))
        return out

    whole = substring_dedup.FingerprintIndex(spark, n=3)
    levels = set()
    for i, part in enumerate(parts):
        docs = spark.createDataFrame(part, "id long, text string")
        want = answered(whole.add(docs))
        if i == 3:  # a run that no manifest names is no part of the index
            spark.range(3).withColumn("kind", F.lit(1)).write.partitionBy("kind").parquet(f"{path}/run-broken")
        again = substring_dedup.FingerprintIndex(spark.newSession(), k=99, n=7, path=path) if i else substring_dedup.FingerprintIndex(spark, n=3, path=path)
        assert (again.k, again.n) == (13, 3) and answered(again.add(docs)) == want and again.state == i + 1
        levels |= {level for level, _ in again.runs}
    assert max(levels) >= 2 and any(answered(whole.add(spark.createDataFrame([(10**6 + i, t) for i, t in rows], "id long, text string"))))


def test_substring_dedup_of_shared_ids(spark):
    """Rows of one id each lose what a smaller id has, not what another row of the id has, in any batches."""
    g = random.Random(5)
    first = [f"w{g.randint(0, 10**6)}" for _ in range(60)]
    rows = [(1, " ".join(first)), (None, " ".join(first[40:])), (None, "lone " + " ".join(first[38:]))]
    rows += [(7, " ".join(first[i : i + 20] + [f"own{i}"] * 3 + ["same"] * 14)) for i in range(0, 40, 2)]
    rows += [(9, rows[5][1]), (9, rows[6][1] + " end"), (8, "")]
    words = [(-1 if i is None else i, t.split()) for i, t in rows]
    at: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - 12):
            at[tuple(w[k : k + 13])] = min(i, at.get(tuple(w[k : k + 13]), i))
    want = []
    for i, w in words:
        gone = {p for k in range(len(w) - 12) if at[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    for history in ((), (0.3, 0.6)):
        got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), history=history).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)


def test_two_writers_of_a_substring_index(spark, tmp_path):
    """The slower of two writers begins anew on the state of the faster one; no batch is lost, and leftovers go."""
    path = f"file://{tmp_path}/index"
    words = [f"w{i}" for i in range(90)]
    docs = [spark.createDataFrame([(i, " ".join(words[20 * i : 20 * i + 30]))], "id long, text string") for i in range(4)]
    one, two = (substring_dedup.FingerprintIndex(spark, n=3, path=path) for _ in range(2))
    one.add(docs[0])
    with ThreadPoolExecutor(2) as pool:
        assert len(list(pool.map(lambda x: x[0].add(x[1]).count(), [(one, docs[1]), (two, docs[2])]))) == 2
    again = substring_dedup.FingerprintIndex(spark, path=path)
    assert again.state == 3 and again.n == 3
    copies = spark.createDataFrame([(10, " ".join(words[:70]))], "id long, text string")
    hits = again.add(copies, last=True).collect()
    assert sum(len(bytes(r["keys"])) // 8 for r in hits) == 3 * 18
    spark.range(3).withColumn("kind", F.lit(1)).write.partitionBy("kind").parquet(f"{path}/run-broken")
    assert "run-broken" in again.sweep() and again.sweep() == []
    assert sum(len(bytes(r["keys"])) // 8 for r in again.add(copies, last=True).collect()) == 3 * 18


@pytest.mark.parametrize("width", [1, 7, 64, 8192])
def test_blocked_product(width):
    g = np.random.default_rng(width)
    sets = [g.choice(500, g.integers(1, 200), replace=False).astype(np.int64) - 250 for _ in range(40)]
    sets += [np.sort(sets[0])[:-1], sets[1][::-1], np.zeros(0, np.int64)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)])
    for need in (np.zeros(len(a), np.int64), both, both + 1, np.full(len(a), 60)):
        got = ngram_join.overlaps(sets, a, b, need, width)
        assert (got[both >= need] == both[both >= need]).all() and (got[both < need] < need[both < need]).all()


def test_ngram_join_of_shared_ids(spark):
    """Rows of one id are documents of their own; a null id is the smallest."""
    t = " ".join(f"w{i}" for i in range(50))
    u = " ".join(f"v{i}" for i in range(50))
    rows = [(5, t), (5, u), (7, t), (None, u), (None, "z " + t), (9, "alone at last")]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted([(5, 46, None), (5, 46, None), (7, 46, None), (None, 46, None), (None, 47, None), (9, 1, 9)], key=repr)
    assert ngram_join.near_duplicates(frame(spark, [(5, t), (5, u), (7, t)])).where("doc_id = 7").first().component_id == 5


def test_decontamination(spark):
    rows = texts()
    source = dict(rows)[9].split()
    items = [(1, " ".join(source[5:40])), (2, " ".join(source[60:66])), (3, "nothing like this in any of the documents at all here"), (4, None), (5, "  "), (11, " ".join(source[5:16])), (None, " ".join(source[20:40]))]
    tests = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id int")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(frame(spark, rows), tests).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = [(i, w[k : k + 10]) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - 9))]
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found |= {str(item)} if item is not None else set()
        assert got[i] == (len(w), len(hit), sorted(found)), i


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "c x x x a"), (3, None)], "id long, text string")
    assert {(r.doc_id, r.pos, r.other) for r in decontaminate.near(docs, "a", "c", 2).collect()} == {(1, 0, 2), (1, 3, 2)}


def test_empty_tables(spark):
    none = frame(spark, [])
    tests = spark.createDataFrame([], "item_id long, text string")
    for out in (ngram_join.near_duplicates(none), suffix_dedup.dedup(none), substring_dedup.dedup(none), decontaminate.contamination(none, tests)):
        assert out.count() == 0
    some = frame(spark, [(1, "a b"), (1, "a b")])
    assert [r.n_hit for r in decontaminate.contamination(some, tests).collect()] == [0, 0]
    assert [(r.doc_id, r.component_id) for r in ngram_join.near_duplicates(some).collect()] == [(1, 1)] * 2
    assert hashlib.sha256(b"").hexdigest()[:8] == "e3b0c442"
