"""Fingerprints by spot signatures, periodic runs and the prefix trie against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import periodic, prefix_trie, queries, spotsigs
from marlstone.llm.scan import scan

SF = "/root/testdata/sf0.001"


# Periodic runs


def plain_runs(w, least=6, times=4):
    """Every lag in turn over the whole text."""
    best, ids = {}, np.unique(w, return_inverse=True)[1].reshape(-1) if len(w) else np.zeros(0, int)
    for q in range(1, len(w) // times + 1):
        same = np.concatenate(([False], ids[q:] == ids[:-q], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e + q - s >= max(least, times * q):
                best[s, e + q] = min(q, best.get((s, e + q), q))
    return sorted((s, e, q) for (s, e), q in best.items())


def collapsed(w, found):
    gone = {i for s, e, q in found for i in range(s + q, e)}
    return [x for i, x in enumerate(w) if i not in gone]


def made_words(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.5:
            period = [rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.randint(1, 40))]
            k = rng.randint(1, 9)
            w += (period * k)[: rng.randint(1, len(period) * k)]
        else:
            w += [rng.randint(0, rng.choice([1, 5, 50])) for _ in range(rng.randint(0, 60))]
        if w and rng.random() < 0.2:
            w[rng.randrange(len(w))] = 99
    return w


def test_runs_are_those_of_a_plain_loop():
    rng = random.Random(5)
    for _ in range(400):
        texts = [made_words(rng) for _ in range(rng.randint(1, 4))]
        at = np.cumsum([0] + [len(w) for w in texts])
        s, e, q = periodic.runs(np.array([x for w in texts for x in w], np.int32), at)
        want = sorted((a + at[k], b + at[k], c) for k, w in enumerate(texts) for a, b, c in plain_runs(w))
        assert list(zip(s.tolist(), e.tolist(), q.tolist())) == [tuple(map(int, x)) for x in want], texts


def test_runs_of_strings_on_which_sums_of_powers_collide():
    """Thue-Morse words have equal sums of powers modulo 2**64 without being equal; the walk in the words settles it."""
    tm = [bin(i).count("1") % 2 for i in range(2048)]
    w = (tm + [1 - x for x in tm]) * 5
    s, e, q = periodic.runs(np.array(w, np.int32), np.array([0, len(w)]))
    top = max(zip((e - s).tolist(), q.tolist()))
    assert top == (len(w), 4096) and list(zip(s.tolist(), e.tolist(), q.tolist())) == [(0, len(w), 4096)]


def test_one_word_a_million_times_takes_no_quadratic_time():
    s, e, q = periodic.runs(np.zeros(1 << 20, np.int32), np.array([0, 1 << 20]))
    assert (s.tolist(), e.tolist(), q.tolist()) == ([0], [1 << 20], [1])


def test_collapse_of_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a a a a a a a b", 5), (3, "x\ty  x\ny x y x y\x0bx y", 5), (3, "x\ty  x\ny x y x y\x0bx y", 5), (4, "ä b " * 20, 5), (5, "one two", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse(docs).collect()), key=repr)
    want = [(0, 8, [(0, 7, 1)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 10, [(0, 10, 2)], "x y"), (3, 10, [(0, 10, 2)], "x y"), (4, 40, [(0, 40, 2)], "ä b"), (5, 2, [], "one two")]
    assert got == want
    assert periodic.collapse(docs.limit(0)).collect() == []


def test_op12_over_a_whole_table(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = plain_runs(w)
        best = min(((-(e - s), s, q) for s, e, q in found), default=None)
        first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *first), i
        assert r.runs_sha256 == sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)) and r.collapsed_sha256 == sha(" ".join(collapsed(w, found)))
    assert sum(r.n_runs > 0 for r in got.values()) > 10


# Prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [b for _, b in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members, kids, out = defaultdict(list), defaultdict(set), []
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        total[p] = [0 if kids[p] else 1, (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0]
        for k in kids[p]:
            total[p] = [a + b for a, b in zip(total[p], total[k])]
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def trie_of(spark, monkeypatch, rows, schema=TURNS):
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(rows, schema))
    return sorted((tuple(r) for r in queries.op13_prefix_trie(spark, "").select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("span, seed", [(4096, 1), (3, 2), (2, 3)])
def test_trie_is_that_of_a_plain_loop(spark, monkeypatch, span, seed):
    """Small spans make shards and tiers of few conversations; two long equal conversations lie in many partitions."""
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(-3, 30)]), rng.choice([None, *range(1, 9)]), rng.choice([None, "u", "a"]), rng.choice([None, "", "x", "yé"])) for _ in range(400)]
    rows += [(c, k, "u", f"t{k % 3}") for c in (7, 45) for k in range(200)] if seed == 3 else []
    assert trie_of(spark, monkeypatch, rows) == plain_trie(rows)


def test_trie_of_odd_tables(spark, monkeypatch):
    assert trie_of(spark, monkeypatch, []) == trie_of(spark, monkeypatch, [(None, 1, "a", "b")]) == []
    assert trie_of(spark, monkeypatch, [(1, 1, "a", "b")]) == plain_trie([(1, 1, "a", "b")])  # cut away: no turn is left
    rows = [(c, 1, "same", "first") for c in range(300)]
    assert trie_of(spark, monkeypatch, rows) == plain_trie(rows)


def test_slots_are_a_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-5, 1 << 40, (5000, 3)), axis=0)
    table = prefix_trie.Slots(keys)
    assert sorted(table.slot.tolist()) == list(range(len(keys))) and (table.of(keys) == table.slot).all()
    assert (table.of(keys + np.array([0, 0, 1])) == -1).all() or set(map(tuple, keys + np.array([0, 0, 1]))) & set(map(tuple, keys))


def test_scan_of_one_hot_key(spark):
    rows = [(9, bytes([k % 7]) * 16, k) for k in range(3000)] + [(k, bytes([k % 5]) * 16, 0) for k in range(500) if k != 9]
    got = scan(spark.createDataFrame(rows, "key long, digest binary, turn long").repartition(7), [F.col("turn")]).collect()
    one = sorted((r.i, r.turn, r.last) for r in got if r.key == 9)
    assert one == [(k, k, k == 2999) for k in range(3000)] and all(r.i == 0 and r["last"] for r in got if r.key != 9)
    from marlstone.llm.scan import multipliers

    for j, m in enumerate(multipliers(0)):
        h = 0
        for r in sorted((r for r in got if r.key == 9), key=lambda r: r.i):
            h = (h * m + int.from_bytes(bytes(r.digest)[8 * j : 8 * j + 8], "little")) % (1 << 64)
            assert h == r[f"h{j}"] % (1 << 64)


# Spot signatures


def plain_spots(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if x]
    short = lambda s: hashlib.md5(s.encode()).hexdigest()[: spotsigs.DIGITS]
    common = [x in spotsigs.ANCHORS for x in w]
    out, content = set(), []
    for i in range(len(w) - 1, -1, -1):
        x, chain = w[i], content[: -spotsigs.CHAIN - 1 : -1]
        if not common[i]:
            content.append(x)
        odd = not common[i] and i >= spotsigs.GAP and not any(common[i - spotsigs.GAP : i])
        if len(chain) == spotsigs.CHAIN and (common[i] or odd):
            out.add(short(":".join([x, *chain])))
    return sorted(out or ({short(" ".join(w))} if w else set()))


def test_signatures_are_those_of_a_plain_loop(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + [None, "", "...", "the", "The of and", "word", "a b c the d e f", "x y z " * 9, "ÉTÉ the Été of ß und x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in spotsigs.with_signatures(docs, F.col("text"), "s").collect():
        assert r.s == plain_spots(r.text), r.text


def test_next_is_that_by_id_around_the_end(spark):
    rows = [(5 * k % 101, f"the text of {5 * k % 101} and more words") for k in range(101)]
    got = {r.doc_id: r.next_text for r in spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    text = dict(rows)
    assert got == {i: text[(i + 1) % 101] for i in range(101)}


def test_fingerprints_of_odd_rows(spark):
    one = spark.createDataFrame([(4, "alone", 1)], "doc_id long, text string, signatures int")
    (r,) = spotsigs.with_edited(spotsigs.with_next(one)).collect()
    assert (r.next_text, r.edited) == ("alone", "alona")
    assert spotsigs.with_next(one.limit(0)).collect() == []
    rows = [(None, "a x y"), (None, None), (3, "the same text here"), (3, "the same text here"), (9, "")]
    got = spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or -1, r.text) for r in got.collect()) == sorted((i or -1, t or "") for i, t in rows)
    like = got.select("text", spotsigs.likeness("signatures", "signatures").alias("x")).collect()
    assert all(r.x == 1.0 for r in like)


def test_near_pairs_are_all_pairs_of_enough_likeness(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = docs.where("doc_id < 30").select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat("text", F.lit(" and one more ending")).alias("text"))
    docs = docs.unionByName(extra)
    spots = {r.doc_id: frozenset(plain_spots(r.text)) for r in docs.collect()}
    name = {}
    for i in sorted(spots):
        name.setdefault(spots[i], i)
    member, pairs = spotsigs.near_pairs(docs)
    assert {r.doc_id: r.set_id for r in member.collect()} == {i: name[s] for i, s in spots.items() if s}
    sets = sorted((i, s) for s, i in name.items() if s)
    want = {(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[k + 1 :] if len(s & t) >= 0.75 * len(s | t)}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
