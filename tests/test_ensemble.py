"""Spans of two sources against a plain loop, in the order in which they come."""

import random

from marlstone.operators import ensemble

OUTSIDE = "id long, n int, start int, end int, type string, score double, validated boolean, boost double"
ENTITIES = "array<struct<start:int,end:int,type:string,score:double,reasons:array<string>>>"


def plain(taken, more):
    out = []
    for i, spans in taken.items():
        done = [[s, e, t, x, 0, "recognised"] for s, e, t, x in spans]
        for _, _, s, e, t, score, ok, boost in sorted((m for m in more if m[0] == i), key=lambda m: m[1]):
            x = round(min(0.45 * (1.0 if ok else 0.6) + 0.35 * (score or 0) + 0.2 * (boost or 0), 0.99), 3)
            met = [m for m in done if m[0] < e and s < m[1]]
            for m in met:
                m[4] += 1
                m[3] = max(m[3], 0.9 * x) if x > m[3] else m[3]
            if not met and e > s:
                done.append([s, e, t, x, 0, "outside"])
        out += [(i, *m) for m in done]
    return sorted((i, s, e, t, round(x, 9), n, stage) for i, s, e, t, x, n, stage in out)


def test_spans_are_those_of_a_plain_loop(spark):
    rng = random.Random(8)
    taken, more = {}, []
    for i in range(40):
        at, spans = 0, []
        for _ in range(rng.randint(0, 5)):
            at += rng.randint(0, 8)
            spans.append((at, at + 3, "EMAIL", rng.choice([0.5, 0.7, 0.9])))
            at += 3
        taken[i] = spans
        for n in range(rng.randint(0, 6)):
            s = rng.randint(0, 40)
            more.append((i, n, s, s + rng.randint(1, 6), "PERSON", rng.choice([0.1, 0.8, 1.0, None]), rng.choice([True, False, None]), rng.choice([0.0, 1.0, None])))
    rows = spark.createDataFrame([(i, [(s, e, t, x, ["r"]) for s, e, t, x in spans]) for i, spans in taken.items()], f"id long, entities {ENTITIES}")
    got = ensemble.together(rows, spark.createDataFrame(more, OUTSIDE)).collect()
    assert sorted((r.id, r.start, r.end, r.type, round(r.score, 9), r.reasons.count("outside agrees"), r.stage) for r in got) == plain(taken, more)


def test_odd_spans(spark):
    none = spark.createDataFrame([(1, None), (2, [])], f"id long, entities {ENTITIES}")
    outside = spark.createDataFrame([(None, 0, 0, 3, "PERSON", 0.5, True, 0.0), (2, 0, 5, 5, "PERSON", 0.5, True, 0.0), (7, 0, 1, 2, "PERSON", None, None, None), (7, 1, 1, 2, "PERSON", 0.5, True, 0.0)], OUTSIDE)
    (r,) = ensemble.together(none, outside).collect()
    assert (r.id, r.start, r.end, r.reasons) == (7, 1, 2, ["outside agrees"])
    many = spark.createDataFrame([(1, k, 3 * k, 3 * k + 2, "PERSON", 0.5, True, 0.0) for k in range(20_000)], OUTSIDE)  # one text, no cluster of more than one
    assert ensemble.together(none, many).count() == 20_000
    assert ensemble.together(none.limit(0), outside.limit(0)).collect() == []
