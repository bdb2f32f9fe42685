"""Terms that give an identifier away, against the formula on a small table."""

import os
import re
from collections import Counter, defaultdict
from math import log2

from pyspark.sql import functions as F

from marlstone.llm import pii

SF = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")


def test_identifiers_seen_once_or_in_copies(spark):
    """All counts are in different texts, without a least number of them; copies change nothing."""
    texts = [f"plain words number{i} here" for i in range(60)]
    texts += ["ask zarquon under ann@one.example or here", "zarquon alone", "first xylem bob@two.example", "first xylem cid@two.example yes"]
    word = lambda t: set(re.findall("[a-z0-9]+", t))
    n = len(texts)

    def share(term, name):
        has = [t for t in texts if name in t]
        return log2(n * sum(term in word(t) for t in has) / (sum(term in word(t) for t in texts) * len(has))) / log2(n / len(has))

    assert 0.6 <= share("zarquon", "ann@one.example") < 0.9 <= share("xylem", "@two.example") and share("here", "ann@one.example") < 0.6
    for copies in (1, 40):
        rows = [(i, t) for i, t in enumerate(texts + [texts[60]] * (copies - 1) + [texts[61]] * (copies - 1))]
        out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out[60].text == " [WORD]  [EMAIL] or here" and out[61].text == "zarquon alone"
        assert "xylem" not in out[62].text and "xylem" not in out[63].text
        assert all(out[i].text == t for i, t in rows[:60])
        assert all(out[i].text == out[60].text for i, t in rows if t == texts[60])


def test_frequency_of_copies(spark):
    docs = spark.createDataFrame([(pii.ONE // 2, "a b a"), (pii.ONE // 2, "a b a"), (pii.ONE, "b"), (pii.ONE, None)], "weight long, text string")
    keys = {t: int(pii._term_keys([t]).astype("int64")[0]) for t in "abc"}
    got = {r.key: r.documents for r in pii.document_frequency(docs, spark.createDataFrame([(k,) for k in keys.values()], "key long")).collect()}
    assert got == {keys["a"]: 1, keys["b"]: 2, keys["c"]: 0}


def test_company_is_read_past_long_words(spark):
    long = "y" * 300
    text = f"one two six ten {long} {'-' * 300} red ann@one.example - {'=' * 300} {long}z tea"
    got = {r.term for r in pii.company(spark.createDataFrame([(1, 1, text)], "id long, mark long, text string").select("mark", "text")).collect()}
    assert got == {None, "one", "two", "six", "ten", long, "red", f"{long}z", "tea"}


def test_short_words_count_where_they_are_asked_for(spark):
    rows = [(i, f"plain words {i}") for i in range(60)] + [(60, "qz ann@one.example"), (61, "no qx here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df, shortest=1).collect()}
    assert out[60].strip() == "[EMAIL]" and out[61] == "no qx here"
    assert pii.sanitise(df).where("doc_id = 60").first().text == "qz [EMAIL]"


def test_terms_of_a_whole_table(spark):
    """All spans of all documents, against counts in plain Python, with copies, and with other kinds of identifiers put in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(10_000 + i, f"{w} said mail u{i % 7}@dom{i % 3}.example or 10.{i % 2}.0.{i} with a {w}") for i, w in enumerate(["kestrel", "ab", "o", "kestrel", "plinth", "ünder", "42"] * 4)]
    docs = docs.unionByName(spark.createDataFrame(extra + [(20_000, extra[3][1]), (20_001, None)], "doc_id long, text string"))
    rows = docs.collect()
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.translate(pii.UPPER))
    whose, with_term, pairs, kept = Counter(), Counter(), Counter(), {}
    for text in {r.text or "" for r in rows}:
        names, company = set(), set()
        for s, k, e in pii.base_spans(text):
            # words that end before the identifier or begin after it; one that is cut by its edge is neither
            before = [m.group() for m in re.finditer(pii.TERM, text.translate(pii.UPPER)) if m.end() <= s][-pii.COMPANY :]
            after = [m.group() for m in re.finditer(pii.TERM, text.translate(pii.UPPER)) if m.start() >= e][: pii.COMPANY]
            for name in pii.groups(pii.identity(text, (s, k, e))):
                names.add(name)
                company |= {(name, t) for t in before + after if len(t) >= pii.SHORTEST}
        whose.update(names)
        pairs.update(company)
        with_term.update(set(word(text)))
        kept[text] = names
    n, discloses = len(kept), defaultdict(dict)
    for (name, t), both in pairs.items():
        if whose[name] < n and (share := log2(n * both / (max(with_term[t], both) * whose[name])) / log2(n / whose[name])) >= pii.GENERALISE:
            discloses[name][t] = share
    got = {r.doc_id: r.spans for r in pii.sanitise(docs, with_text=False).collect()}
    terms = 0
    for r in rows:
        text = r.text or ""
        base = pii.base_spans(text)
        gone = {t for name in kept[text] for t in discloses[name]}
        found = [(m.start(), len(pii.KINDS), m.end()) for m in re.finditer(pii.TERM, text.translate(pii.UPPER)) if m.group() in gone]
        found = [x for x in found if not any(s < x[2] and x[0] < e for s, _, e in base)]
        terms += len(found)
        assert got[r.doc_id] == pii.listed(sorted(base + found)), r.doc_id
    assert terms > 50


def test_a_text_of_very_many_identifiers(spark):
    """Ten thousand identifiers and as many words in one text: rows in proportion to it, not to their product."""
    text = " ".join(f"word{i} u{i}@d{i}.example" for i in range(10_000))
    docs = spark.createDataFrame([(1, text)] + [(i, f"plain words {i}") for i in range(2, 40)], "doc_id long, text string").withColumn("mark", F.xxhash64("text"))
    near = pii.company(docs.select("mark", "text")).persist()
    held = pii.inside(docs).persist()
    given = pii.disclosures(docs.select("mark", "text"), near, pii.GENERALISE).persist()
    met = held.select(F.explode("keys").alias("key")).join(given, "key").count()
    assert near.count() < 26 * 2 * 10_000 and met == given.count() < 26 * 2 * 10_000
    out = pii.sanitise(docs.drop("mark"), with_text=True).where("doc_id = 1").first()
    assert out.n_email == 10_000 and "word" not in out.text and "@" not in out.text
