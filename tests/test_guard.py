import hashlib
import hmac
import re

from pyspark.sql import functions as F

from marlstone.functions.spans import finditer, merged
from marlstone.operators.guard import REDACTION, hmac_sha256, redacted, redactions, scan
from marlstone.operators.recognizers import EMAIL, MOBILE, PAN, SSS, normal_mobile

CASES = [
    ("SSS 12-3456789-0 ok", ["PH_SSS"], "BLOCK_ESCALATE"),
    ("Mobile 0917 123 4567", ["PH_MOBILE"], "REDACT_THEN_SEND"),
    ("GCash number 09181234567", ["GCASH_MOBILE"], "REDACT_THEN_SEND"),
    ("Account number: 0056-12345678", ["BANK_ACCOUNT"], "REDACT_THEN_SEND"),
    ("PAN 4539578763621486 CVV: 123 account no 1234-5678-99", ["CARD_PAN", "CARD_CVV", "BANK_ACCOUNT"], "BLOCK_ESCALATE"),
    ("invoice INV-2024-00001234", [], "SAFE_TO_SEND"),
    ("mail a.b@c.com and é d@e.org [EMAIL-AB12]", ["EMAIL", "EMAIL"], "REDACT_THEN_SEND"),
    ("monthly salary is PHP 45,000.00 per month", ["SALARY"], "REDACT_THEN_SEND"),
    ("passport no P1234567A", ["PASSPORT"], "REDACT_THEN_SEND"),
    ("born Jan 5, 1990", ["DATE_OF_BIRTH"], "REDACT_THEN_SEND"),
    ("TIN 123-456-789 tax", ["PH_TIN"], "BLOCK_ESCALATE"),
    ("1234-5678-9012-3456", ["PHILSYS_ID"], "REDACT_THEN_SEND"),
    ("western union ref: ABC12345", ["REMITTANCE_REF"], "REDACT_THEN_SEND"),
    ("PH12ABC1234567890", ["PH_IBAN"], "REDACT_THEN_SEND"),
    ("order 4539578763621487 shipped", [], "SAFE_TO_SEND"),
    ("", [], "SAFE_TO_SEND"),
    (None, [], "SAFE_TO_SEND"),
]


def test_scan(spark):
    rows = scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "id int, text string"), "key").orderBy("id").collect()
    for (text, types, verdict), r in zip(CASES, rows):
        assert ([e.type for e in r.entities], r.verdict, r.residual_leakage) == (types, verdict, 0), text
        for e in r.entities:
            assert text[e.start : e.end] == e.text and e.text not in r.redacted
    again = scan(spark.createDataFrame([(r.id, r.redacted) for r in rows if r.redacted], "id int, text string"), "key").collect()
    assert all(r.redacted == r.text for r in again)  # idempotent


def test_reasons_of_merged_spans(spark):
    rows = spark.sql("""SELECT array(
      named_struct('type', 'A', 'start', 0, 'end', 4, 'text', 'aaaa', 'score', 0.5D, 'validated', true, 'boost', 0D, 'reasons', array('z', 'b')),
      named_struct('type', 'B', 'start', 2, 'end', 9, 'text', 'bbbbbbb', 'score', 0.4D, 'validated', true, 'boost', 0D, 'reasons', array('a')),
      named_struct('type', 'C', 'start', 8, 'end', 9, 'text', 'c', 'score', 0.9D, 'validated', true, 'boost', 0D, 'reasons', array('b', 'c')),
      named_struct('type', 'D', 'start', 9, 'end', 10, 'text', 'd', 'score', 0.1D, 'validated', true, 'boost', 0D, 'reasons', array('d'))) AS s""")
    got = rows.select(merged(F.col("s")).alias("m")).first().m
    assert [(x.type, x.start, x.end, x.score, x.reasons) for x in got] == [("B", 2, 9, 0.9, ["a", "b", "c", "z"]), ("D", 9, 10, 0.1, ["d"])]


def test_spans_are_those_of_finditer(spark):
    texts = ["a@b.co, é😀 x.y@z.com!", "0917 123 4567 +639171234567", "4539-5787-6362-1486 123-45-6789", "", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (EMAIL, MOBILE, PAN, SSS):
        for t, r in zip(texts, df.select(finditer(F.col("t"), pattern).alias("s")).collect()):
            assert [(s.start, s.end, s.text) for s in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, t)]


def test_hmac(spark):
    for key in ("k", "k" * 80):
        got = spark.createDataFrame([("héllo",)], "a string").select(hmac_sha256(F.col("a"), key).alias("h")).first().h
        assert got == hmac.new(key.encode(), "héllo".encode(), hashlib.sha256).hexdigest()


def test_mobile_forms(spark):
    forms = {"0917 123 4567": "+639171234567", "+63 917 123 4567": "+639171234567", "9171234567": "+639171234567", "12345": None}
    rows = spark.createDataFrame([(k,) for k in forms], "t string").select("t", normal_mobile(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == forms


def test_redaction_map_leads_back_to_the_original(spark):
    """Places of both texts, over several passes; a later pass may take in an earlier replacement."""
    rows = scan(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "id int, text string"), "key", report=True).orderBy("id").collect()
    for (text, types, judged), r in zip(CASES, rows):
        assert [m.type for m in r.redaction_map] == types and (r.passes, r.verified_clean, r.verdict) == (1, True, judged)
        out, at = "", 0
        for m in r.redaction_map:
            assert r.redacted[m.out_start : m.out_end] == m.replacement and m.length == m.end - m.start and m["pass"] == 1
            out, at = out + text[at : m.start] + m.replacement, m.end
        assert text is None or out + text[at:] == r.redacted
        assert len(r.notes) == 1 and r.notes[0].endswith((".",))


def test_redaction_map_over_passes(spark):
    """A made-up second and third find: beside an earlier replacement, and reaching over it."""
    entity = "array<struct<type:string,start:int,end:int,text:string,score:double>>"
    text = "aa 123 bb 456 cc"
    row = spark.createDataFrame([(text, [("EMAIL", 3, 6, "123", 0.5), ("SALARY", 10, 13, "456", 0.25)])], f"text string, e {entity}")
    one = row.withColumn("m", redactions(F.array().cast(REDACTION), F.col("e"), "key", 1)).withColumn("r", redacted(F.col("text"), F.col("e"), "key")).first()
    assert [one.r[m.out_start : m.out_end] for m in one.m] == [m.replacement for m in one.m] and [text[m.start : m.end] for m in one.m] == ["123", "456"]
    bb, cc = one.r.index("bb"), one.r.index("cc")
    over = (one.m[1].out_start - 1, len(one.r))  # from before the second replacement to the text's end
    more = [("PASSPORT", bb, bb + 1, "b", 0.1), ("PH_SSS", *over, one.r[slice(*over)], 0.1)]
    two = spark.createDataFrame([(one.r, one.m, more)], f"text string, m {REDACTION}, e {entity}")
    two = two.withColumn("m", redactions(F.col("m"), F.col("e"), "key", 2)).withColumn("r", redacted(F.col("text"), F.col("e"), "key")).first()
    places = {(m.type, m["pass"]): (text[m.start : m.end], two.r[m.out_start : m.out_end]) for m in two.m}
    token = lambda t, p: next(m.replacement for m in two.m if (m.type, m["pass"]) == (t, p))
    assert places["EMAIL", 1] == ("123", token("EMAIL", 1)) and places["PASSPORT", 2] == ("b", token("PASSPORT", 2))
    assert places["PH_SSS", 2] == (" 456 cc", token("PH_SSS", 2)) and places["SALARY", 1] == ("456", token("PH_SSS", 2)) and cc > bb
