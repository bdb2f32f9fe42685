"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.spans import finditer
from ..operators import answer, chunking, guard, impact, ledger, metrics, retrieval, risk
from ..operators.rules import RULES
from ..sources import files

EMAIL_RUN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DIGIT_RUN = r"[0-9](?:[ -]?[0-9])*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Key of the pseudonyms of these queries; the tables hold invented people only.
KEY = "the catalogue's key is no secret"
# Tickets: each customer's number in one of these forms, so that what must be found follows from the key.
TICKET_TYPES = (
    ("PH_SSS",), ("PH_MOBILE",), ("GCASH_MOBILE",), ("BANK_ACCOUNT",), ("EMAIL",), (), ("PH_IBAN",), ("PH_TIN",), ("CARD_PAN", "CARD_CVV", "BANK_ACCOUNT"),
    ("REMITTANCE_REF",), ("PHILSYS_ID",), ("PASSPORT",), ("DATE_OF_BIRTH",), ("SALARY",), (), ("CARD_CVV",),
)
BLOCKED = (0, 7, 8)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, form, value, text): ``value`` is what stands for the first type of the form."""
    n = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    part = lambda a, b: F.substring(n, a, b)
    dashed = lambda *parts: F.concat_ws("-", *parts)
    forms = [
        ("SSS ", dashed(part(1, 2), part(3, 7), part(10, 1)), ""),
        ("Mobile ", F.concat(F.lit("0917 "), part(4, 3), F.lit(" "), part(7, 4)), ""),
        ("GCash number ", F.concat(F.lit("0918"), part(4, 7)), ""),
        ("Account number: ", F.concat(F.lit("0056-"), part(3, 8)), ""),
        ("mail ", F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")), " please"),
        ("invoice ", F.concat(F.lit("INV-2024-"), part(3, 8)), ""),
        ("to ", F.concat(F.lit("PH12ABC"), n), ""),
        ("TIN ", dashed(part(1, 3), part(4, 3), part(7, 3)), ""),
        ("PAN ", F.lit("4539578763621486"), " CVV: 123 account no 1234-5678-99"),
        ("western union ref: ", F.concat(F.lit("AB"), part(3, 8)), ""),
        ("", F.lit("1234-5678-9012-3456"), ""),
        ("passport no ", F.concat(F.lit("P"), part(4, 7), F.lit("A")), ""),
        ("born ", F.lit("Jan 5, 1990"), ""),
        ("monthly salary is PHP ", F.lit("45,000.00"), " per month"),
        ("order ", F.lit("4539578763621487"), " shipped"),
        ("cvv ", F.lit("123"), ""),
    ]
    form = (F.col("c_custkey") % len(forms)).cast("int")
    pick = lambda values: F.element_at(F.array(*values), form + 1)
    text = F.concat(pick([F.lit(a) for a, _, _ in forms]), pick([v for _, v, _ in forms]), pick([F.lit(z) for _, _, z in forms]))
    return table(spark, sf_dir, "customer").select("c_custkey", form.alias("form"), pick([v for _, v, _ in forms]).alias("value"), text.alias("text"))


# Narratives: each order tells one of these in its own words and numbers.
NARRATIVES = (
    "The customer split the deposit to stay below the threshold",
    "Funds came in and out on the same day and were sent overseas",
    "A student received cash from a stranger",
    "The caller claimed to be from the bank and asked for the OTP",
    "Please change the bank details as requested by email",
    "There was a screening hit on the watchlist",
    "They promise a guaranteed return per month",
    "The parcel never arrived from the online seller",
    "The customer cannot explain the source of funds",
    "A routine balance inquiry at the branch",
)


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*(F.lit(s) for s in NARRATIVES)), (F.col("o_orderkey") % len(NARRATIVES) + 1).cast("int"))
    text = F.concat(pick, F.lit(". Order "), F.col("o_orderkey").cast("string"), F.lit(", priority "), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


def pii_documents_verdict(spark, sf_dir):
    out = guard.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return out.select("doc_id", F.size("entities").alias("n_entities"), "verdict", "residual_leakage", F.sha2("redacted", 256).alias("redacted_sha256"))


def pii_email_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select("doc_id", F.explode(finditer(F.col("text"), EMAIL_RUN)).alias("s"))
    return spans.select("doc_id", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.col("s.text").alias("value"))


def pii_digit_runs_luhn(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select("doc_id", F.explode(finditer(F.col("text"), DIGIT_RUN)).alias("s"))
    digits = F.regexp_replace("s.text", "[ -]", "")
    ok = F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return spans.where(ok).select("doc_id", F.col("s.start").cast("long").alias("start_at"), digits.alias("digits"))


def pii_ticket_verdicts(spark, sf_dir):
    return guard.scan(tickets(spark, sf_dir), KEY).select("c_custkey", "verdict", F.coalesce(F.try_element_at("entities", F.lit(1))["type"], F.lit("NONE")).alias("entity_type"), F.size("entities").cast("long").alias("n_entities"))


def pii_ticket_redactions(spark, sf_dir):
    """The redacted ticket, and where each replacement stands in it and in the original."""
    out = guard.scan(tickets(spark, sf_dir), KEY, report=True)
    place = lambda m: F.concat_ws(":", m["type"], m["start"], m["end"], m["replacement"], m["out_start"], m["out_end"], m["pass"])
    return out.select("c_custkey", "redacted", F.array_join(F.transform("redaction_map", place), ";").alias("places"), "passes", "verified_clean", F.array_join("notes", " ").alias("note"))


def pii_type_counts(spark, sf_dir):
    return guard.type_counts(guard.scan(tickets(spark, sf_dir), KEY))


def pii_pseudonyms(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", guard.hmac_sha256(F.col("c_name"), "key").alias("mac"))


def risk_flags(spark, sf_dir):
    rows = risk.assess(narratives(spark, sf_dir)).select("o_orderkey", F.explode("flags").alias("f"))
    return rows.select("o_orderkey", F.col("f.id").alias("flag_id"), F.col("f.tier").alias("tier"), F.col("f.evidence").alias("evidence"))


def risk_assessments(spark, sf_dir):
    return risk.assess(narratives(spark, sf_dir)).select("o_orderkey", "tier", F.array_join("exposed", ",").alias("exposed"), "n_flags")


def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.html_text(F.col("html")), 256).alias("text_sha256"))


def page_lines(spark, sf_dir):
    """Pages with a line for each tag, cleaned of empty ones."""
    lines = F.filter(F.split(T.html_lines(F.col("html")), "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "pages").select("page_id", F.size(lines).cast("long").alias("n_lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("lines_sha256"))


def clean_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_lines(F.col("text")), 256).alias("text_sha256"), T.short_hash(F.col("text")).alias("short_hash"))


def token_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def term_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count_distinct("doc_id").alias("df"), F.count(F.lit(1)).alias("cf"))


def stems(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return rows.select("term", T.stem(F.col("term")).alias("stem"))


def _asked_terms(spark, sf_dir):
    return retrieval.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text", stemmed=False)


def _passages(spark, sf_dir):
    """The documents with the numbers that they name, and as kinds by their language."""
    kind = F.when(F.col("lang") == "en", "statute").when(F.col("lang") == "fr", "sop")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", kind.alias("kind"), T.section_tokens(F.col("text")).alias("numbers"))


def _numbers(asked):
    """(query_id, number) of texts (query_id, text)."""
    return asked.select("query_id", F.explode(T.section_tokens(F.col("text"))).alias("number"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark, sf_dir):
    best = retrieval.best(_asked_terms(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 5)
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


def bm25_pruned_topk(spark, sf_dir):
    """``bm25_topk`` from block maxima: passages that can't be among the best are not scored."""
    docs = table(spark, sf_dir, "documents")
    terms = retrieval.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text", stemmed=False)
    best = impact.best(impact.index(docs), terms, 5)
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


def hybrid_topk(spark, sf_dir):
    best = retrieval.best(_asked_terms(spark, sf_dir), _passages(spark, sf_dir), 5, numbers=_numbers(_items(spark, sf_dir)))
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


#: Ends every other question, so that some are in the domain.
ASIDE = " How long may we keep personal data and the CVV of a caller? The consent of both is 30 days old."


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.when(F.col("item_id") % 2 == 0, ASIDE).otherwise("")).alias("text"))


def _asked(spark, sf_dir):
    """The twelve best passages of each question, the questions, and the passages; every third passage says how long."""
    terms = retrieval.query_terms(questions(spark, sf_dir), "query_id", "text", stemmed=False)
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, ". Keep it for 30 days and no longer").otherwise(""))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", said.alias("said"), "doc_id", F.col("source").alias("section"))
    searched = docs.select("id", "text", F.lit("statute").alias("kind"), T.section_tokens(F.col("said")).alias("numbers"))
    ranked = retrieval.best(terms, searched, 12, numbers=_numbers(questions(spark, sf_dir)))
    return ranked, questions(spark, sf_dir), docs.select("id", F.col("said").alias("text"), "doc_id", "section")


def answered_questions(spark, sf_dir):
    out = answer.answers(*_asked(spark, sf_dir))
    return out.select("query_id", "refused", "reason", F.round("confidence", 6).alias("confidence"), F.coalesce(F.size("citations"), F.lit(0)).cast("long").alias("n_citations"), "scope_note")


def centroid_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("query_id"))
    mean = vectors.select("query_id", F.posexplode("embedding").alias("i", "x")).groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    best = retrieval.nearest(mean.select("query_id", F.col("centre").alias("v")), vectors.select("id", F.col("embedding").alias("v")), 5)
    return best.select(F.col("query_id").alias("label"), F.col("id").alias("vec_id"), "rank", "score")


def document_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(chunking.tags(F.col("text")), ",").alias("tags"))


def section_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.section_tokens(F.col("text"))).alias("number"))
    return rows


def corpus_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.count_distinct(F.sha2("text", 256)).alias("n_texts"))


def admitted_requests(spark, sf_dir):
    good, bad = files.admitted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return good.select("doc_id", F.lit("admitted").alias("state")).unionByName(bad.select("doc_id", F.col("reason").alias("state")))


def _chain(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), F.concat_ws(":", "event_id", "event_type").alias("payload"))
    return ledger.chained(rows)


def ledger_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select(F.col("ledger").alias("user_id"), "seq", "prev_hash", "entry_hash")


def ledger_verify(spark, sf_dir):
    """The chains with every entry altered whose seq a thousand divides: each breaks there first."""
    altered = _chain(spark, sf_dir).withColumn("payload", F.when(F.col("seq") % 1000 == 0, F.lit("altered")).otherwise(F.col("payload")))
    return ledger.verified(altered).select(F.col("ledger").alias("user_id"), "n", "broken_at")


def ledger_by_event(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_seq"))


def event_changes(spark, sf_dir):
    rows = ledger.changes(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")
    return rows.select("user_id", "event_id", "event_type", "previous", "changed")


def label_precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    rows = rows.withColumn("predicted", (~F.col("text").rlike(r"###|\*\*\*|!! | \| ")).cast("int"))
    out = metrics.precision_recall(rows, "quality", "predicted", ["lang"])
    return out.select("lang", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def value_quantiles(spark, sf_dir):
    out = metrics.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "n", "p50", "p95", F.round("mean", 6).alias("mean"))


def reciprocal_ranks(spark, sf_dir):
    best = retrieval.best(_asked_terms(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 20)
    hits = best.join(table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id")), "id")
    out = metrics.reciprocal_rank(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), hits)
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "mrr")))


def manifest_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("c_acctbal"))
    return files.upsert(new, old, "c_custkey", ["c_mktsegment", "c_acctbal"])


def priority_sets(spark, sf_dir):
    """Priorities that a customer's finished orders have and the open ones lack, those in both, and all."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("f"), F.collect_set(F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))).alias("o"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select("o_custkey", text(F.array_except("f", "o")).alias("only_finished"), text(F.array_intersect("f", "o")).alias("both"), text(F.array_union("f", "o")).alias("either"), (F.size(F.array_except("o", "f")) == 0).alias("covers"))


def claimed_spans(spark, sf_dir):
    """Digit runs of a document that meet no e-mail address of it: an anti join on overlap within the document."""
    mail, runs = pii_email_spans(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", F.explode(finditer(F.col("text"), DIGIT_RUN)).alias("s"))
    runs = runs.select("doc_id", F.col("s.start").cast("long").alias("s"), F.col("s.end").cast("long").alias("e"))
    meets = (runs.doc_id == mail.doc_id) & (runs.s < mail.end_at) & (mail.start_at < runs.e)
    free = runs.join(mail, meets, "left_anti")
    return free.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_free"), F.min("s").alias("first_at"))


TICKETS_SQL = f"WITH t AS (SELECT c_custkey, c_custkey % {len(TICKET_TYPES)} AS form, ([" + ", ".join("[" + ", ".join(f"'{x}'" for x in types) + "]" for types in TICKET_TYPES) + f"]::VARCHAR[][])[c_custkey % {len(TICKET_TYPES)} + 1] AS types FROM customer)"
# What a ticket's form says before, between and after the identifiers, each written from the key n as ten digits.
TICKET_PARTS = (
    ("SSS ", "n[1:2] || '-' || n[3:9] || '-' || n[10:10]", ""), ("Mobile ", "'0917 ' || n[4:6] || ' ' || n[7:10]", ""), ("GCash number ", "'0918' || n[4:10]", ""), ("Account number: ", "'0056-' || n[3:10]", ""),
    ("mail ", "'c' || c_custkey || '@example.com'", " please"), ("invoice INV-2024-", "", ""), ("to ", "'PH12ABC' || n", ""), ("TIN ", "n[1:3] || '-' || n[4:6] || '-' || n[7:9]", ""),
    ("PAN ", "'4539578763621486'", " CVV: ", "'123'", " account no ", "'1234-5678-99'", ""), ("western union ref: ", "'AB' || n[3:10]", ""), ("", "'1234-5678-9012-3456'", ""), ("passport no ", "'P' || n[4:10] || 'A'", ""),
    ("born ", "'Jan 5, 1990'", ""), ("monthly salary is PHP ", "'45,000.00'", " per month"), ("order 4539578763621487 shipped", "", ""), ("cvv ", "'123'", ""),
)
_PADS = ["".join(f"{b ^ pad:02x}" for b in KEY.encode().ljust(64, b"\0")) for pad in (0x5C, 0x36)]
_LIST = lambda rows: "[" + ", ".join("[" + ", ".join(r) + "]" for r in rows) + "]"
REDACTED_SQL = (
    "WITH k AS (SELECT c_custkey, c_custkey % 16 + 1 AS f, lpad(c_custkey::VARCHAR, 10, '0') AS n FROM customer),\n"
    f"v AS (SELECT c_custkey, f, n, {_LIST([[f'$${x}$$' for x in p[::2]] for p in TICKET_PARTS])}[f] AS said, "
    + _LIST([[x or "''" for x in p[1::2]] for p in TICKET_PARTS]) + f"[f] AS v, {[list(t) or [''] for t in TICKET_TYPES]}[f] AS types FROM k),\n"
    + "w AS (SELECT *, CASE WHEN f = 6 THEN [n[3:10]] ELSE v END AS values FROM v),\n"
    + f"m AS (SELECT *, list_transform(range(1, len(types) + 1), lambda i: CASE WHEN types[i] = '' THEN values[i] ELSE '[' || coalesce(map({list(guard.TAGS)}, {list(guard.TAGS.values())})[types[i]], 'REDACTED') || '-' "
    + f"|| upper(left(sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode(values[i])))), 4)) || ']' END) AS tokens FROM w),\n"
    + "a AS (SELECT *, list_transform(range(1, len(types) + 1), lambda i: list_sum(list_transform(said[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(values[1:i - 1], lambda x: length(x))), 0)::BIGINT) AS s,\n"
    + "  list_transform(range(1, len(types) + 1), lambda i: list_sum(list_transform(said[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(tokens[1:i - 1], lambda x: length(x))), 0)::BIGINT) AS o FROM m)\n"
    + "SELECT c_custkey, said[1] || array_to_string(list_transform(range(1, len(types) + 1), lambda i: tokens[i] || said[i + 1]), '') AS redacted,\n"
    + "  CASE WHEN types[1] = '' THEN '' ELSE array_to_string(list_transform(range(1, len(types) + 1), lambda i: types[i] || ':' || s[i] || ':' || s[i] + length(values[i]) || ':' || tokens[i] || ':' || o[i] || ':' || o[i] + length(tokens[i]) || ':1'), ';') END AS places,\n"
    + "  1 AS passes, true AS verified_clean, CASE WHEN types[1] = '' THEN 'No regulated identifier was found.' WHEN f = 9 THEN 'A card number stands with its CVV and an account or national number: all that a payment needs.'\n"
    + "  WHEN types[1] IN ('PH_SSS', 'PH_TIN') THEN 'A national number (SSS or TIN) is present.' ELSE '1 identifier replaced, and the text read again: ' || types[1] || '.' END AS note FROM a"
)
SPANS_SQL = """
WITH p AS (SELECT doc_id, regexp_extract_all(text, '{0}') AS m, string_split_regex(text, '{0}') AS g FROM documents),
i AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM p WHERE len(m) > 0),
s AS (SELECT doc_id, m[i] AS value, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start_at FROM i)
"""
TOKENS_SQL = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOPWORDS if " " not in w) + "], t))"


def clean_sql(column: str) -> str:
    x = f"replace(replace({column}, chr(13) || chr(10), chr(10)), chr(160), ' ')"
    for _ in range(2):  # a letter may stand between two of them
        x = rf"regexp_replace({x}, '([A-Za-z])\x{{FFFD}}([A-Za-z])', '\1’\2', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '\x{{FFFD}}', '—', 'g'), '[ \t\r\f\v]+(\n|$)', '\1', 'g')"
    x = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_full_match(l, '{T.NOISE_LINE}')), chr(10))"
    return strip_sql(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def strip_sql(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def _rule_sql(patterns: tuple[str, ...]) -> str:
    tries = ", ".join("nullif(regexp_extract(text, '{}', 0, 'i'), '')".format(p.replace("'", "''")) for p in patterns)
    return f"trim(coalesce({tries}))"


NARRATIVES_SQL = "WITH t AS (SELECT o_orderkey, ([" + ", ".join(f"'{s}'" for s in NARRATIVES) + f"])[o_orderkey % {len(NARRATIVES)} + 1] || '. Order ' || o_orderkey || ', priority ' || o_orderpriority AS text FROM orders),\nf AS (" + "\nUNION ALL ".join(f"SELECT o_orderkey, '{r[0]}' AS flag_id, '{r[1]}' AS tier, {risk.SEVERITY[r[1]]} AS severity, '{r[2][0]}' AS party, {_rule_sql(r[5])} AS evidence FROM t" for r in RULES) + ")"


def _stem_sql(column: str) -> str:
    cases = []
    for s in T.SUFFIXES:
        base = f"left({column}, length({column}) - {len(s)})"
        base = f"{base} || 'y'" if s == "ies" else f"regexp_replace({base}, 'r$', '')" if s in ("ations", "ation", "ions", "ion") else base
        cases.append(f"WHEN {column} LIKE '%{s}' AND length({column}) - {len(s)} >= 4 THEN {base}")
    return f"CASE WHEN length(term) < 5 OR regexp_full_match(term, '[0-9]+') THEN {column} {' '.join(cases)} ELSE {column} END"


BM25_SQL = f"""
WITH d AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1),
n AS (SELECT count(*) AS n FROM documents),
a AS (SELECT sum(tf) / (SELECT n FROM n) AS a FROM p),
i0 AS (SELECT term, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p GROUP BY 1),
i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
q AS (SELECT item_id, term, count(*) AS w FROM (SELECT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark) GROUP BY 1, 2),
b AS (SELECT item_id, doc_id, sum(w * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT a FROM a)))) AS bm25
  FROM q JOIN i USING (term) JOIN p USING (term) JOIN l USING (doc_id) GROUP BY 1, 2)
"""
SECTION_SQL = r"""list_distinct(list_filter(list_concat(
  list_transform(regexp_extract_all({0}, '(?i)\b(?:npc\s*(?:circular|advisory|memorandum|memo)?|circular|advisory|memorandum|dsa|dpa|irr|bsp|morb|ra)\s*\.?\s*((?:no\.?\s*)?\d{{1,4}}[-–][0-9]{{2,4}}|\d{{2,4}})\b', 1),
    lambda x: ltrim(regexp_replace(replace(x, '–', '-'), '[^0-9-]', '', 'g'), '0')),
  regexp_extract_all({0}, '\b\d{{4,5}}\b')), lambda x: x <> ''))"""

SQL = {
    "pii_email_spans": SPANS_SQL.format(EMAIL_RUN.replace("{2,}", "{{2,}}").replace("{{", "{").replace("}}", "}")) + "SELECT doc_id, start_at, start_at + length(value) AS end_at, value FROM s",
    "pii_digit_runs_luhn": SPANS_SQL.format(DIGIT_RUN) + """, c AS (SELECT doc_id, start_at, regexp_replace(value, '[ -]', '', 'g') AS digits FROM s)
SELECT doc_id, start_at, digits FROM c WHERE length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(digits)),
  lambda i: CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INTEGER ELSE 2 * digits[length(digits) - i]::INTEGER - CASE WHEN digits[length(digits) - i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0""",
    "pii_ticket_verdicts": f"""{TICKETS_SQL}
SELECT c_custkey, CASE WHEN form IN {BLOCKED} THEN 'BLOCK_ESCALATE' WHEN len(types) = 0 THEN 'SAFE_TO_SEND' ELSE 'REDACT_THEN_SEND' END AS verdict,
  coalesce(types[1], 'NONE') AS entity_type, len(types)::BIGINT AS n_entities FROM t""",
    "pii_ticket_redactions": REDACTED_SQL,
    "pii_type_counts": f"{TICKETS_SQL} SELECT type, count(*) AS n FROM (SELECT unnest(types) AS type FROM t) GROUP BY 1",
    "pii_pseudonyms": "SELECT c_custkey, sha256(unhex('{}') || unhex(sha256(unhex('{}') || encode(c_name)))) AS mac FROM customer".format(*("".join(f"{b ^ pad:02x}" for b in b"key".ljust(64, b"\0")) for pad in (0x5C, 0x36))),
    "risk_flags": NARRATIVES_SQL + "\nSELECT o_orderkey, flag_id, tier, evidence FROM f WHERE evidence IS NOT NULL",
    "risk_assessments": NARRATIVES_SQL + """
, h AS (SELECT * FROM f WHERE evidence IS NOT NULL),
x AS (SELECT o_orderkey, arg_max(tier, severity) AS tier, count(*) AS n, bool_or(party IN ('bank', 'both')) AS b, bool_or(party IN ('customer', 'both')) AS c FROM h GROUP BY 1)
SELECT o_orderkey, coalesce(tier, 'none') AS tier, CASE WHEN b AND c THEN 'bank,customer' WHEN b THEN 'bank' WHEN c THEN 'customer' ELSE '' END AS exposed, coalesce(n, 0)::BIGINT AS n_flags
FROM t LEFT JOIN x USING (o_orderkey)""",
    "html_text": r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_sha256 FROM pages""",
    "page_lines": r"""WITH l AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS l FROM pages)
SELECT page_id, len(l)::BIGINT AS n_lines, sha256(array_to_string(l, chr(10))) AS lines_sha256 FROM l""",
    "clean_lines": f"SELECT doc_id, sha256({clean_sql('text')}) AS text_sha256, left(sha256(text), 16) AS short_hash FROM documents",
    "token_counts": f"WITH t AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM t",
    "term_statistics": f"WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1",
    "stems": f"WITH t AS (SELECT DISTINCT unnest({TOKENS_SQL}) AS term FROM conversations), a AS (SELECT term, {_stem_sql('term')} AS s1 FROM t), b AS (SELECT term, {_stem_sql('s1')} AS s2 FROM a) SELECT term, {_stem_sql('s2')} AS stem FROM b",
    "bm25_topk": BM25_SQL + ", r AS (SELECT item_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id)::INTEGER AS rank FROM b) SELECT item_id, doc_id, rank, score FROM r WHERE rank <= 5",
    "hybrid_topk": BM25_SQL + f""", ds AS (SELECT doc_id, unnest({SECTION_SQL.format('text')}) AS x FROM documents),
qs AS (SELECT item_id, unnest({SECTION_SQL.format('text')}) AS x FROM benchmark),
s AS (SELECT DISTINCT item_id, doc_id, 1.0::DOUBLE AS section FROM qs JOIN ds USING (x)),
m AS (SELECT item_id, doc_id, bm25 / max(bm25) OVER (PARTITION BY item_id) AS bm FROM b),
h AS (SELECT coalesce(m.item_id, s.item_id) AS item_id, coalesce(m.doc_id, s.doc_id) AS doc_id, coalesce(greatest(bm, 0), 0) AS bm, coalesce(section, 0) AS section FROM m FULL JOIN s ON m.item_id = s.item_id AND m.doc_id = s.doc_id),
k AS (SELECT item_id, doc_id, round(CASE lang WHEN 'en' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END * (0.625::DOUBLE * bm + 0.375::DOUBLE * section), 6) AS score FROM h JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM k)
SELECT item_id, doc_id, rank, score FROM r WHERE rank <= 5""",
    "centroid_topk": """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY 1, 2),
s AS (SELECT c.label, vec_id, round(sum(x * c), 6) AS score FROM x JOIN c USING (i) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT label, vec_id, rank, score FROM r WHERE rank <= 5""",
    "document_tags": "SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{c}')" for c in cues) + f" THEN '{t}' END" for t, cues in chunking.TAGS.items()) + "], lambda x: x IS NOT NULL), ',') AS tags FROM documents",
    "section_numbers": f"SELECT doc_id, unnest({SECTION_SQL.format('text')}) AS number FROM documents",
    "corpus_totals": "SELECT source, lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, count(DISTINCT text) AS n_texts FROM documents GROUP BY 1, 2",
    "admitted_requests": "SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) = 0 THEN 'empty' WHEN length(text) > 20000 THEN 'too long' ELSE 'admitted' END AS state FROM documents",
    "ledger_chain": """WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, event_id || ':' || event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, seq, n, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || payload) AS entry_hash FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.seq, e.n, c.entry_hash, sha256(c.entry_hash || '|' || e.payload) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)
SELECT user_id, seq, prev_hash, entry_hash FROM c""",
    "ledger_verify": "SELECT user_id, count(*) AS n, min(CASE WHEN event_id % 1000 = 0 THEN event_id END) AS broken_at FROM events GROUP BY 1",
    "ledger_by_event": "SELECT event_type, count(*) AS n, max(event_id) AS last_seq FROM events GROUP BY 1",
    "event_changes": """WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS previous, row_number() OVER w > 1 AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, event_type, previous, changed FROM x WHERE NOT changed OR previous IS DISTINCT FROM event_type""",
    "label_precision_recall": r"""WITH x AS (SELECT lang, quality = 1 AS e, NOT regexp_matches(text, '###|\*\*\*|!! | \| ') AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM x GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS a, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS b FROM c)
SELECT lang, tp, fp, fn, round(a, 6) AS precision, round(b, 6) AS recall, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 6) AS f1 FROM r""",
    "value_quantiles": """WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = greatest(0, floor(0.95::DOUBLE * n)::BIGINT - 1) THEN value END) AS p95, round(avg(value), 6) AS mean FROM x GROUP BY 1""",
    "reciprocal_ranks": BM25_SQL + """, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM b),
f AS (SELECT item_id, min(rank) AS rank FROM r JOIN documents USING (doc_id) WHERE rank <= 20 AND lang = 'en' GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS recall_3, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM benchmark LEFT JOIN f USING (item_id)""",
    "manifest_upsert": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer",
    "priority_sets": """WITH x AS (SELECT o_custkey, coalesce(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F'))), []) AS f, coalesce(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus <> 'F'))), []) AS o FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_filter(f, lambda p: NOT list_contains(o, p)), ',') AS only_finished, array_to_string(list_filter(f, lambda p: list_contains(o, p)), ',') AS both,
  array_to_string(list_sort(list_distinct(list_concat(f, o))), ',') AS either, len(list_filter(o, lambda p: NOT list_contains(f, p))) = 0 AS covers FROM x""",
    "claimed_spans": (SPANS_SQL.format(DIGIT_RUN) + ", r AS (SELECT doc_id, start_at AS s, start_at + length(value) AS e FROM s), " + SPANS_SQL.format(EMAIL_RUN).strip().removeprefix("WITH ").replace("p AS", "p2 AS").replace("i AS", "i2 AS", 1).replace("s AS (", "s2 AS (").replace("FROM p ", "FROM p2 ").replace("FROM i)", "FROM i2)")
        + " SELECT doc_id, count(*) AS n_free, min(s) AS first_at FROM r WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.doc_id = r.doc_id AND r.s < s2.start_at + length(s2.value) AND s2.start_at < r.e) GROUP BY 1"),
}

QUERIES = (
    pii_documents_verdict, pii_email_spans, pii_digit_runs_luhn, pii_ticket_verdicts, pii_ticket_redactions, pii_type_counts, pii_pseudonyms, risk_flags, risk_assessments, html_text, page_lines, clean_lines,
    token_counts, term_statistics, stems, bm25_topk, bm25_pruned_topk, hybrid_topk, answered_questions, centroid_topk, document_tags, section_numbers,
    corpus_totals, admitted_requests, ledger_chain, ledger_verify, ledger_by_event, event_changes, label_precision_recall, value_quantiles, reciprocal_ranks, manifest_upsert,
    priority_sets, claimed_spans,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import corpus, scores

    return {f.__name__: f for f in (*QUERIES, *corpus.QUERIES, *scores.QUERIES)}


def oracle_sql() -> dict[str, str]:
    from . import corpus, scores

    return SQL | {"bm25_pruned_topk": SQL["bm25_topk"]} | corpus.SQL | scores.SQL
