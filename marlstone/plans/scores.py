"""Queries that score recognition and screening against labels, and reports of risk, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble, guard, metrics, risk
from ..operators.rules import RULES
from ..sources.scratch import written
from .catalogue import KEY, NARRATIVES, NARRATIVES_SQL, REDACTED_SQL, TICKET_TYPES, TICKETS_SQL, TOKENS_SQL, narratives, table, tickets

# What each narrative was written to trip: typologies, tier, exposed parties.
EXPECTED = (
    (("structuring",), "high", ("bank",)),
    (("rapid_passthrough", "cross_border_to_unusual_counterparty"), "high", ("bank", "customer")),
    (("mule_account",), "critical", ("bank", "customer")),
    (("credential_solicitation", "impersonation_social_engineering"), "critical", ("bank", "customer")),
    (("payment_detail_change_by_instruction",), "high", ("bank",)),
    (("sanctions_or_hit",), "critical", ("bank",)),
    (("investment_promise",), "high", ("customer",)),
    (("merchant_side_deception",), "medium", ("customer",)),
    (("no_source_documentation",), "high", ("bank",)),
    ((), "none", ()),
)
#: Documents of the corpus stand for these laws by their numbers; one that rules name is left out.
LAWS = ("RA-9160", "RA-10173", "RA-8792", "another")
SAID = " Covered   Transaction; true identity of its clients; electronic data message"


def _gold(spark, sf_dir):
    """Expected and found spans of the tickets; every seventh label is wrong."""
    rows = tickets(spark, sf_dir)
    types = F.array(*(F.lit(t[0] if t else None).cast("string") for t in TICKET_TYPES))
    value = F.when(F.col("c_custkey") % 7 == 0, "zzz").otherwise(F.col("value"))
    expected = rows.select("c_custkey", F.element_at(types, F.col("form") + 1).alias("type"), value.alias("value")).where("type IS NOT NULL")
    found = guard.entity_rows(guard.scan(rows, KEY), "c_custkey").select("c_custkey", "e.type", "e.text")
    return expected, written(found, "found")


def span_scores(spark, sf_dir):
    expected, found = _gold(spark, sf_dir)
    out = metrics.by_type(metrics.span_hits(expected, found, "c_custkey"), metrics.wrong_finds(expected, found, "c_custkey"))
    return out.select("type", "support", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def span_macro_f1(spark, sf_dir):
    expected, found = _gold(spark, sf_dir)
    out = metrics.macro_f1(metrics.by_type(metrics.span_hits(expected, found, "c_custkey"), metrics.wrong_finds(expected, found, "c_custkey")))
    return out.select(F.round("macro_f1", 6).alias("macro_f1"), "n_types")


def clean_negatives(spark, sf_dir):
    """Tickets without personal data, and how many of them came out changed."""
    rows = guard.scan(tickets(spark, sf_dir).where(F.col("form").isin([i for i, t in enumerate(TICKET_TYPES) if not t])), KEY)
    return rows.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("redacted") != F.col("text")).alias("violations"), F.sum("residual_leakage").alias("leaks"))


def span_reasons(spark, sf_dir):
    rows = guard.entity_rows(guard.scan(tickets(spark, sf_dir), KEY), "c_custkey")
    return rows.select("c_custkey", F.col("e.type").alias("type"), F.array_join("e.reasons", ",").alias("reasons"), "e.score")


def ensemble_spans(spark, sf_dir):
    """Recognised spans of the tickets with those of an outside model: the first words of each, and some behind its end."""
    rows = guard.scan(tickets(spark, sf_dir), KEY).select(F.col("c_custkey").alias("id"), "entities", "text")
    span = lambda n, start, end, kind, score, valid, boost: F.struct(F.lit(n).alias("n"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("type"), F.lit(score).alias("score"), F.lit(valid).alias("validated"), F.lit(boost).cast("double").alias("boost"))
    size = F.length("text")
    more = F.array(span(0, F.lit(0), F.lit(3), "PERSON", 0.9, False, None), span(1, F.lit(2), F.lit(8), "ADDRESS", 1.0, True, 1.0), span(2, size + 5, F.when(F.col("c_custkey") % 5 == 0, size + 9).otherwise(size), "PERSON", 0.5, False, 0.0))
    outside = tickets(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.explode(more).alias("x")).select("id", "x.*")
    out = ensemble.together(rows, outside)
    return out.select(F.col("id").alias("c_custkey"), "start", "end", "type", F.round("score", 6).alias("score"), F.size(F.filter("reasons", lambda x: x == "outside agrees")).alias("n_agree"), "stage")


def scenario_scores(spark, sf_dir):
    pick = (F.col("o_orderkey") % len(NARRATIVES) + 1).cast("int")
    of = lambda values: F.element_at(F.array(*values), pick)
    strings = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    severity = F.create_map(*(F.lit(x) for pair in risk.SEVERITY.items() for x in pair))
    rows = risk.assess(narratives(spark, sf_dir)).select(
        F.transform("flags", lambda f: f["id"]).alias("found"), F.element_at(severity, F.col("tier")).alias("severity"), "exposed",
        of([strings(e[0]) for e in EXPECTED]).alias("expected"), of([F.lit(risk.SEVERITY[e[1]]) for e in EXPECTED]).alias("expected_severity"),
        of([strings(e[2]) for e in EXPECTED]).alias("expected_exposed"), of([F.lit(not e[0]) for e in EXPECTED]).alias("negative"),
    )
    out = metrics.scenario_scores(rows)
    return out.select("n", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "tier_accuracy", "exposure_accuracy", "false_positive_rate")))


def _chunks(spark, sf_dir):
    law = F.element_at(F.array(*(F.lit(x) for x in LAWS)), (F.col("doc_id") % len(LAWS) + 1).cast("int"))
    text = F.concat("text", F.when(F.col("doc_id") % 7 == 0, SAID).otherwise(""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), law.alias("doc_id"), text.alias("text"), F.col("doc_id").alias("rank"))


def risk_citations(spark, sf_dir):
    out = risk.cited(risk.assess(narratives(spark, sf_dir)), _chunks(spark, sf_dir), "o_orderkey")
    return out.select(F.col("id").alias("o_orderkey"), F.col("flag").alias("flag_id"), "doc_id", "chunk_id", "exact", "degraded")


def risk_searched_citations(spark, sf_dir):
    """Citations from the twenty best passages for each anchor, with what is quoted."""
    chunks = _chunks(spark, sf_dir).withColumnRenamed("rank", "number")
    out = risk.citations(risk.assess(narratives(spark, sf_dir)), chunks, "o_orderkey")
    return out.select(F.col("id").alias("o_orderkey"), F.col("flag").alias("flag_id"), "doc_id", "chunk_id", "exact", "degraded", "score", F.sha2("quote", 256).alias("quote_sha256"), F.sha2("excerpt", 256).alias("excerpt_sha256"))


def risk_reports(spark, sf_dir):
    out = risk.reports(risk.assess(narratives(spark, sf_dir)), _chunks(spark, sf_dir), "o_orderkey")
    return out.select(F.col("id").alias("o_orderkey"), "tier", "n_flags", "n_citations", "n_gaps", "degraded", F.array_join("actions", " ").alias("actions"), "summary")


def missing_anchors(spark, sf_dir):
    return risk.missing_anchors(_chunks(spark, sf_dir))


QUERIES = (span_scores, span_macro_f1, clean_negatives, span_reasons, ensemble_spans, scenario_scores, risk_citations, risk_searched_citations, risk_reports, missing_anchors)

SCORED = f"""{TICKETS_SQL},
e AS (SELECT types[1] AS type, (c_custkey % 7 <> 0)::INTEGER AS tp, 0 AS fp, (c_custkey % 7 = 0)::INTEGER AS fn FROM t WHERE len(types) > 0
  UNION ALL SELECT unnest(CASE WHEN c_custkey % 7 = 0 THEN types ELSE types[2:] END), 0, 1, 0 FROM t WHERE len(types) > 0),
g AS (SELECT type, sum(tp + fn)::BIGINT AS support, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM e GROUP BY 1),
h AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS a, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS b FROM g),
s AS (SELECT *, CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END AS f FROM h)
"""
#: Score and whether words near count, for each type.
CONFIDENCE = {
    "PH_SSS": (0.97, 1), "PH_MOBILE": (0.95, 0), "GCASH_MOBILE": (0.96, 1), "BANK_ACCOUNT": (0.85, 1), "EMAIL": (0.99, 0), "PH_IBAN": (0.95, 0), "PH_TIN": (0.96, 1), "CARD_PAN": (0.99, 1),
    "CARD_CVV": (0.95, 1), "REMITTANCE_REF": (0.85, 1), "PHILSYS_ID": (0.94, 0), "PASSPORT": (0.85, 1), "DATE_OF_BIRTH": (0.90, 1), "SALARY": (0.85, 1),
}


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


WANTED = ", ".join(f"('{d}', '{a}')" for d, a in sorted({r[3] for r in RULES if r[3][0] != "GAP"}))
CITED = NARRATIVES_SQL + f""",
k AS (SELECT doc_id AS rank, doc_id::VARCHAR AS chunk_id, ({_list(LAWS)})[doc_id % {len(LAWS)} + 1] AS law, text || CASE WHEN doc_id % 7 = 0 THEN '{SAID}' ELSE '' END AS text FROM documents),
w(law, anchor) AS (VALUES {WANTED}),
b AS (SELECT * FROM (SELECT law, anchor, chunk_id, contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), anchor) AS exact,
  row_number() OVER (PARTITION BY law, anchor ORDER BY contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), anchor) DESC, rank, chunk_id) AS n FROM k JOIN w USING (law)) WHERE n = 1),
u(flag_id, law, anchor) AS (VALUES {", ".join(f"('{r[0]}', '{r[3][0]}', '{r[3][1]}')" for r in RULES)}),
c AS (SELECT o_orderkey, flag_id, u.law AS doc_id, chunk_id, coalesce(exact, false) AS exact, chunk_id IS NULL AS degraded FROM f JOIN u USING (flag_id) LEFT JOIN b ON b.law = u.law AND b.anchor = u.anchor WHERE evidence IS NOT NULL)
"""


def _window_sql(name: str, source: str, pad: int) -> str:
    """CTEs up to ``name`` with the text around the anchor ``needle`` of ``source`` as ``cut``."""
    a, b, c, d = (f"{name}_{x}" for x in "abcd")
    return f"""{a} AS (SELECT *, strpos(lower(text), needle) - 1 AS p, length(text) AS len, greatest(strpos(lower(text), needle) - 1 - {pad}, 0) AS s0, least(length(text), strpos(lower(text), needle) - 1 + length(needle) + {pad}) AS e0 FROM {source}),
{b} AS (SELECT *, CASE WHEN s0 > 0 AND strpos(substr(text, s0 + 1), ' ') > 0 AND s0 + strpos(substr(text, s0 + 1), ' ') <= e0 THEN s0 + strpos(substr(text, s0 + 1), ' ') ELSE s0 END AS s FROM {a}),
{c} AS (SELECT *, substr(text, s + 1, e0 - s) AS body FROM {b}),
{d} AS (SELECT *, CASE WHEN e0 < len AND strpos(reverse(body), ' ') > 0 AND length(body) - strpos(reverse(body), ' ') > 0 THEN s + length(body) - strpos(reverse(body), ' ') ELSE e0 END AS z FROM {c}),
{name} AS (SELECT * EXCLUDE (p, len, s0, e0, s, body, z), CASE WHEN p < 0 THEN left(text, {2 * pad}) ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || regexp_replace(substr(text, s + 1, z - s), '^\\s+|\\s+$', '', 'g') || CASE WHEN z < len THEN '...' ELSE '' END END AS cut FROM {d})"""


SEARCHED = CITED + f""",
wanted AS (SELECT row_number() OVER (ORDER BY law, anchor) AS item_id, law, anchor FROM w),
hits AS (
  WITH d AS (SELECT rank AS doc_id, unnest({TOKENS_SQL}) AS term FROM k),
  p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), n AS (SELECT count(*) AS n FROM k),
  a AS (SELECT sum(tf) / (SELECT n FROM n) AS a FROM p), i0 AS (SELECT term, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p GROUP BY 1),
  i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
  q AS (SELECT item_id, term, count(*) AS x FROM (SELECT item_id, unnest({TOKENS_SQL.replace("text", "anchor")}) AS term FROM wanted) GROUP BY 1, 2),
  s AS (SELECT item_id, doc_id, sum(x * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT a FROM a)))) AS bm25 FROM q JOIN i USING (term) JOIN p USING (term) JOIN l USING (doc_id) GROUP BY 1, 2)
  SELECT * FROM (SELECT item_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id) AS place FROM s) WHERE place <= 20),
held AS (
  SELECT wanted.law, wanted.anchor, place, hits.score, chunk_id, trim(regexp_replace(k.text, '\\s+', ' ', 'g')) AS text, trim(regexp_replace(lower(wanted.anchor), '\\s+', ' ', 'g')) AS needle
  FROM hits JOIN wanted USING (item_id) JOIN k ON k.rank = hits.doc_id AND k.law = wanted.law),
best AS (SELECT * EXCLUDE (n) FROM (SELECT *, contains(lower(text), needle) AS exact, row_number() OVER (PARTITION BY law, anchor ORDER BY contains(lower(text), needle) DESC, place) AS n FROM held) WHERE n = 1),
{_window_sql("wide", "best", 300)},
shown AS (SELECT * EXCLUDE (text, cut), CASE WHEN exact AND NOT contains(lower(left(text, 600)), needle) THEN cut ELSE text END AS text FROM wide),
{_window_sql("narrow", "shown", 260)}
SELECT o_orderkey, flag_id, u.law AS doc_id, chunk_id, coalesce(exact, false) AS exact, chunk_id IS NULL AS degraded, round(score, 4) AS score, sha256(left(text, 600)) AS quote_sha256, sha256(cut) AS excerpt_sha256
FROM (SELECT o_orderkey, flag_id FROM f WHERE evidence IS NOT NULL) JOIN u USING (flag_id) LEFT JOIN narrow ON narrow.law = u.law AND narrow.anchor = u.anchor
"""
# Up to the places of the identifiers, then every one of them against the outside spans [0, 3), [2, 8) and one behind the end.
ENSEMBLE = REDACTED_SQL.rpartition("SELECT c_custkey, said[1]")[0].rstrip() + f""",
y(type, score, near) AS (VALUES {", ".join(f"('{k}', {s}::DOUBLE, {n})" for k, (s, n) in CONFIDENCE.items())}),
i AS (SELECT c_custkey, s[j] AS s, s[j] + length(values[j]) AS e, types[j] AS type FROM (SELECT *, unnest(range(1, len(types) + 1)) AS j FROM a) WHERE types[1] <> ''),
r AS (SELECT i.*, round_even(0.45 + 0.35 * score + 0.01 * near, 3) AS score, s < 3 AS a, s < 8 AND e > 2 AS b FROM i JOIN y USING (type)),
z AS (SELECT c_custkey, said[1] || array_to_string(list_transform(range(1, len(types) + 1), lambda q: values[q] || said[q + 1]), '') AS text FROM a)
SELECT c_custkey, s::INTEGER AS start, e::INTEGER AS "end", type, round(CASE WHEN b AND 0.99 > score THEN greatest(score, 0.9 * 0.99) ELSE score END, 6) AS score, a::INTEGER + b::INTEGER AS n_agree, 'recognised' AS stage FROM r
UNION ALL SELECT c_custkey, 0, 3, 'PERSON', 0.891, 1, 'outside' FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.c_custkey = a.c_custkey AND r.a)
UNION ALL SELECT c_custkey, length(text)::INTEGER + 5, length(text)::INTEGER + 9, 'PERSON', 0.445, 0, 'outside' FROM z WHERE c_custkey % 5 = 0
"""
SQL = {
    "ensemble_spans": ENSEMBLE,
    "risk_searched_citations": SEARCHED,
    "span_scores": SCORED + "SELECT type, support, tp, fp, fn, round(a, 6) AS precision, round(b, 6) AS recall, round(f, 6) AS f1 FROM s",
    "span_macro_f1": SCORED + "SELECT round(coalesce(avg(f), 0), 6) AS macro_f1, count(*) AS n_types FROM s WHERE support > 0",
    "clean_negatives": f"{TICKETS_SQL} SELECT form::INTEGER AS form, count(*) AS n, 0::BIGINT AS violations, 0::BIGINT AS leaks FROM t WHERE len(types) = 0 GROUP BY 1",
    "span_reasons": f"""{TICKETS_SQL}, x AS (SELECT c_custkey, unnest(types) AS type FROM t), y(type, score, near) AS (VALUES {", ".join(f"('{k}', {s}::DOUBLE, {n})" for k, (s, n) in CONFIDENCE.items())})
SELECT c_custkey, type, 'form:' || type || ',valid' || CASE WHEN near = 1 THEN ',words near' ELSE '' END AS reasons, round_even(0.45 + 0.35 * score + 0.01 * near, 3) AS score FROM x JOIN y USING (type)""",
    "scenario_scores": NARRATIVES_SQL + f""",
y(i, expected, severity, exposed) AS (VALUES {", ".join(f"({i}, {_list(e[0])}::VARCHAR[], {risk.SEVERITY[e[1]]}, {_list(e[2])}::VARCHAR[])" for i, e in enumerate(EXPECTED))}),
g AS (SELECT o_orderkey, list(flag_id) AS found, max(severity) AS severity, list_distinct(flatten(list(CASE party WHEN 'both' THEN ['bank', 'customer'] ELSE [party] END))) AS exposed FROM f WHERE evidence IS NOT NULL GROUP BY 1),
z AS (SELECT y.expected, coalesce(g.found, []) AS found, coalesce(g.severity, 1) >= y.severity AS tier_ok, len(list_filter(y.exposed, lambda p: NOT list_contains(coalesce(g.exposed, []), p))) = 0 AS exposed_ok
  FROM t JOIN y ON y.i = o_orderkey % {len(EXPECTED)} LEFT JOIN g USING (o_orderkey)),
a AS (SELECT count(*) AS n, sum(len(list_intersect(expected, found)))::BIGINT AS tp, sum(len(found) - len(list_intersect(expected, found)))::BIGINT AS fp, sum(len(expected) - len(list_intersect(expected, found)))::BIGINT AS fn,
  coalesce(avg(tier_ok::INTEGER) FILTER (len(expected) > 0), 0) AS ta, coalesce(avg(exposed_ok::INTEGER) FILTER (len(expected) > 0), 0) AS ea, coalesce(avg((len(found) > 0)::INTEGER) FILTER (len(expected) = 0), 0) AS fr FROM z)
SELECT n, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(ta, 6) AS tier_accuracy, round(ea, 6) AS exposure_accuracy, round(fr, 6) AS false_positive_rate FROM a""",
    "risk_citations": CITED + "SELECT * FROM c",
    "risk_reports": CITED + f""", h AS (SELECT o_orderkey, flag_id, tier, severity, party, evidence, row_number() OVER (PARTITION BY o_orderkey ORDER BY severity DESC, flag_id DESC) AS n FROM f WHERE evidence IS NOT NULL),
j AS (SELECT o_orderkey, max(tier) FILTER (n = 1) AS tier, count(*) AS n, max(evidence) FILTER (n = 1) AS evidence, bool_or(party IN ('bank', 'both')) AS b, bool_or(party IN ('customer', 'both')) AS c,
  list_distinct(list(severity)) AS tiers FROM h GROUP BY 1),
i AS (SELECT o_orderkey, count(*) FILTER (NOT degraded) AS nc, count(*) FILTER (doc_id = 'GAP') AS ng, bool_or(degraded) AS dg FROM c GROUP BY 1)
SELECT t.o_orderkey, coalesce(tier, 'none') AS tier, coalesce(n, 0)::BIGINT AS n_flags, coalesce(nc, 0)::BIGINT AS n_citations, coalesce(ng, 0)::BIGINT AS n_gaps, coalesce(dg, false) AS degraded,
  CASE WHEN n IS NULL THEN '{risk.NO_ACTION}' ELSE array_to_string(list_filter([{", ".join(f"CASE WHEN list_contains(tiers, {risk.SEVERITY[k]}) THEN '{v}' END" for k, v in risk.ACTIONS.items())}], lambda x: x IS NOT NULL), ' ') END AS actions,
  CASE WHEN n IS NULL THEN 'No indicator matched; that is not a clearance.' ELSE upper(tier) || ' risk. ' || n || CASE WHEN n = 1 THEN ' indicator matched' ELSE ' indicators matched' END || '; the strongest on the words "' || evidence || '". Exposed: ' || CASE WHEN b AND c THEN 'bank and customer' WHEN b THEN 'the bank' ELSE 'the customer' END || '.' END AS summary
FROM t LEFT JOIN j USING (o_orderkey) LEFT JOIN i USING (o_orderkey)""",
    "missing_anchors": CITED + "SELECT law AS doc_id, anchor FROM w WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.law = w.law AND contains(trim(regexp_replace(lower(k.text), '\\s+', ' ', 'g')), w.anchor))",
}
