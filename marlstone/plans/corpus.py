"""Queries on building and checking a corpus, on citations and on vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocabulary import CREDENTIAL_CUES, DOMAIN_TERMS, EXPANSIONS, FRONT_LINE_CUES, SOLICITATION_CUES
from ..operators import answer, canonical, chunking, ledger, retrieval
from ..sources import files
from ..sources.scratch import place
from ..sources.snapshots import Snapshots
from .catalogue import ASIDE, SECTION_SQL, TOKENS_SQL, _asked, _asked_terms, _items, _numbers, _passages, _stem_sql, clean_sql, questions, strip_sql, table


#: What makes a text of paragraphs one with headers, page numbers and a clause that heads nothing.
INSERTED = ("\nSECTION 1. Scope of these words\n", "\nPage 3\n- 4 -\n\n\nArticle II. Duties\n", "\nSection 9. Effectivity\nSection 10. requires care\nRule 4. Short\n")


def structured(spark, sf_dir):
    """The documents with headers put between copies of their text."""
    parts = (F.col("text"), F.lit(INSERTED[0]), F.col("text"), F.lit(INSERTED[1]), F.substring("text", 1, 300), F.lit(INSERTED[2]), F.substring("text", 5, 90))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


def document_sections(spark, sf_dir):
    rows = chunking.sections(structured(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "section_no", "label", F.sha2("body", 256).alias("body_sha256"))


def document_chunks(spark, sf_dir):
    out = chunking.chunks(structured(spark, sf_dir))
    return out.select("doc_id", "ordinal", "section", "char_len", "chunk_id", F.sha2("text", 256).alias("text_sha256"), F.array_join("tags", ",").alias("tags"))


def cited_answers(spark, sf_dir):
    cited = answer.citations(*_asked(spark, sf_dir)).select("query_id", F.explode("citations").alias("c"))
    return cited.select("query_id", "c.rank", F.col("c.id").alias("doc_id"), "c.label", "c.score", F.sha2("c.sentence", 256).alias("sentence_sha256"))


def bm25_expanded_topk(spark, sf_dir):
    """Stemmed passages asked by stemmed questions with the terms that their cues add."""
    terms = questions(spark, sf_dir).select("query_id", F.explode(answer.expanded(F.col("text"))).alias("term"))
    terms = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    best = retrieval.best(terms, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 5, stemmed=True)
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


def hybrid_vectors_topk(spark, sf_dir):
    """Terms, instruments and vectors in one score: a question's vector is the one with its number, a document's likewise."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    items = _items(spark, sf_dir)
    asked = vectors.join(items.select("query_id"), F.col("query_id") == F.col("id")).select("query_id", "v")
    best = retrieval.best(_asked_terms(spark, sf_dir), _passages(spark, sf_dir), 5, numbers=_numbers(items), vectors=vectors, asked=asked)
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", "score")


def pooled_vectors(spark, sf_dir):
    """Runs of four vectors as the tokens of a passage, the last of each masked."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("passage_id"), F.struct("vec_id", "embedding").alias("r"))
    rows = rows.groupBy("passage_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    mask = F.transform("rows", lambda r: (r["vec_id"] % 4 < 3).cast("double"))
    tokens = F.transform("rows", lambda r: r["embedding"])
    first = lambda mode: F.round(retrieval.pooled(tokens, mask, mode)[0], 5)
    return rows.select("passage_id", first("mean").alias("mean_0"), first("cls").alias("cls_0"))


def corpus_fingerprints(spark, sf_dir):
    return retrieval.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "doc_id", "text")


def chunk_totals(spark, sf_dir):
    out = chunking.repeated_labels(chunking.chunks(structured(spark, sf_dir)))
    return out.select("doc_id", "n_chunks", "n_chars", "n_repeated", F.round("share", 6).alias("share"))


def gated_documents(spark, sf_dir):
    """English documents must say two words to be taken; pages are gated as pages."""
    rows = table(spark, sf_dir, "documents").withColumn("needs", F.when(F.col("lang") == "en", F.array(F.lit("the"), F.lit("of"))))
    return rows.select("doc_id", F.coalesce(files.gate(F.col("text"), F.col("source") == "web", F.col("needs")), F.lit("taken")).alias("state"))


def adopted_copies(spark, sf_dir):
    """Of each four documents the copy to use, as if their sources were kinds of files."""
    kind = F.element_at(F.array(F.lit("md"), F.lit("html"), F.lit("txt"), F.lit("pdf"), F.lit("md")), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("name"), kind.alias("kind"), F.length("text").alias("n_chars"), "doc_id", (F.col("doc_id") % 5 == 0).alias("authored"))
    return files.adopted(rows, "name", authored="authored").select("name", "doc_id", "kind")


def risk_requests(spark, sf_dir):
    """Admission where blank texts are refused: every eleventh document is blank."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, " \t ").otherwise(F.col("text")).alias("text"))
    good, bad = files.admitted(rows, blank=False)
    return good.select("doc_id", F.lit("admitted").alias("state")).unionByName(bad.select("doc_id", F.col("reason").alias("state")))


def excerpts(spark, sf_dir):
    """Around the eighth word of each document."""
    anchor = F.try_element_at(F.split("text", " "), F.lit(8))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", anchor.alias("anchor")).where(F.length("anchor") > 3)
    return rows.select("doc_id", F.sha2(T.excerpt(F.col("text"), F.col("anchor"), 40), 256).alias("excerpt_sha256"))


def best_quotes(spark, sf_dir):
    """The two best sentences of each document for the terms of its own beginning."""
    terms = F.array_distinct(F.filter(T.tokens(F.substring("text", 1, 60)), lambda t: F.length(t) >= 3))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", terms.alias("terms"))
    return chunking.best_sentences(rows, "doc_id", "text", "terms", 2).select(F.col("id").alias("doc_id"), "rank", "pos", "score", F.sha2("sentence", 256).alias("sentence_sha256"))


def recent_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), "event_type")
    return ledger.recent(rows, 5).select(F.col("ledger").alias("user_id"), "seq", "event_type", "back")


def event_digests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("utc", T.utc_seconds(F.col("ts"))).withColumn("number", T.number_or_zero(F.concat(F.col("event_type"), F.lit("1"))))
    rows = rows.withColumn("number", F.col("number") + T.number_or_zero(F.col("user_id").cast("string")))
    return rows.select("event_id", ledger.canonical_digest("event_id", "utc", "event_type").alias("digest"), "utc", "number")


def order_digests(spark, sf_dir):
    """Each order with its lines as one nested value: digests of it, and of its part without floating numbers."""
    line = F.struct("l_linenumber", F.col("l_shipdate").alias("ship"), F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"), (F.col("l_discount") * 1e-9).alias("discount"), (F.col("l_extendedprice") * 1e14).alias("large"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    lines = lines.withColumn("whole", F.transform("lines", lambda x: F.struct(x["ship"].alias("ship"), x["flag"].alias("flag"), x["l_linenumber"].alias("n\"o"))))
    lines = lines.withColumn("lines", F.transform("lines", lambda x: x.dropFields("l_linenumber")))
    note = F.map_from_arrays(F.array(F.lit("z"), F.col("o_orderstatus")), F.array(F.lit(None).cast("string"), F.concat(F.lit('say "é\t"\\ '), F.col("o_orderpriority"))))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    rows = rows.select("o_orderkey", F.struct("o_orderkey", "lines", "o_totalprice", "o_orderdate").alias("all"), F.struct("o_orderkey", "whole", note.alias("note")).alias("part"))
    kinds = rows.schema
    return rows.select("o_orderkey", *(canonical.digest(F.col(c), kinds[c].dataType).alias(f"{c}_sha256") for c in ("all", "part")))


def snapshot_changes(spark, sf_dir):
    """Customers in two versions, the second without some, with others and with new balances: what a reader of both sees."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    held = Snapshots(spark, place(spark, "customers"))
    old = held.write(rows.where("c_custkey % 5 <> 0"))
    moved = F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    new = held.write(rows.where("c_custkey % 3 <> 0").withColumn("c_acctbal", moved), allow_fewer=True)
    return held.changes(old, new, "c_custkey")


QUERIES = (
    order_digests, snapshot_changes,
    document_sections, document_chunks, cited_answers, bm25_expanded_topk, hybrid_vectors_topk, pooled_vectors, corpus_fingerprints, chunk_totals, gated_documents, adopted_copies, risk_requests, excerpts,
    best_quotes, recent_entries, event_digests,
)


def bm25_sql(documents: str, questions: str) -> str:
    """CTEs up to b (item_id, doc_id, bm25) from those that give d (doc_id, term) and w (item_id, term)."""
    return f"""{documents}, {questions},
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1),
n AS (SELECT count(*) AS n FROM documents),
a AS (SELECT sum(tf) / (SELECT n FROM n) AS a FROM p),
i0 AS (SELECT term, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p GROUP BY 1),
i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
q AS (SELECT item_id, term, count(*) AS w FROM w GROUP BY 1, 2),
b AS (SELECT item_id, doc_id, sum(w * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT a FROM a)))) AS bm25
  FROM q JOIN i USING (term) JOIN p USING (term) JOIN l USING (doc_id) GROUP BY 1, 2)"""


def _any_sql(column: str, cues: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains(lower({}), '{}')".format(column, c.replace("'", "''")) for c in cues) + ")"


PLAIN = f"d AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents)"
ASKED = f"w AS (SELECT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark)"
#: Terms of questions with what their cues add, not yet stemmed.
EXPANDED = f"x0 AS (SELECT item_id, unnest({TOKENS_SQL}) AS term FROM benchmark" + "".join(
    " UNION ALL SELECT item_id, unnest([{}]) FROM benchmark WHERE {}".format(", ".join("'" + t.replace("'", "''") + "'" for t in terms), _any_sql("text", cues)) for cues, terms in EXPANSIONS
) + ")"


def stems_sql(name: str, source: str) -> str:
    """CTE ``name`` (term, stem) of the distinct terms of ``source``."""
    return f"{name}1 AS (SELECT DISTINCT term FROM {source}), {name}2 AS (SELECT term, {_stem_sql('term')} AS s1 FROM {name}1), {name}3 AS (SELECT term, {_stem_sql('s1')} AS s2 FROM {name}2), {name} AS (SELECT term, {_stem_sql('s2')} AS stem FROM {name}3)"


SENTENCES = r"string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.;:])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))"


def best_sql(name: str, source: str, key: str) -> str:
    """CTEs up to ``name`` (key, pos, sentence, score, rank) of rows of ``source`` (key, text, terms)."""
    score = "len(list_filter(terms, lambda t: contains(lower(sentence), t))) + CASE WHEN regexp_matches(lower(sentence), '{}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(sentence), '{}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(sentence), '{}') THEN 0.5 ELSE 0 END".format(chunking.OPERATIVE, chunking.QUANTITY, chunking.KEYWORD)
    return f"""{name}0 AS (SELECT {key}, terms, {SENTENCES} AS ss FROM {source}),
{name}1 AS (SELECT {key}, terms, trim(unnest(ss)) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM {name}0),
{name}2 AS (SELECT {key}, pos, sentence, ({score})::DOUBLE AS score FROM {name}1 WHERE length(sentence) BETWEEN 25 AND 700),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, pos)::INTEGER AS rank FROM {name}2 WHERE score > 0)"""


QUESTIONS = f"bq AS (SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN '{ASIDE}' ELSE '' END AS text FROM benchmark)"
SECTIONED = f"""ds AS (SELECT doc_id, unnest({SECTION_SQL.format('text')}) AS x FROM documents),
qs AS (SELECT item_id, unnest({SECTION_SQL.format('text')}) AS x FROM benchmark),
s AS (SELECT DISTINCT item_id, doc_id, 1.0::DOUBLE AS section FROM qs JOIN ds USING (x)),
m AS (SELECT item_id, doc_id, bm25 / max(bm25) OVER (PARTITION BY item_id) AS bm FROM b)"""
RANKED = f"""WITH {bm25_sql(PLAIN, ASKED)}, pz AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN '. Keep it for 30 days and no longer' ELSE '' END AS text, source FROM documents), {SECTIONED.replace("AS x FROM documents", "AS x FROM pz")},
h AS (SELECT coalesce(m.item_id, s.item_id) AS item_id, coalesce(m.doc_id, s.doc_id) AS doc_id, coalesce(greatest(bm, 0), 0) AS bm, coalesce(section, 0) AS section FROM m FULL JOIN s ON m.item_id = s.item_id AND m.doc_id = s.doc_id),
k AS (SELECT item_id, doc_id, round(0.625::DOUBLE * bm + 0.375::DOUBLE * section, 6) AS score FROM h),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM k) WHERE place <= 12),
{EXPANDED}, {stems_sql('st', 'x0')},
te AS (SELECT item_id, list_distinct(list(stem)) AS terms FROM x0 JOIN st USING (term) WHERE length(stem) >= 3 GROUP BY 1),
pa AS (SELECT r.item_id, r.doc_id, r.place, r.score AS hit, d.text, d.source, coalesce(t.terms, []) AS terms FROM r JOIN pz d USING (doc_id) LEFT JOIN te t USING (item_id)),
{best_sql('bs', 'pa', 'item_id, doc_id')},
ti AS (SELECT item_id, regexp_matches(text, '(?i)(ilan|magkano|how\\s+many|how\\s+long|when)') AND regexp_matches(text, '(?i)(oras|hour|araw|day|buwan|month|taon|year)') AS timed FROM benchmark),
ca AS (SELECT item_id, doc_id, hit, source, sentence, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS full_text,
  row_number() OVER (PARTITION BY item_id ORDER BY (timed AND NOT regexp_matches(text, '(?i)\\b\\d+\\s*(?:hours?|days?|months?|years?)\\b'))::INTEGER, place) AS n
  FROM pa JOIN bs USING (item_id, doc_id) JOIN ti USING (item_id) WHERE bs.rank = 1),
cl AS (SELECT x.item_id, x.n AS a, y.n AS b FROM ca x JOIN ca y ON x.item_id = y.item_id AND x.n < y.n
  WHERE contains(x.full_text, left(y.full_text, 240)) OR contains(left(y.full_text, 240), x.full_text) OR x.sentence = y.sentence),
c1 AS (SELECT item_id, min(n) AS n FROM ca GROUP BY 1),
c2 AS (SELECT ca.item_id, min(ca.n) AS n FROM ca JOIN c1 USING (item_id) WHERE ca.n > c1.n AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.item_id = ca.item_id AND cl.a = c1.n AND cl.b = ca.n) GROUP BY 1),
c3 AS (SELECT ca.item_id, min(ca.n) AS n FROM ca JOIN c1 USING (item_id) JOIN c2 ON c2.item_id = ca.item_id WHERE ca.n > c2.n AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.item_id = ca.item_id AND cl.a IN (c1.n, c2.n) AND cl.b = ca.n) GROUP BY 1),
ch AS (SELECT item_id, 1 AS rank, n FROM c1 UNION ALL SELECT item_id, 2, n FROM c2 UNION ALL SELECT item_id, 3, n FROM c3)
"""
RANKED = RANKED.replace(" FROM benchmark", " FROM bq").replace("WITH ", f"WITH {QUESTIONS}, ", 1)
LABEL = "CASE " + " ".join("WHEN regexp_matches(s, '{0}') THEN regexp_extract(s, '{0}', 1)".format(p) for p in chunking.HEADERS) + " END"
_INSERTED = ["'" + x.replace("\n", "' || chr(10) || '") + "'" for x in INSERTED]
SECTIONS = f"""st AS (SELECT doc_id, text || {_INSERTED[0]} || text || {_INSERTED[1]} || substr(text, 1, 300) || {_INSERTED[2]} || substr(text, 5, 90) AS text FROM documents),
c0 AS (SELECT doc_id, string_split({clean_sql('text')}, chr(10)) AS ls FROM st WHERE text IS NOT NULL),
c1 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM c0),
c2 AS (SELECT doc_id, pos, line, trim(line) AS s FROM c1),
c3 AS (SELECT doc_id, pos, line, s, {LABEL} AS title FROM c2),
c4 AS (SELECT doc_id, pos, line, CASE WHEN s <> '' AND length(s) <= 200 AND NOT regexp_matches(s, '{chunking.BOILERPLATE}') AND len(regexp_extract_all(s, '(?i)\\bsections?\\b')) <= 1 AND title IS NOT NULL
  AND lower(regexp_extract(trim(title), '^[^\\s(,;:]*', 0)) NOT IN {chunking.VERBS} THEN left(s, 120) END AS label FROM c3),
c5 AS (SELECT doc_id, pos, line, label, count(label) OVER (PARTITION BY doc_id ORDER BY pos) AS section_no, count(label) OVER (PARTITION BY doc_id) AS headers FROM c4),
c6 AS (SELECT doc_id, section_no, max(label) AS above, max(headers) AS headers, string_agg(line, chr(10) ORDER BY pos) FILTER (label IS NULL) AS body FROM c5 GROUP BY 1, 2),
c7 AS (SELECT doc_id, section_no, coalesce(above, CASE WHEN headers = 0 THEN 'Full text' ELSE 'Preamble' END) AS label, {strip_sql('body')} AS body FROM c6 WHERE body IS NOT NULL),
se AS (SELECT * FROM c7 WHERE body <> '')"""


def _end_sql(at: str) -> str:
    window = f"substr(body, ({at} + 1)::BIGINT, 2200)"
    back = f"strpos(reverse({window}), ' .')"
    stop = f"(length({window}) - {back} - 1)"
    return f"CASE WHEN length(body) <= 2200 THEN length(body) WHEN {at} + 2200 < length(body) AND {back} > 0 AND {stop} > 1100 THEN {at} + {stop} + 1 ELSE least({at} + 2200, length(body)) END"


TAGS_SQL = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(piece), '{c}')" for c in cues) + f" THEN '{t}' END" for t, cues in chunking.TAGS.items()) + "], lambda x: x IS NOT NULL)"
CHUNKS = f"""WITH RECURSIVE {SECTIONS},
pi AS (SELECT doc_id, section_no, label, body, 0::BIGINT AS part, 0::BIGINT AS begin_at, ({_end_sql('0')})::BIGINT AS stop FROM se WHERE length(body) >= 40
  UNION ALL SELECT doc_id, section_no, label, body, part + 1, greatest(stop - 260, begin_at + 1), ({_end_sql('greatest(stop - 260, begin_at + 1)')})::BIGINT FROM pi WHERE stop < length(body)),
pp AS (SELECT doc_id, section_no, part, label || CASE WHEN part > 0 THEN ' (cont.)' ELSE '' END AS name, {strip_sql('substr(body, begin_at + 1, stop - begin_at)')} AS piece FROM pi),
pb AS (SELECT *, length(piece) >= 350 OR row_number() OVER (PARTITION BY doc_id ORDER BY section_no, part) = 1 AS begins FROM pp),
po AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY doc_id ORDER BY section_no, part ROWS UNBOUNDED PRECEDING) - 1 AS ordinal FROM pb),
ck AS (SELECT doc_id, ordinal, max(name) FILTER (begins) AS section, string_agg(piece, chr(10) ORDER BY section_no, part) AS text, list_sort(list_distinct(flatten(list({TAGS_SQL})))) AS tags FROM po GROUP BY 1, 2)
"""

SQL = {
    "cited_answers": RANKED + "SELECT ch.item_id AS query_id, ch.rank, ca.doc_id, '[' || ca.doc_id || ' ' || left(coalesce(ca.source, ''), 60) || ']' AS label, ca.hit AS score, sha256(ca.sentence) AS sentence_sha256 FROM ch JOIN ca ON ca.item_id = ch.item_id AND ca.n = ch.n",
    "answered_questions": RANKED + f""", be AS (SELECT item_id, max(score) AS confidence FROM r GROUP BY 1), nc AS (SELECT item_id, count(*) AS n FROM ch GROUP BY 1),
z AS (SELECT g.item_id AS query_id, coalesce(be.confidence, 0) AS confidence, coalesce(nc.n, 0) AS n, ({_any_sql('text', CREDENTIAL_CUES)} OR {_any_sql('text', FRONT_LINE_CUES)}) AND {_any_sql('text', SOLICITATION_CUES)} AS scope_note,
  CASE WHEN trim(text) = '' THEN 'blank' WHEN coalesce(be.confidence, 0) < 0.42 THEN 'below threshold' WHEN NOT {_any_sql('text', DOMAIN_TERMS)} THEN 'out of domain' WHEN nc.n IS NULL THEN 'nothing to quote' END AS reason
  FROM bq g LEFT JOIN be USING (item_id) LEFT JOIN nc USING (item_id))
SELECT query_id, reason IS NOT NULL AS refused, reason, round(confidence, 6) AS confidence, CASE WHEN reason IS NULL THEN n ELSE 0 END::BIGINT AS n_citations, scope_note FROM z""",
    "bm25_expanded_topk": f"""WITH {QUESTIONS}, d0 AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents), {stems_sql('sd', 'd0')}, {EXPANDED.replace(" FROM benchmark", " FROM bq")}, {stems_sql('sq', 'x0')},
{bm25_sql('d AS (SELECT doc_id, stem AS term FROM d0 JOIN sd USING (term))', 'w AS (SELECT item_id, stem AS term FROM x0 JOIN sq USING (term))')},
r AS (SELECT item_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id)::INTEGER AS rank FROM b) SELECT item_id, doc_id, rank, score FROM r WHERE rank <= 5""",
    "hybrid_vectors_topk": f"""WITH {bm25_sql(PLAIN, ASKED)}, {SECTIONED},
v0 AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
v1 AS (SELECT vec_id, sqrt(sum(x * x)) AS size FROM v0 GROUP BY 1),
v AS (SELECT vec_id, i, x / greatest(size, 1e-9) AS x FROM v0 JOIN v1 USING (vec_id)),
co AS (SELECT q.vec_id AS item_id, c.vec_id AS doc_id, sum(q.x * c.x) AS cosine FROM v q JOIN benchmark g ON g.item_id = q.vec_id JOIN v c USING (i) JOIN documents t ON t.doc_id = c.vec_id GROUP BY 1, 2),
al AS (SELECT item_id, doc_id FROM m UNION SELECT item_id, doc_id FROM s UNION SELECT item_id, doc_id FROM co),
k AS (SELECT al.item_id, al.doc_id, round(CASE lang WHEN 'en' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END * (0.6::DOUBLE * coalesce(greatest(cosine, 0), 0) + 0.25::DOUBLE * coalesce(greatest(bm, 0), 0) + 0.15::DOUBLE * coalesce(section, 0)), 6) AS score
  FROM al LEFT JOIN m USING (item_id, doc_id) LEFT JOIN s USING (item_id, doc_id) LEFT JOIN co USING (item_id, doc_id) JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM k)
SELECT item_id, doc_id, rank, score FROM r WHERE rank <= 5""",
    "pooled_vectors": """WITH x AS (SELECT floor(vec_id / 4)::BIGINT AS passage_id, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
y AS (SELECT passage_id, i, coalesce(sum(x) FILTER (vec_id % 4 < 3), 0) / greatest(count(*) FILTER (vec_id % 4 < 3), 1e-9::DOUBLE) AS m, arg_min(x, vec_id) AS c FROM x GROUP BY 1, 2),
z AS (SELECT passage_id, greatest(sqrt(sum(m * m)), 1e-9) AS zm, greatest(sqrt(sum(c * c)), 1e-9) AS zc FROM y GROUP BY 1)
SELECT passage_id, round(m / zm, 5) AS mean_0, round(c / zc, 5) AS cls_0 FROM y JOIN z USING (passage_id) WHERE i = 1""",
    "corpus_fingerprints": """WITH h AS (SELECT doc_id, floor(doc_id / 4096)::BIGINT AS block, sha256(encode(doc_id::VARCHAR) || '\\x00'::BLOB || encode(coalesce(text, '')) || '\\x00'::BLOB) AS h FROM documents)
SELECT block, count(*) AS n, sha256(string_agg(h, '' ORDER BY doc_id, h)) AS digest FROM h GROUP BY 1""",
    "document_sections": f"WITH {SECTIONS} SELECT doc_id, section_no, label, sha256(body) AS body_sha256 FROM se",
    "document_chunks": CHUNKS + r"SELECT doc_id, ordinal, section, length(text)::INTEGER AS char_len, doc_id || '-' || left(regexp_replace(regexp_replace(section, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) || '-' || CASE WHEN ordinal > 999 THEN ordinal::VARCHAR ELSE lpad(ordinal::VARCHAR, 3, '0') END AS chunk_id, sha256(text) AS text_sha256, array_to_string(tags, ',') AS tags FROM ck",
    "chunk_totals": CHUNKS + "SELECT doc_id, sum(n)::BIGINT AS n_chunks, sum(c)::BIGINT AS n_chars, sum(n - 1)::BIGINT AS n_repeated, round(sum(n - 1) / sum(n), 6) AS share FROM (SELECT doc_id, section, count(*) AS n, sum(length(text)) AS c FROM ck GROUP BY 1, 2) GROUP BY 1",
    "gated_documents": """SELECT doc_id, CASE WHEN coalesce(length(text), 0) < 2000 THEN 'too little text' WHEN source = 'web' AND (length(lower(text)) - length(replace(lower(text), 'advisory no.', ''))) / 12 >= 8 THEN 'index page'
  WHEN lang = 'en' AND NOT (contains(lower(text), 'the') AND contains(lower(text), 'of')) THEN 'another document' ELSE 'taken' END AS state FROM documents""",
    "adopted_copies": """WITH x AS (SELECT floor(doc_id / 4)::BIGINT AS name, (['md', 'html', 'txt', 'pdf', 'md'])[doc_id % 5 + 1] AS kind, length(text) AS n_chars, doc_id, doc_id % 5 = 0 AS authored FROM documents),
r AS (SELECT name, doc_id, kind, row_number() OVER (PARTITION BY name ORDER BY CASE kind WHEN 'pdf' THEN 1 WHEN 'html' THEN 2 ELSE 3 END, n_chars DESC, doc_id) AS n FROM x WHERE kind <> 'txt' AND (n_chars >= 4000 OR NOT authored))
SELECT name, doc_id, kind FROM r WHERE n = 1""",
    "risk_requests": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'blank' WHEN text IS NULL THEN 'missing' WHEN length(text) = 0 THEN 'empty' WHEN length(text) > 20000 THEN 'too long' WHEN regexp_full_match(text, '\\s*') THEN 'blank' ELSE 'admitted' END AS state FROM documents",
    "excerpts": """WITH a AS (SELECT doc_id, text, string_split(text, ' ')[8] AS anchor FROM documents),
b AS (SELECT doc_id, text, trim(regexp_replace(lower(anchor), '\\s+', ' ', 'g')) AS needle FROM a WHERE length(anchor) > 3),
c AS (SELECT doc_id, text, needle, strpos(lower(text), needle) - 1 AS p, length(text) AS n FROM b),
d AS (SELECT doc_id, text, p, n, greatest(p - 40, 0) AS s0, least(n, p + length(needle) + 40) AS e0 FROM c),
e AS (SELECT doc_id, text, p, n, e0, s0, CASE WHEN s0 > 0 AND strpos(substr(text, s0 + 1), ' ') > 0 AND s0 + strpos(substr(text, s0 + 1), ' ') <= e0 THEN s0 + strpos(substr(text, s0 + 1), ' ') ELSE s0 END AS s FROM d),
f AS (SELECT *, substr(text, s + 1, e0 - s) AS body FROM e),
g AS (SELECT *, CASE WHEN e0 < n AND strpos(reverse(body), ' ') > 0 AND length(body) - strpos(reverse(body), ' ') > 0 THEN s + length(body) - strpos(reverse(body), ' ') ELSE e0 END AS z FROM f)
SELECT doc_id, sha256(CASE WHEN p < 0 THEN left(text, 80) ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || regexp_replace(substr(text, s + 1, z - s), '^\\s+|\\s+$', '', 'g') || CASE WHEN z < n THEN '...' ELSE '' END END) AS excerpt_sha256 FROM g""",
    "best_quotes": f"""WITH x AS (SELECT doc_id, text, list_distinct(list_filter({TOKENS_SQL.replace('lower(text)', 'lower(left(text, 60))')}, lambda t: length(t) >= 3)) AS terms FROM documents), {best_sql('bs', 'x', 'doc_id')}
SELECT doc_id, rank, pos::INTEGER AS pos, score, sha256(sentence) AS sentence_sha256 FROM bs WHERE rank <= 2""",
    "order_digests": r"""WITH l AS (SELECT l_orderkey, string_agg('{"discount":' || (l_discount * 1e-9::DOUBLE)::VARCHAR || ',"flag":"' || l_returnflag || '","large":' || (l_extendedprice * 1e14::DOUBLE)::VARCHAR || ',"price":' || l_extendedprice::VARCHAR || ',"ship":"' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || '"}', ',' ORDER BY l_linenumber, l_shipdate, l_returnflag, l_extendedprice, l_discount) AS x,
string_agg('{"flag":"' || l_returnflag || '","n\"o":' || l_linenumber || ',"ship":"' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || '"}', ',' ORDER BY l_linenumber, l_shipdate, l_returnflag, l_extendedprice, l_discount) AS y FROM lineitem GROUP BY 1)
SELECT o_orderkey, sha256('{"lines":[' || x || '],"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","o_orderkey":' || o_orderkey || ',"o_totalprice":' || o_totalprice::VARCHAR || '}') AS all_sha256,
sha256('{"note":{"' || o_orderstatus || '":"say \"é\t\"\\ ' || o_orderpriority || '","z":null},"o_orderkey":' || o_orderkey || ',"whole":[' || y || ']}') AS part_sha256 FROM orders JOIN l ON l_orderkey = o_orderkey""",
    "snapshot_changes": """WITH o AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.c_custkey = n.c_custkey
WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR n.c_custkey % 7 = 0""",
    "recent_entries": "SELECT user_id, event_id AS seq, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INTEGER AS back FROM events QUALIFY back <= 5",
    "event_digests": """WITH x AS (SELECT event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS utc, user_id FROM events)
SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","utc":"' || utc || '"}') AS digest, utc, user_id::DOUBLE AS number FROM x""",
}
