"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, ngram_join, periodic, pii, prefix_trie, quality, spotsigs, substring_dedup, suffix_dedup, topk, toxicity, warc
from .tables import table

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP2_SQL = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tests AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
  FROM tests WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM docs, lengths WHERE len(w) >= k),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM places),
met AS (SELECT p.doc_id, p.i, p.k, v.item_id FROM grams p JOIN windows v ON p.k = v.k AND p.g = v.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM met) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items,
  sha256(coalesce(x.t, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN items x USING (doc_id)
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), quality.crc_mod("doc_id", 5)
    voter = quality.train(docs, table(spark, sf_dir, "labels"), part != 0)
    return quality.score(docs, voter).select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", F.size(F.filter(F.split("spans", ","), lambda x: x != "")).cast("long").alias("n_spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), quality.crc_mod("doc_id", 3)
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), part != 1)
    return toxicity.score(docs, net).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = rf"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM tokens),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT o.a, o.b FROM common o JOIN sizes x ON x.doc_id = o.a JOIN sizes y ON y.doc_id = o.b
  WHERE 100 * o.n >= 75 * (x.n + y.n - o.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, a AS other FROM edges
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(p.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN parts p USING (doc_id)
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM tokens WHERE len(w) >= 13),
spans AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) < doc_id AS later FROM places),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM spans WHERE later),
cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, len(t.w) AS n, CASE WHEN c.ps IS NULL THEN t.w ELSE list_filter(t.w, lambda x, i: NOT list_contains(c.ps, i)) END AS k
  FROM tokens t LEFT JOIN cut c USING (doc_id))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, (coalesce(n, 0) - coalesce(len(k), 0))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica in which every page with a length divisible by 97 has another first character."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    bad = (F.length("html") % 97 == 0) & F.col("html").startswith("<")
    return warc.audit(pages, pages.withColumn("html", F.when(bad, F.expr("concat('#', substring(html, 2))")).otherwise(F.col("html"))))


OP10_SQL = r"""
WITH r AS (
  SELECT page_id, html, 'WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' AS a, '>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nContent-Type: text/html\r\nContent-Length: ' AS b FROM pages),
t AS (
  SELECT page_id, html, floor(page_id / 4096)::BIGINT AS archive,
    replace(replace(a || coalesce(page_id::VARCHAR, 'none') || b || strlen(coalesce(html, '')) || '\r\n\r\n', '\r', chr(13)), '\n', chr(10)) || coalesce(html, '') AS text
  FROM r)
SELECT page_id, archive, (sum(strlen(text) + 4) OVER w - strlen(text) - 4)::BIGINT AS record_offset, (strlen(text) + 4)::BIGINT AS record_length,
  sha256(text) AS record_sha256,
  coalesce(length(html) % 97 = 0 AND html LIKE '<%', false) AS damaged
FROM t WINDOW w AS (PARTITION BY archive ORDER BY page_id, sha256(text) ROWS UNBOUNDED PRECEDING)
"""


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spotsigs.with_edited(spotsigs.with_next(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), spotsigs.fingerprint("signatures").alias("fingerprint"),
        spotsigs.fingerprint("edited_signatures").alias("edited_fingerprint"), spotsigs.likeness("signatures", "edited_signatures").alias("near_edited"), spotsigs.likeness("signatures", "next_signatures").alias("near_next"),
    )


_WORDS11 = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPOTS11 = """CASE WHEN len({0}) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(coalesce(nullif(flatten(list_transform(range(1, len({1})), lambda k:
    list_transform({0}[(CASE WHEN k > 6 AND {1}[k - 6] = {1}[k - 1] - 5 THEN {1}[k - 1] - 1 WHEN k > 1 THEN {1}[k - 1] ELSE 0 END) + 1:{1}[k] - 1], lambda z: left(md5(z || ':' || {0}[{1}[k]] || ':' || {0}[{1}[k + 1]]), 16)))), []::VARCHAR[]), [left(md5(array_to_string({0}, ' ')), 16)]))) END"""
_LIKE11 = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS next FROM d),
e AS (SELECT doc_id, t, next, left(t, length(t) - length(t) // 4) || left(next, length(t) // 4) AS edited FROM o),
w AS (SELECT doc_id, t, edited, {_WORDS11.format("t")} AS a, {_WORDS11.format("edited")} AS b, {_WORDS11.format("next")} AS c FROM e),
stop AS (SELECT {list(spotsigs.ANCHORS)} AS s),
p AS (SELECT *, {", ".join(f"list_filter(range(1, len({x}) + 1), lambda i: NOT list_contains(s, {x}[i])) AS {x}p" for x in "abc")} FROM w, stop),
f AS (SELECT doc_id, t, edited, {", ".join(f"{_SPOTS11.format(x, x + 'p')} AS {x}s" for x in "abc")} FROM p)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string("as", ',') AS fingerprint, array_to_string(bs, ',') AS edited_fingerprint,
  {_LIKE11.format('"as"', 'bs')} AS near_edited, {_LIKE11.format('"as"', 'cs')} AS near_next
FROM f
"""


def edited_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth text or so, by its id's checksum, the words from a place on repeat a period; a null id edits nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = docs.where(F.col("text").isNotNull() & (h % 10 == 0)).select("doc_id", g.alias("g"), F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "").alias("w"))
    words = words.select("doc_id", "g", "w", F.size("w").cast("long").alias("n"))
    words = words.select("doc_id", "g", "w", "n", (F.col("g") % F.greatest("n", F.lit(1))).cast("int").alias("a"))
    period = (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, period), (3 + F.col("g") % 8).cast("int")))
    edited = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), (F.col("n") - F.col("a")).cast("int")))
    rest = docs.where(F.col("text").isNull() | ~F.coalesce(h % 10 == 0, F.lit(False)))
    return rest.select("doc_id", "text").unionByName(words.select("doc_id", F.when(F.col("n") > 0, F.array_join(edited, " ")).otherwise("").alias("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse(edited_words(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = out.withColumn("best", best).withColumn("lines", F.array_join(F.transform("runs", line), ""))
    milli = F.floor(1000 * F.col("best.length") / -F.col("best.period"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        milli.cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation begins with the first turns of the one whose id is the multiple of five at or before its own."""
    own = prefix_trie.in_order(prefix_trie.turns(table(spark, sf_dir, "conversations")))
    h, base = F.crc32(F.col("key").cast("string").cast("binary")) % 9, F.col("key") - F.col("key") % 5
    ids = own.where("last").select("key")
    heads = own.where("i < 8").select(F.col("key").alias("base"), "i", "digest", "n_bytes")
    first = ids.where(base != F.col("key")).withColumn("h", h).join(heads, (base == F.col("base")) & (F.col("i") < F.col("h")))
    rest = own.where((base == F.col("key")) | (F.col("i") >= h))
    columns = ["key", "digest", "n_bytes", F.col("i").alias("number")]
    rows = first.select(*columns, F.lit(0).alias("part")).unionByName(rest.select(*columns, F.lit(1).alias("part")))
    return prefix_trie.trie(rows, [F.col("part"), F.col("number")], ids.select(F.col("key").alias("conv_id")))


OP13_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
hs AS (
  SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END))) % 9 AS h FROM ids),
turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT c, turn, strlen(t) AS b, sha256(strlen(r) || ':' || r || t) AS k FROM turns),
own AS (SELECT c, b, k, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS i FROM keyed),
rebuilt AS (
  SELECT hs.c, 0 AS part, i, k, b FROM hs JOIN own ON own.c = hs.base AND i < h WHERE hs.base <> hs.c
  UNION ALL SELECT hs.c, 1, i, k, b FROM hs JOIN own ON own.c = hs.c WHERE hs.base = hs.c OR i >= h),
prefixes AS (
  SELECT c, row_number() OVER w AS depth, string_agg(k, '') OVER w AS path, b FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY part, i ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, '', 0 FROM ids),
lasts AS (SELECT c, max(depth) AS n FROM prefixes GROUP BY c),
nodes AS (
  SELECT path, min(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, min(b) AS b, string_agg(CASE WHEN depth = n THEN c::VARCHAR END, ',' ORDER BY c) AS ends
  FROM prefixes JOIN lasts USING (c) GROUP BY path),
kids AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT left(path, 64 * d) AS path, sum((n_convs - 1) * b) AS saved, count(*) FILTER (k IS NULL) AS leaves
  FROM (SELECT nodes.path, n_convs, b, kids.n AS k, unnest(range(0, depth + 1)) AS d FROM nodes LEFT JOIN kids USING (path)) GROUP BY 1)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN nodes p ON v.depth > 0 AND p.path = left(v.path, 64 * (v.depth - 1))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_pii": op4_pii,
        "op5_toxicity": op5_toxicity,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_warc_fixity": op10_warc_fixity,
        "op11_document_fingerprints": op11_document_fingerprints,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_topk": OP1_SQL,
        "op2_benchmark_decontamination": OP2_SQL,
        "op7_ngram_jaccard_join": OP7_SQL,
        "op10_warc_fixity": OP10_SQL,
        "op11_document_fingerprints": OP11_SQL,
        "op13_prefix_trie": OP13_SQL,
        "op8_substring_dedup": OP8_SQL,
    }
