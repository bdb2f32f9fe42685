"""Structure-aware chunks: lines get the label of the header above them, sections are split and small parts folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_lines, collapsed, sentences, slug, stripped

TARGET, OVERLAP, LEAST, SHORTEST_BODY, LABEL = 2200, 260, 350, 40, 120
# Forms of headers, most specific first; clauses that head nothing; verbs that make a line a sentence.
HEADERS = (
    r"^\s*(?:SECTION|Section)\s+(?:\d+[A-Za-z]?(?:\([a-zA-Z0-9]+\))*)[\s.:]\s*(.*)$",
    r"^\s*(?:ARTICLE|Article)\s+(?:[IVXLC]+|\d+)[\s.:]\s*(.*)$",
    r"(?i)^\s*Rule\s+(?:\d+[A-Za-z]?)[\s.:]\s*(.*)$",
    r"^\s*(?:\d+)\.\s+([A-Z][A-Za-z ,\-]{4,80})[.\s]*$",
    r"^\s*(?:[IVXLC]+)\.\s+([A-Z][A-Z \-]{4,60})$",
)
BOILERPLATE = r"(?i)\b(?:effectivity|effect\s+of\s+this|approval|approved|date\s+of\s+approval|date\s+of\s+effectivity|signature|signatures|issuance|separability)\b"
VERBS = (
    "requires", "require", "shall", "must", "is", "are", "was", "were", "has", "have", "can", "may", "will", "means", "refers", "states",
    "provides", "sets", "applies", "covers", "gives", "allows", "prohibits", "imposes", "mandates", "becomes", "takes", "does", "do",
    "contains", "includes", "lists", "describes", "governs",
)
TAGS = {
    "breach": ("breach", "notification", "72 hour"), "consent": ("consent", "profiling"), "outbound-transfer": ("outbound", "transfer", "offshore"),
    "registration": ("registration", "register", "data protection officer"), "ai-systems": ("artificial intelligence", "automated decision", "ai system"),
    "security": ("security", "safeguard", "confidential"), "rights": ("right of access", "right to be informed", "amend"),
    "penalties": ("fine", "penalt", "administrative"), "pii-handling": ("personally identifiable", "sensitive personal"),
}
OPERATIVE = r"(?i)\b(within\s+\d+\s+(?:hours?|days?|months?|years?)|shall|shall not|must|required to|prohibited|is liable|shall be fined|imprisonment|fine of not less|no later than)\b"
QUANTITY = r"(?i)\b\d+(?:\.\d+)?\s*(?:%|hours?|days?|months?|years?|pesos)\b"
KEYWORD = r"\b(section|notify|notification|consent|register|penal)\w*\b"


def header_label(line: Column) -> Column:
    """The label of a line that is a header, else null."""
    s = stripped(line)
    title = None
    for p in HEADERS:
        title = F.when(s.rlike(p), F.regexp_extract(s, p, 1)) if title is None else title.when(s.rlike(p), F.regexp_extract(s, p, 1))
    first = F.lower(F.split(stripped(title), r"[\s(,;:]", 2)[0])
    named_once = F.regexp_count(s, F.lit(r"(?i)\bsections?\b")) <= 1
    fine = (s != "") & (F.length(s) <= 200) & ~s.rlike(BOILERPLATE) & named_once & title.isNotNull() & ~first.isin(*VERBS)
    return F.when(fine, F.substring(s, 1, LABEL))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section_no, label, body): lines up to the next header; those before the first are the Preamble.

    A document without headers is one section, Full text; header lines belong to no body.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(clean_lines(F.col(text_col)), "\n")).alias("pos", "line"))
    lines = lines.withColumn("label", header_label(F.col("line")))
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("above", F.last("label", ignorenulls=True).over(so_far)).withColumn("section_no", F.count("label").over(so_far)).withColumn("headers", F.count("label").over(Window.partitionBy("id")))
    body = lines.where(F.col("label").isNull()).groupBy("id", "section_no").agg(F.first("above").alias("above"), F.first("headers").alias("headers"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    label = F.coalesce("above", F.when(F.col("headers") == 0, "Full text").otherwise("Preamble"))
    return body.select("id", "section_no", label.alias("label"), stripped(F.col("body")).alias("body")).where(F.col("body") != "")


def pieces(body: Column) -> Column:
    """Overlapping windows of TARGET characters that end after a full stop where one lies in the second half; a shorter body whole."""
    n = F.length(body)
    most = F.ceil(n / (TARGET // 2 - OVERLAP)) + 1  # every window but the last goes on by more than that
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        window = F.substring(body, acc["at"] + 1, F.lit(TARGET))
        end = F.least(acc["at"] + TARGET, n)
        back = F.instr(F.reverse(window), " .")
        stop = F.length(window) - back - 1
        cut = (end < n) & (back > 0) & (stop > TARGET // 2)
        end = F.when(cut, acc["at"] + stop + 1).otherwise(end)
        piece = stripped(F.substring(body, acc["at"] + 1, end - acc["at"]))
        more = F.struct(F.greatest(end - OVERLAP, acc["at"] + 1).alias("at"), (end >= n).alias("over"), F.concat(acc["out"], F.array(piece)).alias("out"))
        return F.when(acc["over"], acc).otherwise(more)

    return F.when(n <= TARGET, F.array(body)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), most.cast("long")), start, step, lambda acc: acc["out"]))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ordinal, section, text, char_len, chunk_id, tags): sections split, parts under LEAST joined to the chunk before.

    A part of LEAST characters or more begins a chunk, as does a document's first part; those are counted in
    order and the parts of one count meet.
    """
    parts = sections(docs, id_col, text_col).where(F.length("body") >= SHORTEST_BODY)
    parts = parts.select("id", "section_no", "label", F.posexplode(pieces(F.col("body"))).alias("part", "piece"))
    order = Window.partitionBy("id").orderBy("section_no", "part")
    begins = (F.length("piece") >= LEAST) | (F.row_number().over(order) == 1)
    parts = parts.withColumn("begins", begins).withColumn("ordinal", F.count_if("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    row = F.struct("section_no", "part", "piece")
    name = F.concat("label", F.when(F.col("part") > 0, " (cont.)").otherwise(""))
    rows = parts.groupBy("id", "ordinal").agg(F.max(F.when(F.col("begins"), name)).alias("section"), F.array_sort(F.collect_list(row)).alias("rows"))
    text = F.array_join(F.transform("rows", lambda x: x["piece"]), "\n")
    # Topics are those of the parts, not of the text that they make together.
    topics = F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda x: tags(x["piece"])))))
    rows = rows.select("id", F.col("ordinal").cast("long").alias("ordinal"), "section", text.alias("text"), topics.alias("tags"))
    number = F.when(F.col("ordinal") > 999, F.col("ordinal").cast("string")).otherwise(F.lpad(F.col("ordinal").cast("string"), 3, "0"))
    return rows.select(F.col("id").alias("doc_id"), "ordinal", "section", "text", F.length("text").alias("char_len"), F.concat_ws("-", F.col("id").cast("string"), slug(F.col("section")), number).alias("chunk_id"), "tags")


def repeated_labels(chunked: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, n_chars, n_repeated, share): totals of each document, and how many of its chunks repeat a label."""
    per = chunked.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("char_len").alias("c"))
    out = per.groupBy("doc_id").agg(F.sum("n").alias("n_chunks"), F.sum("c").cast("long").alias("n_chars"), F.sum(F.col("n") - 1).alias("n_repeated"))
    return out.withColumn("share", F.col("n_repeated") / F.col("n_chunks"))


def tags(text: Column) -> Column:
    """Topics of a text, in order of their names' table; any of a topic's cues is enough."""
    low = F.lower(text)
    hit = lambda cues: F.when(sum((F.contains(low, F.lit(c)).cast("int") for c in cues[1:]), F.contains(low, F.lit(cues[0])).cast("int")) > 0, True)
    return F.filter(F.array(*(F.when(hit(cues), F.lit(t)) for t, cues in TAGS.items())), lambda x: x.isNotNull())


def sentence_score(sentence: Column, terms: Column) -> Column:
    """Terms that occur, and more for an obligation (3), a quantity (2) and a topical word (0.5)."""
    low = F.lower(sentence)
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t))).cast("double")
    return hits + F.when(low.rlike(OPERATIVE), 3.0).otherwise(0.0) + F.when(low.rlike(QUANTITY), 2.0).otherwise(0.0) + F.when(low.rlike(KEYWORD), 0.5).otherwise(0.0)


def best_sentences(rows: DataFrame, id_col: str, text_col: str, terms_col: str, limit: int = 3) -> DataFrame:
    """(id, rank, pos, sentence, score): of sentences of 25 to 700 characters the best with any score, earlier ones first."""
    s = rows.select(F.col(id_col).alias("id"), F.col(terms_col).alias("terms"), F.posexplode(sentences(collapsed(F.col(text_col)))).alias("pos", "sentence"))
    s = s.withColumn("sentence", F.trim("sentence")).where(F.length("sentence").between(25, 700)).withColumn("score", sentence_score(F.col("sentence"), F.col("terms"))).where("score > 0")
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pos")))
    return ranked.where(F.col("rank") <= limit).select("id", "rank", "pos", "sentence", "score")
