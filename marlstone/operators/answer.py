"""Questions: the domain gate, query expansion, the scope note and extractive, cited or refused answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_label, collapsed, stem, tokens
from ..functions.vocabulary import CREDENTIAL_CUES, DOMAIN_TERMS, EXPANSIONS, FRONT_LINE_CUES, SOLICITATION_CUES
from ..sources.scratch import written
from .chunking import best_sentences
from .retrieval import THRESHOLD

#: Characters at the head of a passage that tell it from another.
HEAD = 240
# Words of questions for an amount and for a time, and what states a duration.
ASKS_HOW_MUCH = r"(?iu)(ilan|magkano|how\s+many|how\s+long|when)"
ASKS_TIME = r"(?iu)(oras|hour|araw|day|buwan|month|taon|year)"
DURATION = r"(?iu)\b\d+\s*(?:hours?|days?|months?|years?)\b"


def any_of(text: Column, cues: tuple[str, ...]) -> Column:
    """Whether any cue is part of a lower-cased text."""
    low = F.lower(text)
    return F.exists(F.array(*(F.lit(c) for c in cues)), lambda c: F.contains(low, c))


def in_domain(question: Column) -> Column:
    return any_of(question, DOMAIN_TERMS)


def needs_scope_note(question: Column) -> Column:
    return (any_of(question, CREDENTIAL_CUES) | any_of(question, FRONT_LINE_CUES)) & any_of(question, SOLICITATION_CUES)


def expanded(question: Column) -> Column:
    """Stemmed tokens of a question and those that its cues add; repeats stay and count."""
    extra = [F.when(any_of(question, cues), F.array(*(F.lit(t) for t in terms))).otherwise(F.array().cast("array<string>")) for cues, terms in EXPANSIONS]
    return F.transform(F.concat(tokens(question), *extra), stem)


def wants_time(question: Column) -> Column:
    """Whether a question asks for a duration or a date."""
    return question.rlike(ASKS_HOW_MUCH) & question.rlike(ASKS_TIME)


def citations(ranked: DataFrame, questions: DataFrame, passages: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, citations array<struct<rank,id,label,score,sentence>>): up to ``most`` quotes that say different things.

    Passages (id, text and, if any, doc_id and section) are taken as ranked; if the question wants a time those
    that state a duration come first. A passage is passed over if the first HEAD characters of it, or of one cited
    before, are part of the other, if it has no sentence to quote, or if its best one was quoted. A question
    without any quote has no row.
    """
    doc, section = (F.col(c).cast("string") if c in passages.columns else F.lit(None).cast("string") for c in ("doc_id", "section"))
    texts = passages.select("id", "text", doc.alias("__doc"), section.alias("__section"))
    terms = questions.select("query_id", F.array_distinct(F.filter(expanded(F.col("text")), lambda t: F.length(t) >= 3)).alias("terms"), wants_time(F.col("text")).alias("timed"))
    texts = texts.join(ranked.select("id").distinct(), "id", "left_semi")  # the ids are few and go to the texts
    hits = written(ranked.join(terms, "query_id").join(texts, "id").withColumn("key", F.struct("query_id", "id")), "hits")
    quotes = best_sentences(hits, "key", "text", "terms", 1).select("id.query_id", "id.id", "sentence")
    late = F.col("timed") & ~F.col("text").rlike(DURATION)
    label = citation_label(F.coalesce("__doc", F.col("id").cast("string")), F.coalesce("__section", F.lit("")))
    hits = hits.join(quotes, ["query_id", "id"])  # a passage without a quote is never cited
    row = F.struct(late.cast("int").alias("late"), F.col("rank").alias("at"), "id", label.alias("label"), "score", "sentence", collapsed(F.col("text")).alias("text"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # as many as a question has ranked passages
    kind = dict(hits.dtypes)
    item = f"struct<rank:int,id:{kind['id']},label:string,score:double,sentence:string,text:string>"

    def take(acc: Column, x: Column) -> Column:
        head = F.substring(x["text"], 1, HEAD)
        said = F.exists(acc, lambda y: F.contains(y["text"], head) | F.contains(head, y["text"]) | (y["sentence"] == x["sentence"]))
        fresh = F.struct((F.size(acc) + 1).alias("rank"), x["id"].alias("id"), x["label"].alias("label"), x["score"].cast("double").alias("score"), x["sentence"].alias("sentence"), x["text"].alias("text"))
        return F.when((F.size(acc) < most) & ~said, F.concat(acc, F.array(fresh))).otherwise(acc)

    chosen = F.aggregate("rows", F.array().cast(f"array<{item}>"), take)
    return rows.select("query_id", F.transform(chosen, lambda x: x.dropFields("text")).alias("citations"))


def answers(ranked: DataFrame, questions: DataFrame, passages: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, refused, reason, confidence, citations, scope_note) of each question.

    ``ranked`` (query_id, id, rank, score) holds the best passages, ``questions`` (query_id, text), ``passages``
    (id, text). A question whose best score is below the threshold is refused, then one outside the domain, then
    one for which no passage has a quotable sentence.
    """
    best = ranked.groupBy("query_id").agg(F.max("score").alias("confidence"))
    rows = questions.join(best, "query_id", "left").join(citations(ranked, questions, passages, most), "query_id", "left")
    reason = F.when(F.trim("text") == "", "blank").when(F.coalesce("confidence", F.lit(0.0)) < THRESHOLD, "below threshold").when(~in_domain(F.col("text")), "out of domain").when(F.col("citations").isNull(), "nothing to quote")
    return rows.select("query_id", reason.isNotNull().alias("refused"), reason.alias("reason"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(reason.isNull(), F.col("citations")).alias("citations"), needs_scope_note(F.col("text")).alias("scope_note"))
