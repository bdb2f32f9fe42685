"""Personal data: recognised identifiers, and the terms that give them away by corpus co-occurrence.

Identifiers are found by fixed patterns. For each identifier the corpus tells which terms keep its company:
PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e))) compared with the information of the identifier itself,
IC(e) = log2(N / n(e)), with all counts in different texts. The same is asked of the group that an identifier is
of, such as its domain. A term whose share PMI / IC reaches a threshold discloses the identifier or group; where
both stand in one document the term is generalised to its shape, or removed if the share reaches a second one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .bytehash import chunks, lower_ascii, mix, prefix, range_hash, tidy, words
from .scratch import saved

NO_ID = -(1 << 63)
KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an identifier that count as its company.
COMPANY = 6
#: The weight of a document; n copies of a text have an n-th of it each.
ONE = 1 << 32
GENERALISE, REMOVE = 0.6, 0.9
#: Words of fewer characters are never terms; README has the figures with and without them.
SHORTEST = 3
#: A table of at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Words for co-occurrence: letters and digits of ASCII and all other code points, A-Z lower-cased.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TERM_SEPARATORS = np.zeros(256, bool)
TERM_SEPARATORS[:128] = True
for _c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    TERM_SEPARATORS[ord(_c)] = False
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def luhn(digits: str) -> bool:
    doubled = [int(c) for c in digits[::-1]]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all identifiers, by start and then kind; offsets are code points."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            at = m.start()
            while at > last and text[at - 1] in LOCAL:
                at -= 1
            if at < m.start():
                last = m.end()
                out.append((at, 0, last))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def identity(text: str, span: tuple[int, int, int]) -> str:
    """What makes two identifiers the same one."""
    start, kind, end = span
    value = text[start:end]
    return f"{KINDS[kind]}:{value.translate(UPPER) if kind < 2 else re.sub('[^0-9]', '', value)}"


def _term_keys(terms: list[str]) -> np.ndarray:
    column = pa.array(terms, pa.string())
    out = np.zeros(len(terms), np.uint64)
    for lo, hi, data, at in chunks(column):
        out[lo:hi] = range_hash(prefix(data), at[:-1], at[1:])
    return out


def groups(name: str) -> tuple[str, str]:
    """An identifier and the group it is of: an e-mail's domain, an address's first two parts, the issuer of a card, a phone's digits but the last seven."""
    kind, value = name.split(":", 1)
    if kind == "email":
        return name, "email@" + value.rsplit("@", 1)[1]
    if kind == "ip":
        return name, "ip/" + ".".join(value.split(".")[:2])
    return name, f"{kind}/" + (value[:6] if kind == "card" else value[:-7])


def company(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(mark, entity, who, term, key) of the terms around each identifier, for it and its group; term and key are null in one row of each, which counts the identifier.

    ``who`` and ``key`` are hashes of the identifier and of the term. Terms have ``shortest`` characters or more.
    """

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple] = set()
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                spans = base_spans(text)
                if not spans:
                    continue
                found = [(m.start(), m.end(), m.group()) for m in TERM.finditer(text.translate(UPPER))]
                for span in spans:
                    s, _, e = span
                    before, after = bisect_right(found, s, key=lambda x: x[1]), bisect_left(found, e, key=lambda x: x[0])
                    near = {x[2] for x in found[max(0, before - COMPANY) : before] + found[after : after + COMPANY] if len(x[2]) >= shortest}
                    for name in groups(identity(text, span)):
                        rows.add((mark, name, None))
                        rows.update((mark, name, t) for t in near)
            if rows:
                marks, names, terms = (list(x) for x in zip(*rows))
                none = np.array([t is None for t in terms])
                keys, who = _term_keys([t or "" for t in terms]), _term_keys(names)
                columns = [pa.array(marks, pa.int64()), pa.array(names), pa.array(who.astype(np.int64)), pa.array(terms, pa.string()), pa.array(keys.astype(np.int64), mask=none)]
                yield pa.RecordBatch.from_arrays(columns, names=["mark", "entity", "who", "term", "key"])

    return docs.mapInArrow(tidy(around), "mark long, entity string, who long, term string, key long")


def document_frequency(docs: DataFrame, wanted: DataFrame, n: int | None = None) -> DataFrame:
    """(key, documents) for the terms of ``wanted`` (key): the weights of the rows of ``docs`` (weight, text) each is in, in documents."""
    n = n or exchange.buckets(docs)

    def counted(batch):
        held = []
        weights = batch.column(0).to_numpy()
        for lo, _, data, at in chunks(batch.column(1)):
            data = lower_ascii(data)
            start, end, row = words(data, at, TERM_SEPARATORS)
            h = range_hash(prefix(data), start, end)
            _, first = np.unique(h ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)  # once a document
            keys, back = np.unique(h[first], return_inverse=True)
            held.append((keys, np.bincount(back, weights[row[first] + lo], len(keys))))
        if held:
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            yield keys, np.bincount(back, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

    def asked(batch):
        keys = batch.column(0).to_numpy().astype(np.uint64)
        yield keys, np.zeros(len(keys), np.int64)

    def answer(batches):
        for bucket, keys, counts in exchange.gathered(batches):
            want = np.unique(keys[counts == 0])
            at = np.searchsorted(want, keys)
            hit = (at < len(want)) & (want[np.minimum(at, max(0, len(want) - 1))] == keys) if len(want) else np.zeros(len(keys), bool)
            total = np.zeros(len(want), np.int64)
            np.add.at(total, at[hit], counts[hit])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(want), bucket, np.int32)), pa.array(want.astype(np.int64)), pa.array(total / ONE)], names=["bucket", "low", "documents"])

    rows = exchange.packed(docs, counted, n).unionByName(exchange.packed(wanted.select("key"), asked, n))
    low = (F.col("key").bitwiseAND(int(exchange.MASK))).alias("low")
    found = rows.repartitionById(n, "bucket").mapInArrow(tidy(answer), "bucket int, low long, documents double")
    # A key and its low bits agree one to one within a bucket; terms of two buckets with equal low bits are one in 2**56.
    return wanted.select("key", low).join(found.select("low", "documents"), "low").select("key", "documents")


def disclosures(docs: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """(who, key, term, share): terms that give an identifier or its group away, over the whole corpus.

    All counts are of different texts: copies of a text weigh as one.
    """
    copies = saved(docs.groupBy("mark").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    total = docs.count() - (copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    counts = near.distinct().groupBy("entity", "who", "term", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = saved(counts, "pairs")
    single = counts.where("term is null").select("entity", F.col("n").alias("n_e"))
    pairs = counts.where("term is not null").withColumnRenamed("n", "n_et")
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    weighed = docs.join(F.broadcast(copies) if few else copies, "mark", "left")
    weighed = weighed.select(F.coalesce(F.round(F.lit(float(ONE)) / F.col("copies")).cast("long"), F.lit(ONE)).alias("weight"), "text")
    frequency = document_frequency(weighed, pairs.select("key").distinct(), exchange.buckets(docs))  # the planner takes a join for far larger
    rows = pairs.join(single, "entity").join(frequency, "key")
    n_t = F.greatest("documents", "n_et")
    pmi, information = F.log2(F.lit(float(total)) * F.col("n_et") / (n_t * F.col("n_e"))), F.log2(F.lit(float(total)) / F.col("n_e"))
    return rows.where(information > 0).select("who", "key", "term", (pmi / information).alias("share")).where(F.col("share") >= threshold)


def shape(term: str) -> str:
    return "[NUMBER]" if term.isdigit() else "[WORD]"


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'term')[k]}:{s}:{e}" for s, k, e in spans)


def term_spans(text: str, base: list[tuple[int, int, int]], share: dict[str, float]) -> list[tuple[int, int, float]]:
    """(start, end, share) of each disclosing word outside the identifiers."""
    starts, ends, last = [s for s, _, _ in base], [], 0  # ends: the farthest of those that begin so far
    for _, _, e in base:
        ends.append(last := max(last, e))
    out = []
    for m in TERM.finditer(text.translate(UPPER)):
        if m.group() in share:
            before = bisect_left(starts, m.end())
            if not before or ends[before - 1] <= m.start():
                out.append((m.start(), m.end(), share[m.group()]))
    return out


def rewrite(text: str, base: list[tuple[int, int, int]], extra: list[tuple[int, int, float]], remove: float) -> str:
    cuts = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base]
    cuts += [(s, e, "" if x >= remove else shape(text[s:e])) for s, e, x in extra]
    parts, at = [], 0
    for s, e, new in sorted(cuts):
        if s >= at:
            parts += [text[at:s], new]
        at = max(at, e)  # an identifier that begins within another goes with it
    return "".join(parts) + text[at:]


def inside(docs: DataFrame) -> DataFrame:
    """(mark, names, keys) of each text (mark, text) with identifiers: hashes of these and their groups, and of its words, once each."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                names = {g for span in base_spans(text) for g in groups(identity(text, span))}
                if names:
                    out.append((mark, *(_term_keys(list(x)).astype(np.int64) for x in (names, set(TERM.findall(text.translate(UPPER)))))))
            if out:
                marks, *lists = zip(*out)
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), *lists], names=["mark", "names", "keys"])

    found = docs.select("mark", "text").mapInArrow(tidy(every), "mark long, names array<long>, keys array<long>")
    return found.groupBy("mark").agg(F.first("names").alias("names"), F.first("keys").alias("keys"))


def disclosed(held: DataFrame, given: DataFrame) -> DataFrame:
    """(mark, term, share) of the terms of ``given`` that stand in a text of ``held`` together with what they disclose.

    A text's words meet ``given`` first and its identifiers then, so a text of n words and m identifiers makes
    n + m rows and those of its disclosing words, never n times m. A word reaches the threshold only for
    identifiers that a fixed part of its texts have, so common words have few.
    """
    few = given.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = held.select("mark", F.explode("keys").alias("key")).join(F.broadcast(given) if few else given, "key")
    named = held.select("mark", F.explode("names").alias("who"))
    return met.join(named, ["mark", "who"]).groupBy("mark", "term").agg(F.max("share").alias("share"))


def _terms(docs: DataFrame, generalise: float, shortest: int) -> tuple[DataFrame, bool]:
    """(id, terms, shares) of the texts (mark, text) with disclosing words, by mark, and whether they are few enough to broadcast."""
    docs = docs.select("mark", "text")
    near = saved(company(docs, shortest), "company")
    given = saved(disclosures(docs, near, generalise), "disclosures")
    terms = disclosed(saved(inside(docs), "inside"), given).groupBy(F.col("mark").alias("id"))
    terms = saved(terms.agg(F.sort_array(F.collect_list(F.struct("term", "share"))).alias("x")).select("id", F.col("x.term").alias("terms"), F.col("x.share").alias("shares")), "terms")
    return terms, terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, generalise: float = GENERALISE, remove: float = REMOVE, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans[, text]) of every row.

    ``base`` lists the identifiers as kind:start:end by start, then kind; ``spans`` those and, as kind term, the
    words that disclose an identifier of the same document. A text is known by a 64-bit hash. In ``text`` identifiers become [KIND], disclosing
    words their shape, or nothing if their share reaches ``remove``. A null text is empty; a null id is a
    document like others; rows that repeat an id are each judged by their own text; copies of a text count once, so they give no evidence. Other columns are
    ignored. An empty table gives an empty table.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    terms, few = _terms(docs, generalise, shortest)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"] + ["text"] * with_text

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            out: list[tuple] = []
            for i, text, terms, shares in zip(*(batch.column(c).to_pylist() for c in range(4))):
                text = text or ""
                base, extra = base_spans(text), []
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                if terms:
                    extra = term_spans(text, base, dict(zip(terms, shares)))
                every = sorted([(s, k, e) for s, k, e in base] + [(s, len(KINDS), e) for s, e, _ in extra])
                row = (i, *counts, listed(base), listed(every))
                out.append(row + (rewrite(text, base, extra, remove),) if with_text else row)
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.string()) for c in cols[5:])], names=names)

    terms = terms.withColumnRenamed("id", "mark")
    rows = docs.join(F.broadcast(terms) if few else terms, "mark", "left").select("id", "text", "terms", "shares")
    out = rows.mapInArrow(tidy(judged), ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base string", "spans string"] + ["text string"] * with_text))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def rewritten(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and any others) with sanitised texts and their lengths; a null text stays null."""
    key = F.xxhash64("text")
    terms, few = _terms(docs.select(key.alias("mark"), "text"), generalise, shortest)
    terms = terms.select(F.col("id").alias("__id"), F.col("terms").alias("__terms"), F.col("shares").alias("__shares"))
    rows = docs.join(F.broadcast(terms) if few else terms, key == F.col("__id"), "left").drop("__id")
    at = docs.columns.index("text")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, shares = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out: list[str | None] = []
            for x, t, s in zip(batch.column(at), terms, shares):
                text = x.as_py()
                base = base_spans(text or "")
                extra = term_spans(text, base, dict(zip(t, s))) if t and text else []
                out.append(rewrite(text, base, extra, remove) if base or extra else text)
            cols = batch.columns[:-2]
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-2])

    out = rows.mapInArrow(tidy(judged), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out
