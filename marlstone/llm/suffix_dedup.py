"""Suffix-array dedup: removes every byte that a repeated string of a given length covers.

Sorting the suffixes of all bytes would move hundreds of bytes for each byte of text. Instead each window of
bytes names one place in it (the leftmost smallest hash of its short grams); equal windows name the same place.
So only suffixes at named places are sorted, and of those only the ones whose gram occurs at another place as
well. They are dealt out by their gram, which is shorter than the shallow depth; deep-shallow sorting puts all
suffixes of a task in order, and how far neighbours agree, forwards and backwards, gives the repeated windows
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .bytehash import chunks, gram_hash, mix, prefix, range_hash
from .deepshallow import shared_spans
from .keys import keyed
from .scratch import drop, saved

GRAM = 32
#: Repeated strings of at least so many bytes are reported; passages of some fifty words have 300.
REPORTED = 256
#: Rows whose texts a task holds at once.
ROWS = 1000
#: place -1 is a row of the spans that a text repeats within itself: ``left`` their starts, ``right`` their ends.
PLACES = "bucket int, gram long, id long, place long, left binary, right binary"


def _runs(place: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window start, last window start) of the runs of windows of ``length`` bytes that name one place."""
    held = np.zeros(len(place) + 1, np.int32)
    long = np.diff(at) >= length
    np.add.at(held, at[:-1][long], 1)
    np.add.at(held, at[1:][long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(held)[:-1] > 0)
    place = place[s].astype(np.int64)
    fresh = np.flatnonzero(np.r_[len(s) > 0, place[1:] != place[:-1]])
    return place[fresh], s[fresh], s[np.r_[fresh[1:], len(s)].astype(np.int64)[: len(fresh)] - 1]


def named_places(data: np.ndarray, at: np.ndarray, lengths: tuple[int, ...], gram: int) -> tuple[np.ndarray, ...]:
    """(row, place, context start, context end, gram hash, context hash) of each place that a window of the shortest of ``lengths`` names.

    A place that a longer window names is also named by a shorter one within it; its context holds all windows
    of all lengths that name it. Grams are named for their small hashes, so those are mixed again before they
    deal rows out.
    """
    n = len(data)
    if n < lengths[0]:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    p = prefix(data)
    h = gram_hash(p, gram)
    mask = np.uint64((1 << max(21, n.bit_length())) - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    span, found = 1, None
    for length in lengths:
        if n < length:
            break
        wide = length - gram + 1
        while span * 2 <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        least = low if span == wide else np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        place, s0, s1 = _runs(least & mask, at, length)
        if found is None:
            found = place, s0, s1 + length
        else:
            k = np.searchsorted(found[0], place)
            found[1][k] = np.minimum(found[1][k], s0)
            found[2][k] = np.maximum(found[2][k], s1 + length)
    place, start, end = found
    return np.searchsorted(at, place, "right") - 1, place, start, end, mix(h[place]), range_hash(p, start, end) ^ (place - start).astype(np.uint64)


def local_repeats(data: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stays, repeated): places that go on, one for each context of a row, and places whose context a row has twice."""
    stays, repeated = np.ones(len(row), bool), np.zeros(len(row), bool)
    order = np.lexsort((np.arange(len(row)), context, row))
    same = np.flatnonzero((row[order][1:] == row[order][:-1]) & (context[order][1:] == context[order][:-1]))
    for k in same.tolist():
        i, j = order[k], order[k + 1]
        if np.array_equal(data[start[i] : end[i]], data[start[j] : end[j]]):
            stays[j] = False
            repeated[[i, j]] = True
    return stays, repeated


def _marked(docs: DataFrame) -> DataFrame:
    """(id, z, doc_id): texts squeezed for the shuffle."""

    def small(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress(x.as_buffer() if x.is_valid else b"") for x in batch.column(1)], pa.binary()), batch.column(2)], names=["id", "z", "doc_id"])

    return docs.mapInArrow(small, "id long, z binary, doc_id long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = GRAM, reported: int = REPORTED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_shared, kept binary) of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or
    another. ``n_shared`` counts the bytes that repeated strings of at least ``reported`` bytes cover (length at
    most); nothing is removed for these alone. Texts are judged as UTF-8 bytes and as they come in. A null text
    is empty; shorter texts stay whole; every row is a document of its own, whatever its id. Removal may cut a
    code point, so ``kept`` is binary. Other columns are ignored. An empty table gives an empty table.
    """
    lengths = (reported, length) if reported < length else (length,)
    shortest = lengths[0]
    rows, _ = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "id")
    rows = rows.select("id", "text", "doc_id")
    n = exchange.buckets(rows)
    # Whole copies: all of their bytes go, and one of them stands for the rest in what follows.
    copies = rows.where(F.octet_length("text") >= shortest).select("id", F.sha2("text", 256).alias("mark"))
    groups = saved(copies.groupBy("mark").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "groups")
    whole = saved(copies.join(groups, "mark").select("id", F.col("id").eqNullSafe(F.col("rep")).alias("stands")), "copies")
    drop(groups)

    def grams(batch):
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, _, data, at in chunks(batch.column(1)):
            row, _, start, end, h, context = named_places(data, at, lengths, gram)
            stays, repeated = local_repeats(data, row, start, end, context)
            # A text with repeats of its own asks twice for a key that no other has, so that it gets an answer.
            own = ids[np.unique(row[repeated]) + lo]
            mine = mix(own.astype(np.uint64) * np.uint64(3) + np.uint64(1))
            yield np.r_[h[stays], mine, mine], np.r_[ids[row[stays] + lo], own, own]

    def often(batches):
        for _, keys, ids in exchange.gathered(batches):
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            more = np.repeat(c := np.diff(np.r_[starts, len(keys)]), c) > 1
            yield exchange.reply_batch(exchange.replies(ids[more], [keys[more]], n), ["grams"])

    answers = exchange.send(rows, grams, n).mapInArrow(often, exchange.reply_schema(["grams"]))
    answers = exchange.per_id(answers, ["grams"], [8], n)
    answers = saved(answers.join(whole.where("not stands").select("id"), "id", "left_anti"), "grams")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for i, z, answer in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = wide.decompress(z.as_buffer())
                data = np.frombuffer(text, np.uint8)
                row, place, start, end, h, context = named_places(data, np.array([0, len(data)]), lengths, gram)
                stays, repeated = local_repeats(data, row, start, end, context)
                if repeated.any():
                    out.append((int(exchange.bucket_of(mix(np.array([i]).astype(np.uint64)), n)[0]), 0, i, -1, start[repeated].astype("<i8").tobytes(), end[repeated].astype("<i8").tobytes()))
                k = np.flatnonzero(stays & np.isin(h & exchange.MASK, np.frombuffer(answer, "<u8")))
                b = exchange.bucket_of(h[k], n).tolist()
                at = zip(b, h[k].astype(np.int64).tolist(), place[k].tolist(), start[k].tolist(), end[k].tolist())
                out.extend((bucket, g, i, p, text[s:p], text[p:e]) for bucket, g, p, s, e in at)
                if len(out) > 2_000:
                    yield _places(out)
                    out = []
            if out:
                yield _places(out)

    def _places(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4]), *(pa.array(c, pa.binary()) for c in cols[4:])], names=["bucket", "gram", "id", "place", "left", "right"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        ids: list[int] = []
        places: list[int] = []
        left: list[bytes] = []
        right: list[bytes] = []
        found: list[np.ndarray] = []
        for batch in batches:
            for g, i, p, x, y in zip(*(batch.column(c).to_pylist() for c in range(1, 6))):
                if p < 0:
                    s, e = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                    found.append(np.stack([np.full(len(s), i), s, e], 1))
                else:
                    for column, value in zip((keys, ids, places, left, right), (g, i, p, x, y)):
                        column.append(value)
        spans = shared_spans(left, right, shortest, keys)
        if spans:
            x = np.array(list({*spans}), np.int64)
            place = np.array(places)[x[:, 0]]
            found.append(np.stack([np.array(ids)[x[:, 0]], place - x[:, 1], place + x[:, 2]], 1))
        if found:
            all_ = np.concatenate(found)
            yield exchange.reply_batch(exchange.replies(all_[:, 0], [all_[:, 1].astype("<i8"), all_[:, 2].astype("<i8")], n), ["starts", "ends"])

    squeezed = _marked(rows)
    places = squeezed.join(answers.hint("shuffle_hash"), "id").select("id", "z", "grams").mapInArrow(contexts, PLACES)
    spans = places.repartitionById(n, "bucket").mapInArrow(compare, exchange.reply_schema(["starts", "ends"]))
    spans = saved(exchange.per_id(spans, ["starts", "ends"], [8, 8], n), "spans")
    copied = whole.groupBy("id").agg(F.lit(True).alias("copied"))
    judged = spans.join(copied, "id", "full").select("id", "starts", "ends", F.coalesce("copied", F.lit(False)).alias("copied"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = zstandard.ZstdDecompressor()
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            total, removed, runs, shared, kept = [], [], [], [], []
            for z, starts, ends, copied in zip(batch.column(1), *(batch.column(c).to_pylist() for c in (2, 3, 4))):
                text = wide.decompress(z.as_buffer())
                size = len(text)
                s, e = (np.r_[np.frombuffer(x or b"", "<i8"), [end] * copied].astype(np.int64) for x, end in ((starts, 0), (ends, size)))
                covers = []
                for least in (length, shortest):
                    take = e - s >= least
                    if not take.any():
                        covers.append(None)
                        continue
                    cover = np.zeros(size + 1, np.int64)
                    np.add.at(cover, s[take], 1)
                    np.add.at(cover, e[take], -1)
                    covers.append(np.cumsum(cover)[:-1] > 0)
                gone = covers[0]
                total.append(size)
                shared.append(0 if covers[1] is None else int(covers[1].sum()))
                removed.append(0 if gone is None else int(gone.sum()))
                runs.append(0 if gone is None else int((gone & ~np.r_[False, gone[:-1]]).sum()))
                kept.append(text if gone is None else np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(5), *(pa.array(x, pa.int64()) for x in (total, removed, runs, shared)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_shared", "kept"])

    out = squeezed.join(judged.hint("shuffle_hash"), "id", "left").select("id", "z", "starts", "ends", F.coalesce("copied", F.lit(False)).alias("copied"), "doc_id")
    return out.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, n_shared long, kept binary")
