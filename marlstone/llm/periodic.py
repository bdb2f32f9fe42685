"""Periodic runs of words, and texts in which every run is cut back to its first period.

A run is a stretch of words with smallest period q (words q apart are the same) that no neighbouring word extends; only
runs of at least ``least`` words and at least ``times`` periods count.

The sparse diagonal dynamic programme: a word i and an earlier occurrence i - q of the same word lengthen the match on
diagonal q by one; a diagonal that ends with enough matches is a run. Frequent words would give a quadratic number of
such steps, so diagonals are taken by scale. Lags below DENSE are followed word by word. On scale k, for lags from
L = 2**k to 2L - 1, the words are the L-grams that begin at each place, and only the three nearest earlier occurrences
of each count. No run is lost: not all L-grams of a run of at least three matched periods of length q >= L have a period
of L/2 or less (neighbours overlap in L - 1 words and so would share it, and the whole run would have it, against q
being its smallest period), and occurrences of a gram without such a period are more than L/2 apart, so that at most
three begin within 2L places. Work is O(n log n) for a text of n words, whatever it repeats.

Grams are compared by 64-bit hashes; a diagonal that they name is then compared word by word, and where hashes met by
chance all of it is walked anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .scratch import bounded

#: Lags below this are followed word by word; a power of two.
DENSE = 8
#: A gram's nearest earlier occurrences that are taken; the lemma above needs three.
NEAREST = 3
#: Runs have so many words, and so many periods, at least.
LEAST, TIMES = 6, 4

_STEP = np.uint64(0x9E3779B97F4A7C15)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _prefix(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and powers such that ``_hash`` of a stretch depends on its words alone."""
    n = len(ids)
    power = np.full(n + 1, _STEP)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(bytehash.mix(ids.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return total, power


def _alike(total: np.ndarray, power: np.ndarray, a: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from each a - q and from a have the same hash: the earlier sum is lifted by q powers."""
    b = a - q
    return (total[a + size] - total[a]) == (total[b + size] - total[b]) * power[q]


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False]))))
    return edge[::2], edge[1::2]


def _dense(ids: np.ndarray, row: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of diagonals of lag q with ``least`` matches or more."""
    first, last = _stretches((ids[q:] == ids[:-q]) & (row[q:] == row[:-q]))
    long = last - first >= least
    return first[long], last[long] + q


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of the grams of 2 * size words from those of size words; sums of powers would not do, as strings are known that meet in them."""
    out = names.copy()
    out[: max(0, len(names) - size)] += bytehash.mix(names[size:] ^ _STEP)
    return bytehash.mix(out)


def _seeds(names: np.ndarray, room: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of L-grams and their nearest earlier occurrences at lags from L to 2L - 1; ``room``: words up to the text's end."""
    at = np.flatnonzero(room >= size)
    names = names[at]
    order = np.argsort(names, kind="stable")
    at, names = at[order], names[order]
    places, lags = [], []
    for back in range(1, NEAREST + 1):
        lag = at[back:] - at[:-back]
        hit = np.flatnonzero((names[back:] == names[:-back]) & (lag >= size) & (lag < 2 * size))
        places.append(at[back:][hit])
        lags.append(lag[hit])
    return np.concatenate(places), np.concatenate(lags)


def runs(ids: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts, whose words ``ids[at[j]:at[j + 1]]`` are; by start, then period.

    ``times`` is 4 at least: the matched part of a run has three periods then, as the scales need.
    """
    if times < 4:
        raise ValueError("the scales need runs of four periods at least")
    sizes = np.diff(at)
    row = np.repeat(np.arange(len(sizes)), sizes)
    most = int(sizes.max(initial=0))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in range(1, DENSE):
        if most >= max(least, times * q):
            s, e = _dense(ids, row, q, max(least - q, (times - 1) * q))
            found.append((s, e, np.full(len(s), q)))
    names, size = bytehash.mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while size < DENSE:
        names, size = _doubled(names, size), 2 * size
    while most >= max(least, times * size):
        texts = np.flatnonzero(sizes >= max(least, times * size))
        for block in np.array_split(texts, max(1, int(sizes[texts].sum()) // (1 << 20))):
            found.append(_scale(ids, names, at, sizes, block, size, least, times))
        names, size = _doubled(names, size), 2 * size
    s, e, q = (np.concatenate(x).astype(np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    # A stretch that also has a period above its smallest one is found on both diagonals; the smallest stays.
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[first], e[first], q[first]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _scale(ids, names, at, sizes, texts, size, least, times):
    """Diagonals with enough matches of lags from ``size`` to twice that, in some of the texts."""
    n = sizes[texts]
    starts = np.concatenate(([0], np.cumsum(n)))
    where = np.repeat(at[texts] - starts[:-1], n) + np.arange(starts[-1])
    words = ids[where]
    end = np.repeat(starts[1:], n)
    begin = np.repeat(starts[:-1], n)
    total, power = _prefix(words)
    place, lag = _seeds(names[where], end - np.arange(starts[-1]), size)
    inside = place - lag >= begin[place]
    place, lag = place[inside], lag[inside]
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    # Seeds of one lag whose grams touch are one stretch of matches; its first and last seed are lengthened from there.
    new = np.ones(len(place), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (place[1:] > place[:-1] + size)
    lo, q = place[new], lag[new]
    hi = place[np.roll(new, -1)] + size if len(place) else place
    step = 1 << int(n.max()).bit_length()
    while step:
        can = np.flatnonzero(hi + step <= end[lo])
        hi[can] += step * _alike(total, power, hi[can], q[can], step)
        can = np.flatnonzero(lo - step - q >= begin[lo])
        lo[can] -= step * _alike(total, power, lo[can] - step, q[can], step)
        step //= 2
    enough = hi - lo >= np.maximum(least - q, (times - 1) * q)
    named = np.unique(np.stack([lo[enough], hi[enough], q[enough]], axis=1), axis=0)
    out = set()
    for a, b, p in named.tolist():
        left, right = int(begin[a]), int(end[a])
        if not (words[a:b] == words[a - p : b - p]).all() or (b < right and words[b] == words[b - p]) or (a - p > left and words[a - 1] == words[a - 1 - p]):
            same = words[left + p : right] == words[left : right - p]  # hashes met by chance: all stretches of this diagonal
            parts = [(left + p + int(x), left + p + int(y)) for x, y in zip(*_stretches(same))]
        else:
            parts = [(a, b)]
        out.update((x - p, y, p) for x, y in parts if y - x >= max(least - p, (times - 1) * p))
    s, e, q = np.array(sorted(out), np.int64).reshape(-1, 3).T
    back = where[s] - s
    return s + back, e + back, q


def _texts(column: pa.Array, least: int, times: int) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    """(number of words, runs, collapsed text) of consecutive rows."""
    for _, _, data, offsets in bytehash.chunks(column):
        start, end, row = bytehash.words(data, offsets)
        count = np.bincount(row, minlength=len(offsets) - 1)
        at = np.concatenate(([0], np.cumsum(count)))
        ends = np.concatenate(([0], np.cumsum(end - start)))
        packed = data[~bytehash.BLANKS[data]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(packed)]).dictionary_encode()
        s, e, q = runs(words.indices.to_numpy(), at, least, times)
        gone = np.zeros(len(start) + 1, np.int64)
        np.add.at(gone, s + q, 1)
        np.add.at(gone, e, -1)
        keep = np.cumsum(gone[:-1]) == 0
        kept = np.concatenate(([0], np.cumsum(np.add.reduceat(np.r_[keep, False], np.minimum(at[:-1], len(keep))) * (count > 0))))
        lists = pa.LargeListArray.from_arrays(pa.array(kept), words.dictionary.take(words.indices.filter(pa.array(keep))))
        text = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
        owner = np.searchsorted(at, s, "right") - 1
        bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(count)))))
        each = pa.StructArray.from_arrays([pa.array(s - at[owner]), pa.array(e - s), pa.array(q)], ["start", "length", "period"])
        yield count, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), each), text.cast(pa.large_string())


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of each row by start and period, and the text without what they repeat.

    A word goes if a run contains it after that run's first period; kept words are joined by one space. Rows are judged
    alone: ids may be null or repeat, and equal rows come out equal. A null or empty text has no words, no runs and an
    empty result; an empty table gives an empty table; other columns, whatever their names, are not read. A text of any
    length is one piece of work for one task, with about 100 bytes for each of its words.
    """
    bounded(docs.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for count, each, text in _texts(batch.column(1), least, times):
                n = len(count)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(count.astype(np.int64)), each, text.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
                row += n

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(mapped, schema)
