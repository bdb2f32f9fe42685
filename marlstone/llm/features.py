"""Numeric features of whole texts for the classifiers, computed for an Arrow batch at a time."""

from __future__ import annotations

import numpy as np

from .bytehash import chunks, lower_ascii, mix, prefix, range_hash, words

TERMS = 512
SHAPES = 20
_SYMBOLS = np.zeros(256, np.uint8)
for _i, _group in enumerate(("#&*$%@~^", "!?", "|", ".,;:", "<>{}[]()=_/\\+", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\n", "-'\""), 1):
    _SYMBOLS[[ord(c) for c in _group]] = _i
_LINES = np.zeros(256, bool)
_LINES[10] = True


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(h ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    return np.bincount(row[first], minlength=n)


def quality_features(column) -> np.ndarray:
    """(rows, TERMS + SHAPES): weights of hashed letter triples, then shares that tell prose from junk."""
    out = np.zeros((len(column), TERMS + SHAPES), np.float32)
    for lo, hi, data, at in chunks(column):
        n = hi - lo
        size = np.diff(at)
        row = np.repeat(np.arange(n), size)
        if len(data) >= 3:
            d = data.astype(np.uint32)
            code = ((d[:-2] * 7919 + d[1:-1] * 104729 + d[2:] * 1299709) >> np.uint32(5)) % TERMS
            inside = row[:-2] == row[2:]
            tf = np.bincount(row[:-2][inside] * TERMS + code[inside], minlength=n * TERMS).reshape(n, TERMS)
            tf = np.log1p(tf)
            out[lo:hi, :TERMS] = tf / np.maximum(np.sqrt((tf**2).sum(1, keepdims=True)), 1e-9)
        share = np.zeros((n, SHAPES))
        kinds = np.bincount(row * 10 + _SYMBOLS[data], minlength=n * 10).reshape(n, 10)
        share[:, :9] = np.sqrt(kinds[:, 1:] / np.maximum(size, 1)[:, None])
        start, end, w = words(data, at)
        p = prefix(data)
        h = range_hash(p, start, end)
        count = np.bincount(w, minlength=n)
        many = np.maximum(count, 1)
        share[:, 9] = _distinct(h, w, n) / many
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
        share[:, 10] = np.bincount(w[again], minlength=n) / many
        share[:, 11] = np.bincount(w, end - start, minlength=n) / many / 10
        share[:, 12] = np.log1p(count) / 10
        last, first = data[end - 1] if len(end) else data[:0], data[start] if len(start) else data[:0]
        share[:, 13] = np.bincount(w[np.isin(_SYMBOLS[last], (1, 2, 3))], minlength=n) / many
        share[:, 14] = np.bincount(w[_SYMBOLS[first] == 7], minlength=n) / many
        share[:, 15] = np.bincount(w[end - start == 1], minlength=n) / many
        share[:, 16] = np.bincount(w[end - start > 14], minlength=n) / many
        ls, le, lw = words(data, at, _LINES)
        lines = np.maximum(np.bincount(lw, minlength=n), 1)
        share[:, 17] = _distinct(range_hash(p, ls, le), lw, n) / lines
        share[:, 18] = np.log1p(lines) / 10
        share[:, 19] = np.bincount(row[data >= 128], minlength=n) / np.maximum(size, 1)
        out[lo:hi, TERMS:] = share
    return out


def word_ids(column, buckets: int, stems: int, stem_bytes: int = 4):
    """(first row, rows, word bucket, stem bucket, row) of the lower-cased words of some rows at a time."""
    separators = np.ones(256, bool)
    separators[128:] = False
    separators[ord("a") : ord("z") + 1] = False
    separators[ord("A") : ord("Z") + 1] = False
    for lo, hi, data, at in chunks(column):
        data = lower_ascii(data)
        start, end, row = words(data, at, separators)
        p = prefix(data)
        whole = range_hash(p, start, end) % np.uint64(buckets)
        stem = range_hash(p, start, np.minimum(end, start + stem_bytes)) % np.uint64(stems)
        yield lo, hi - lo, whole.astype(np.int64), stem.astype(np.int64), row
