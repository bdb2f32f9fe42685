"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece there is exactly one token that the encoding of the prefix ends with. A token is
that one if it fits the last token of the prefix before it, that is, if BPE leaves the two as they are. So the
table of last tokens grows by one entry for each byte, an append goes on where it ends, and an edit leaves the
entries before it as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import tidy
from .scratch import bounded

#: Bytes of pieces and their ids, with what Python adds to each, that a task remembers: beyond half of it a new half begins, and the one before the last goes.
REMEMBERED_BYTES, OVERHEAD = 32 << 20, 200
#: Pairs of tokens of which a long piece's table remembers whether they fit, and the logarithm of the slots in which a worker remembers it for all others.
REMEMBERED_PAIRS, SLOT_BITS = 300_000, 20
#: Rows whose pieces are looked up together, and bytes of new pieces whose tables grow together.
ROWS, TABLE_BYTES = 250, 1 << 17
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Prefixes:
    """The last tokens of all prefixes of one byte string."""

    def __init__(self, model: Bpe, data: bytes = b""):
        self.model, self.data, self.last = model, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        data, last, ranks, known, fits, longest = self.data, self.last, self.model.ranks, self.model.known_fits, self.model.fits, self.model.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                token = ranks.get(data[start:end])
                if token is None:
                    continue
                if start == 0:
                    break
                pair = last[start - 1] << 32 | token
                fit = known.get(pair)
                if fit is None:
                    fit = known[pair] = fits(pair)
                if fit:
                    break
            else:
                raise ValueError("a byte has no token of its own")
            last.append(token)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Puts ``new`` in place of [start, end); entries before ``start`` are kept."""
        tail = self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.model.tokens[out[-1]])
        return out[::-1]


class Bpe:
    """Ranks of a vocabulary file: lines of a base64 token and its rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        self.known_fits: dict[int, bool] = {}
        # Multiplied by an odd number, modulo 2**bits, a pair gives its slot and, with the bits below, what tells it from others there.
        # A slot holds these of the last pair that was tried, and in the lowest bit whether it fits.
        self._bits = max(max(self.ranks.values()).bit_length(), SLOT_BITS // 2 + 1)
        below = 2 * self._bits - SLOT_BITS
        self._slots = np.full(1 << SLOT_BITS, -1, next(t for t, most in ((np.int16, 14), (np.int32, 30), (np.int64, 62)) if below <= most))
        self._spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        self._held = 0
        self._trie()
        order = sorted(self.tokens)
        self._size = np.zeros(order[-1] + 1, np.int64)
        self._size[order] = [len(self.tokens[i]) for i in order]
        self._place = np.cumsum(self._size) - self._size
        self._bytes = np.frombuffer(b"".join(self.tokens[i] for i in order), np.uint8)

    def _trie(self) -> None:
        """All prefixes of tokens as nodes: sorted steps (node << 8 | byte), the node that each leads to, and a node's token (or -1)."""
        nodes: dict[bytes, int] = {b"": 0}
        for t in self.ranks:
            for end in range(1, len(t) + 1):
                nodes.setdefault(t[:end], len(nodes))
        token = np.full(len(nodes), -1, np.int64)
        steps = np.zeros((len(nodes) - 1, 2), np.int64)
        for x, node in nodes.items():
            token[node] = self.ranks.get(x, -1)
            if x:
                steps[node - 1] = nodes[x[:-1]] << 8 | x[-1], node
        order = np.argsort(steps[:, 0])
        self._step, self._next, self._token = steps[order, 0], steps[order, 1], token

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short byte string: the adjacent pair of lowest rank joins first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=None)
            if best[0] == 1 << 40:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made a token; none for a byte."""
        data = self.tokens[token]
        if len(data) == 1:
            return None
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best = min((self.ranks.get(x + y, 1 << 40), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """From byte to token, what stands at one end while BPE builds it, and the rank that ends its turn."""
        held = self._spines[side]
        if token not in held:
            out, t, until = [], token, 1 << 40
            while True:
                out.append((self.tokens[t], until))
                parts = self._split(t)
                if parts is None:
                    break
                t, until = parts[side], t
            held[token] = out[::-1]
        return held[token]

    def fits(self, pair: int) -> bool:
        """Whether BPE of two tokens' bytes (first << 32 | second) gives the two tokens.

        Merges run by rising rank, so both ends at the seam grow along their spines; the two stay apart unless at
        some time the merge across the seam ranks below what comes next on the left, and not above on the right.
        """
        left, right, ranks = self._spine(pair >> 32, 1), self._spine(pair & 0xFFFFFFFF, 0), self.ranks
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            rank = ranks.get(x + y)
            if rank is not None and rank < until_x and rank <= until_y:
                return False
            if until_x == until_y == 1 << 40:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern, as little-endian 32-bit numbers."""
        data = text.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else Prefixes(self, data).ids()
        return np.array(ids, "<u4").tobytes()

    def _endings(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, starts, tokens): of each byte the tokens that end there within its piece, shortest first."""
        n = len(data)
        live, node = np.arange(n), np.zeros(n, np.int64)
        stop = np.repeat(at[1:], np.diff(at))
        ends, starts, tokens = [], [], []
        for length in range(1, self.longest + 1):
            go = live + length <= stop[live]
            live, node = live[go], node[go]
            step = node << 8 | data[live + length - 1]
            at_step = np.minimum(np.searchsorted(self._step, step), len(self._step) - 1)
            go = self._step[at_step] == step
            live, node = live[go], self._next[at_step[go]]
            if not len(live):
                break
            token = self._token[node]
            hit = token >= 0
            ends.append(live[hit] + length - 1)
            starts.append(live[hit])
            tokens.append(token[hit])
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        return np.searchsorted(end[order], np.arange(n + 1)), np.concatenate(starts)[order], np.concatenate(tokens)[order]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs; a pair stays in its slot, from task to task, until another one takes it."""
        wide = 2 * self._bits
        pairs = left << self._bits | right
        places = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) & np.uint64((1 << wide) - 1)).astype(np.int64)
        slots, marks = places >> wide - SLOT_BITS, places & (1 << wide - SLOT_BITS) - 1
        held = self._slots[slots]
        new = np.flatnonzero(held >> 1 != marks)
        if len(new):
            _, first, back = np.unique(pairs[new], return_index=True, return_inverse=True)
            at = new[first]
            fresh = marks[at] << 1 | np.fromiter(map(self.fits, (left[at] << 32 | right[at]).tolist()), np.int64, len(at))
            self._slots[slots[at]] = fresh
            held[new] = fresh[back]
        return (held & 1).astype(bool)

    def last_tokens(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tables of ``Prefixes`` of many pieces at once, one after the other: all grow by a byte in each round."""
        first, starts, tokens = self._endings(data, at)
        last = np.full(len(data), -1, np.int64)
        size = np.diff(at)
        by = np.argsort(-size, kind="stable")
        base = at[:-1][by]
        many = np.searchsorted(-size[by], -np.arange(size.max()), "left")
        for e, m in enumerate(many.tolist()):
            pos, begin = base[:m] + e, base[:m]
            at_, open_ = first[pos], np.arange(m)
            while len(open_):
                c = at_[open_]
                if (c >= first[pos[open_] + 1]).any():
                    raise ValueError("a byte has no token of its own")
                s, t = starts[c], tokens[c]
                ok = s == begin[open_]
                inner = np.flatnonzero(~ok)
                if len(inner):
                    ok[inner] = self._fit(last[s[inner] - 1], t[inner])
                last[pos[open_[ok]]] = t[ok]
                open_ = open_[~ok]
                at_[open_] += 1
        return last

    def _learn(self, pieces: list[str]) -> None:
        """Puts the ids of new pieces into the memory."""
        raw = [p.encode() for p in pieces]
        long = [i for i, x in enumerate(raw) if len(x) > 64]  # a round for each byte pays for many pieces only
        for i in long:
            self._known[pieces[i]] = self.piece(pieces[i])
            self._held += len(raw[i]) + len(self._known[pieces[i]]) + OVERHEAD
        short = [i for i, x in enumerate(raw) if len(x) <= 64] if long else range(len(raw))
        size = np.array([len(raw[i]) for i in short], np.int64)
        step = np.cumsum(size) // TABLE_BYTES
        cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(size)] if len(size) else []
        for lo, hi in zip(cuts, cuts[1:]):
            at = np.r_[0, np.cumsum(size[lo:hi])]
            part = short[lo:hi]
            last = self.last_tokens(np.frombuffer(b"".join(raw[i] for i in part), np.uint8), at)
            # From each piece's end back over its last tokens.
            ids, owner, end, open_ = [], [], at[1:].copy(), np.arange(hi - lo)
            while len(open_):
                t = last[end[open_] - 1]
                ids.append(t)
                owner.append(open_)
                end[open_] -= self._size[t]
                open_ = open_[end[open_] > at[:-1][open_]]
            owner = np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            flat, count = np.concatenate(ids)[order].astype("<u4"), np.bincount(owner, minlength=hi - lo)
            blob, stops = flat[::-1].tobytes(), 4 * (len(flat) - np.cumsum(count))
            sizes = (4 * count).tolist()
            for i, s, n in zip(part, stops.tolist(), sizes):
                self._known[pieces[i]] = blob[s : s + n]
            self._held += len(blob) + at[-1] + OVERHEAD * len(part)

    def forget(self, everything: bool = False) -> None:
        """Frees the pieces that weren't met since it was last called; with ``everything`` all, and what is known of tokens but the slots of pairs."""
        self._before, self._known, self._held = {} if everything else self._known, {}, 0
        if everything:
            self.known_fits.clear()
            for spines in self._spines:
                spines.clear()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        if self._held > REMEMBERED_BYTES // 2:
            self.forget()
        if len(self.known_fits) > REMEMBERED_PAIRS:
            self.known_fits.clear()
        known, before = self._known, self._before
        pieces = list(map(self.pattern.findall, texts))
        fresh = set(chain.from_iterable(pieces)).difference(known)
        again = fresh.intersection(before) if before else ()
        for p in again:
            known[p] = ids = before[p]
            self._held += len(p) + len(ids) + OVERHEAD
        fresh.difference_update(again)
        if fresh:
            self._learn(list(fresh))
        return [b"".join(map(known.__getitem__, p)) for p in pieces]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, ids: list[bytes]) -> pa.Array:
        """The bytes that each row of ids stands for."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        size = self._size[flat]
        end = np.cumsum(size)
        at = np.repeat(self._place[flat] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        ends = np.r_[0, end][np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int64)]
        if ends[-1] < 1 << 31:
            return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self._bytes[at])])
        raw = self._bytes[at].tobytes()
        return pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all([ids])[0].as_py()


class Editable:
    """An encoded text that takes appends and edits, and encodes only near them again."""

    def __init__(self, model: Bpe, text: str = ""):
        self.model, self.text = model, text
        self.pieces = model.pattern.findall(text)
        self.codes = [model.piece(p) for p in self.pieces]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in place of code points [start, end). The pattern looks one code point beyond a match."""
        first, at = 0, 0
        while first < len(self.pieces) and at + len(self.pieces[first]) < start - 1:
            at += len(self.pieces[first])
            first += 1
        ends, place = {}, at
        for k in range(first, len(self.pieces)):
            ends[place] = k
            place += len(self.pieces[k])
        ends[place] = len(self.pieces)
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        fresh, stop = [], len(self.pieces)
        for m in self.model.pattern.finditer(self.text, at):
            if m.start() >= start + len(new) and m.start() - shift in ends:
                stop = ends[m.start() - shift]
                break
            fresh.append(m.group())
        self.pieces[first:stop] = fresh
        self.codes[first:stop] = [self.model.piece(p) for p in fresh]

    def ids(self) -> bytes:
        return b"".join(self.codes)


_models: dict[tuple[str, str], Bpe] = {}
#: The slots of models that were left.
_slots: dict[tuple[str, str], np.ndarray] = {}


def model(path: str | None = None, pattern: str | None = None) -> Bpe:
    """The model of a worker, read once."""
    key = (path or default_path(), pattern or default_pattern())
    if key not in _models:
        _models[key] = Bpe(*key)
        _models[key]._slots = _slots.setdefault(key, _models[key]._slots)
    return _models[key]


def leave(path: str | None = None, pattern: str | None = None) -> None:
    """Frees the model of a worker, which goes on to tasks of other kinds, but for the slots of pairs: 2 MB with the public vocabulary, whatever was encoded."""
    _models.pop((path or default_path(), pattern or default_pattern()), None)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids binary[, decoded binary]) of every row; ids are little-endian 32-bit numbers.

    ``path`` is the vocabulary file on every machine (the installed public one if None). Special tokens are
    ordinary text. A null text is empty and has no ids; a null id stays null; repeated rows are each encoded.
    Other columns are ignored. An empty table gives an empty table. With ``decoded`` the bytes that the ids
    stand for follow.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = bpe.encode_all([x or "" for x in part.column(1).to_pylist()])
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    cols.append(bpe.decode_all(ids))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])
        del bpe
        leave(path, pattern)  # ``tidy`` gives the memory back

    bounded(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(coded), schema)


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) back to (doc_id, decoded binary); null ids give no bytes."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.decode_all([x or b"" for x in batch.column(1).to_pylist()])], names=["doc_id", "decoded"])

    return encoded.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(tidy(plain), "doc_id long, decoded binary")
