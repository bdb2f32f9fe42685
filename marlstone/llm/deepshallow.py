"""Deep-shallow ordering of byte strings: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import sys
from bisect import bisect_left, insort

import numpy as np

#: Bytes to which multikey quicksort goes; longer than the gram that names a place, so that it also parts places of one gram.
SHALLOW = 64
WORD = 8
#: Parts of so few strings are put in order by comparing what is left of the shallow bytes.
FEW = 12


def lce(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the longest common prefix of x and y, of which ``known`` bytes are known to agree."""
    top = min(len(x), len(y))
    if x[known:top] == y[known:top]:
        return top
    lo, step = known, 16
    while x[lo : lo + step] == y[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(lo + step, top)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _words(strings: list[bytes]) -> np.ndarray:
    """The first SHALLOW bytes of each string as big-endian words, short strings filled with zeros."""
    raw = b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    return np.frombuffer(raw, ">u8").reshape(-1, SHALLOW // WORD).astype(np.uint64)


def shallow(strings: list[bytes]) -> list[list[int]]:
    """Groups of indexes in rising order of the first SHALLOW bytes; members of a group agree on them."""
    if not strings:
        return []
    table = _words(strings)
    todo, out = [(np.arange(len(strings)), 0)], []
    while todo:
        at, depth = todo.pop()
        if depth == table.shape[1] or len(at) == 1:
            out.append(at.tolist())
            continue
        if len(at) <= FEW:
            keys = sorted((strings[i][depth * WORD : SHALLOW], i) for i in at.tolist())
            last = None
            for key, i in keys:
                if key == last:
                    out[-1].append(i)
                else:
                    out.append([i])
                last = key
            continue
        column = table[at, depth]
        pivot = column[len(at) // 2]
        less, more = column < pivot, column > pivot
        for part, deeper in ((more, depth), (~(less | more), depth + 1), (less, depth)):
            if part.any():
                todo.append((at[part], deeper))
    return out


class BlindTrie:
    """A trie that keeps of its edges the first byte only; a string is compared in full with one leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        #: A node is [depth, {byte: node or list of indexes}]; byte -1 is the end of a string.
        self.root: list | None = None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [0, {s[0] if s else -1: [i]}]
            return
        path, node = [], self.root
        while True:
            path.append(node)
            depth, children = node
            sym = s[depth] if depth < len(s) else -1
            child = children.get(sym)
            if child is None:
                child = next(iter(children.values()))
            if isinstance(child[0], int) and len(child) == 2 and isinstance(child[1], dict):
                node = child
                continue
            leaf = self.strings[child[0]]
            break
        same = lce(s, leaf)
        if same == len(s) == len(leaf):
            child.append(i) if not (len(child) == 2 and isinstance(child[1], dict)) else None
            return
        at = next((k for k in range(len(path) - 1, -1, -1) if path[k][0] <= same), 0)
        node = path[at]
        mine = s[same] if same < len(s) else -1
        if node[0] == same:
            node[1][mine] = [i]
            return
        sym = leaf[node[0]] if node[0] < len(leaf) else -1
        theirs = leaf[same] if same < len(leaf) else -1
        node[1][sym] = [same, {theirs: node[1][sym], mine: [i]}]


def _is_node(x: list) -> bool:
    return len(x) == 2 and isinstance(x[1], dict)


def ordered(trie: BlindTrie) -> list[list[int]]:
    """Leaves in rising order, each the list of its equal strings."""
    out, todo = [], [trie.root] if trie.root else []
    while todo:
        x = todo.pop()
        if _is_node(x):
            todo.extend(x[1][sym] for sym in sorted(x[1], reverse=True))
        else:
            out.append(x)
    return out


def suffix_order(strings: list[bytes]) -> list[int]:
    """Indexes of ``strings`` in rising order."""
    out: list[int] = []
    for group in shallow(strings):
        if len(group) == 1:
            out.append(group[0])
            continue
        trie = BlindTrie(strings)
        for i in group:
            trie.insert(i)
        for leaf in ordered(trie):
            out.extend(leaf)
    return out


def shared_spans(left: list[bytes], right: list[bytes], least: int, key: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(i, l, r): the last l bytes of left[i] and the first r of right[i] also meet in another place, l + r >= least.

    ``left`` holds the bytes before a place, ``right`` those from it on; only places of one ``key`` are compared.
    Of each i come all spans that no other span of i contains. All right parts are put in suffix order at once;
    for each key a blind trie over the reversed left parts is then closed from its deepest nodes up.
    """
    spans: list[tuple[int, int, int]] = []
    key = key or [0] * len(left)
    groups: dict[int, list[int]] = {}
    for i in suffix_order(right):
        groups.setdefault(key[i], []).append(i)
    for order in groups.values():
        if len(order) > 1:
            _close(order, left, right, least, spans)
    return spans


def _close(order: list[int], left: list[bytes], right: list[bytes], least: int, spans: list[tuple[int, int, int]]) -> None:
    """Adds the spans of places in suffix order.

    Where the places of a trie's node at depth l meet, the smaller side joins the larger one: the neighbour in
    suffix order has the longest right part in common with each newcomer.
    """
    back = [left[i][::-1] for i in order]
    trie = BlindTrie(back)
    for r in range(len(order)):
        trie.insert(r)

    def join(depth: int, large: list[int], small: list[int]) -> None:
        for r in small:
            at = bisect_left(large, r)
            for near in large[max(0, at - 1) : at + 1]:
                i, j = order[r], order[near]
                b = lce(right[i], right[j])
                if depth + b >= least:
                    spans.extend(((i, depth, b), (j, depth, b)))
        if len(small) * 8 > len(large):
            large.extend(small)
            large.sort()
        else:
            for r in small:
                insort(large, r)

    done: dict[int, list[int]] = {}
    todo: list[tuple[list, bool]] = [(trie.root, False)]
    while todo:
        x, open_ = todo.pop()
        if not _is_node(x):
            ranks: list[int] = []
            depth = len(back[x[0]])
            for r in x:
                join(depth, ranks, [r])
            done[id(x)] = ranks
        elif not open_:
            todo.append((x, True))
            todo.extend((child, False) for child in x[1].values())
        else:
            sets = sorted((done.pop(id(child)) for child in x[1].values()), key=len)
            large = sets.pop()
            while sets:
                join(x[0], large, sets.pop())
            done[id(x)] = large


assert sys.byteorder == "little"
