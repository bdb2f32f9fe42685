"""The trie of conversation prefixes: a node for each distinct sequence of first turns, with counts over its subtree.

A turn is known by SHA-256 of its role and text, a prefix by its depth and two running hashes (``scan``). Nodes come from a
grouping by these; every member of a node must have the same last turn and the same parent, else all is hashed anew with
other multipliers, so that no two prefixes share a node.

Counts over subtrees come from a node table. Nodes are dealt out in shards, each of which is a subtree below a node of
many conversations, and a shard's nodes get the slots of a minimal perfect hash of their keys, verified against the keys
in the slots. Counts are scattered into flat arrays by slot and added along parent slots from the deepest nodes upwards.
A node of over SPAN conversations belongs to a shard of the next tier, into which the totals of the lower shards are
scattered; there are as many tiers as powers of SPAN in the number of conversations. A prefix of one conversation only has
no need of a slot: one leaf, no shared text, at most one child.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import mix
from .scan import multipliers, scan
from .scratch import bounded, drop, saved

#: Conversations of a shard's top node at most; a node of more is in the next tier.
SPAN = 4096
#: Rows of whole shards that are worked on together; a larger shard is alone.
ROWS = 100_000
#: Names of at most so many nodes or conversations are broadcast.
BROADCAST_ROWS = 200_000
SEEDS = 4
KEY = ["depth", "h0", "h1"]


class Slots:
    """Minimal perfect hash of distinct keys: keys alone in a cell of a level take it, the others go to the next level.

    A slot is the rank of its cell, and holds its key, so that a key that isn't there is told from one that is.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.slot = np.full(len(keys), -1, np.int64)
        left, taken = np.arange(len(keys)), 0
        while len(left):
            cell = self._cell(keys[left], len(self.levels), size := 2 * len(left) + 1)
            alone = np.bincount(cell, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + taken
            self.levels.append((alone, rank))
            got = alone[cell]
            self.slot[left[got]] = rank[cell[got]]
            taken += int(alone.sum())
            left = left[~got]
        self.keys = np.empty_like(keys)
        self.keys[self.slot] = keys

    @staticmethod
    def _cell(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = np.full(len(keys), np.uint64(level + 1))
        for column in keys.T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column.view(np.uint64))
        return (h % np.uint64(size)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for those that have none."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            cell = self._cell(keys[left], level, len(alone))
            met = alone[cell]
            out[left[met]] = rank[cell[met]]
            left = left[~met]
        out[(out >= 0) & (self.keys[out] != keys).any(axis=1)] = -1
        return out


NODE = "depth long, h0 long, h1 long, conv_id long, n_convs long, n_ends long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
COLUMNS = [x.split()[0] for x in NODE.split(", ")]


def _solved(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Totals of the subtrees of a table of nodes, to which each brings its own count and those from the shards below it."""
    table = Slots(np.stack([rows[c] for c in KEY], axis=1))
    at = table.slot

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[at] = values
        return out

    parent = scattered(table.of(np.stack([rows["depth"] - 1, rows["p0"], rows["p1"]], axis=1)))
    inside = parent >= 0
    depth, conv, convs = (scattered(rows[c]) for c in ("depth", "conv_id", "n_convs"))
    lone = (convs == 1) & (depth > 0)  # what is below it has no slot: one child but for a leaf, and one leaf
    children = scattered(rows["n_children"])
    np.add.at(children, parent[inside], 1)
    children[lone] = 1 - scattered(rows["n_ends"])[lone]
    leaves = scattered(rows["n_leaves"]) + ((children == 0) | lone)
    kept = scattered(rows["saved_tokens"]) + (convs - 1) * scattered(rows["n_bytes"])
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[inside[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(kept, parent[level], kept[level])
    above = np.where(inside, conv[parent], 0)
    return rows | {"n_children": children[at], "n_leaves": leaves[at], "saved_tokens": kept[at], "parent_conv_id": above[at], "inside": inside[at]}


def _shards(rows: DataFrame) -> DataFrame:
    """Nodes with the totals of their subtrees; ``inside``: its parent is in its shard. Rows have the key s0, s1 of their shard."""
    names = [c for c in rows.columns if c not in ("s0", "s1")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
            got = _solved({c: part[c].to_numpy() for c in names})
            yield from pa.table({c: pa.array(got[c], mask=~got["inside"] if c == "parent_conv_id" else None) for c in [*COLUMNS, "p0", "p1", "inside"]}).to_batches(10_000)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            part = pa.Table.from_batches(held)
            s0, s1 = part["s0"].to_numpy(), part["s1"].to_numpy()
            cut = np.flatnonzero((s0[1:] != s0[:-1]) | (s1[1:] != s1[:-1]))  # all shards but the last are whole
            if len(cut):
                yield from done(part.slice(0, int(cut[-1]) + 1))
                held = part.slice(int(cut[-1]) + 1).to_batches()
        if held and sum(b.num_rows for b in held):
            yield from done(pa.Table.from_batches(held))

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "s0", "s1").sortWithinPartitions("s0", "s1").mapInArrow(walk, f"{NODE}, p0 long, p1 long, inside boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, h0, h1, ends_sha256) of nodes where conversations end. Ids of a node are joined in every partition of a global
    order, so that those of one node may lie in many; the hash itself then runs over the joined parts, which one task reads in turn.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            ids = batch.column(3).to_numpy()
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            parts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(first, np.r_[first[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[first, i]) for i in range(3)), pa.array(np.full(len(first), pid)), pa.array(seq + np.arange(len(first))), pa.array(parts)], names=[*KEY, "pid", "seq", "part"])
            seq += len(first)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            for *now, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 5))):
                if now != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = now, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(part.encode())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*KEY, "ends_sha256"])
                out = []
        if key:
            out.append((*key, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*KEY, "ends_sha256"])

    ids = rows.select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    parts = ids.mapInArrow(join, "depth long, h0 long, h1 long, pid long, seq long, part string")
    return parts.repartition(n, *KEY).sortWithinPartitions(*KEY, "pid", "seq").mapInArrow(digest, "depth long, h0 long, h1 long, ends_sha256 string")


def turns(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, digest, n_bytes, turn): what the trie needs of each turn. A null role or text is an empty one; rows without a conversation's id go."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = convs.where(F.col(conv_col).isNotNull())
    return rows.select(F.col(conv_col).cast("long").alias("key"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.col(turn_col).alias("turn"))


def in_order(turns: DataFrame) -> DataFrame:
    """``turns`` with i, their number in the conversation by turn, null first; equal turns are ordered by their digest."""
    return scan(turns, [F.col("turn").asc_nulls_first(), F.col("digest")]).drop("h0", "h1")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _paths(rows: DataFrame, seed: int) -> DataFrame:
    """Of ``scan``'s rows the prefixes (conv_id, depth, h0, h1), with the hashes p0, p1 of that which is one turn shorter, as the hash itself gives them.

    With h and p the first two words of the turn's digest are settled; w2 and w3 are the others.
    """
    inverse = [pow(m, -1, 1 << 64) for m in multipliers(seed)]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u8").reshape(batch.num_rows, -1)
                p = [(batch.column(j + 2).to_numpy().view(np.uint64) - words[:, j]) * np.uint64(m) for j, m in enumerate(inverse)]
                more = [*(x.view(np.int64) for x in p), *(np.ascontiguousarray(words[:, j]).view(np.int64) for j in (2, 3))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], batch.column(6), *map(pa.array, more)], names=["conv_id", "depth", "h0", "h1", "n_bytes", "last", "p0", "p1", "w2", "w3"])

    columns = [F.col("key").alias("conv_id"), (F.col("i") + 1).alias("depth"), "h0", "h1", "n_bytes", "digest", "last"]
    return rows.select(*columns).mapInArrow(back, "conv_id long, depth long, h0 long, h1 long, n_bytes long, last boolean, p0 long, p1 long, w2 long, w3 long")


def _nodes(rows: DataFrame, order: list[Column], ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes of every conversation, and the nodes: a row for each distinct prefix, verified to be one prefix."""
    for seed in range(SEEDS):
        kept = scan(rows, order, seed)
        paths = saved(_paths(kept, seed), "paths")
        drop(kept)
        some = paths.where("last").select("conv_id", F.lit(False).alias("last"))
        zeros = [F.lit(0).cast("long").alias(c) for c in ("depth", "h0", "h1", "n_bytes", "p0", "p1", "w2", "w3")]
        full = paths.unionByName(ids.join(some, "conv_id", "left").select("conv_id", F.coalesce("last", F.lit(True)).alias("last"), *zeros))
        same = [F.min(c) == F.max(c) for c in ("p0", "p1", "w2", "w3")]
        one = [F.min(c).alias(c) for c in ("conv_id", "p0", "p1", "n_bytes")]
        nodes = saved(full.groupBy(*KEY).agg(*one, F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"), reduce(lambda a, b: a & b, same).alias("one")), "nodes")
        if not nodes.where("not one").limit(1).count():
            return full, nodes.drop("one")
    raise RuntimeError("prefixes met under one pair of hashes with every seed")


def trie(rows: DataFrame, order: list[Column], ids: DataFrame) -> DataFrame:
    """A row for each node of the conversations ``rows`` (key, digest, n_bytes and the columns of ``order``), with the root.

    ``ids`` (conv_id, distinct) names all conversations, those without turns too. Gives depth, conv_id (the smallest
    member), parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without
    conversations there is no row. Repeated rows are turns of their own.
    """
    bounded(rows.sparkSession)
    paths, nodes = _nodes(rows, order, ids)
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    nodes = nodes.select("*", *zero)
    # Of the prefixes of one conversation alone, the shortest is a child of a shared node; what is below it is known.
    alone = nodes.where("n_convs = 1 and depth > 0")
    top = saved(alone.groupBy("conv_id").agg(F.min("depth").alias("top")), "top")
    alone = alone.join(top, "conv_id")
    known = alone.where("depth > top").select(*KEY, "conv_id", "n_convs", "n_ends", F.col("conv_id").alias("parent_conv_id"), (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    todo = saved(nodes.where("n_convs > 1 or depth = 0").unionByName(alone.where("depth = top").drop("top")), "todo")
    most = int(todo.agg(F.max("n_convs")).first()[0] or 0)
    out, orphans, low, span = [], [], 0, SPAN
    while low < most:
        part = todo.where((F.col("n_convs") > low) & ((F.col("n_convs") <= span) | (F.lit(span) >= most)))
        if orphans:  # totals of the shards below
            below = orphans[-1].groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("h0"), F.col("p1").alias("h1")).agg(F.count(F.lit(1)).alias("b_children"), F.sum("n_leaves").alias("b_leaves"), F.sum("saved_tokens").alias("b_saved"))
            part = todo.where(F.col("n_convs") > low).join(saved(below, "below"), KEY, "left")
            for a, b in (("n_children", "b_children"), ("n_leaves", "b_leaves"), ("saved_tokens", "b_saved")):
                part = part.withColumn(a, F.col(a) + F.coalesce(b, F.lit(0)))
            part = part.drop("b_children", "b_leaves", "b_saved")
            if span < most:  # nodes of later tiers keep what they got for their own turn
                later = saved(part, "todo")
                todo, part = later, later.where(F.col("n_convs") <= span)
        if span >= most:
            keyed = part.select("*", F.lit(0).cast("long").alias("s0"), F.lit(0).cast("long").alias("s1"))
        else:
            big = saved(todo.where((F.col("n_convs") > span) & (F.col("depth") > 0)).select(*KEY), "big")
            cut = paths.join(_few(big), KEY, "left_semi").groupBy("conv_id").agg(F.max("depth").alias("cut"))
            owners = saved(part.select("conv_id").distinct(), "owners")
            at = paths.where("depth > 0").select("conv_id", "depth", F.col("h0").alias("s0"), F.col("h1").alias("s1")).join(_few(owners), "conv_id", "left_semi").join(cut, "conv_id", "left")
            at = at.where(F.col("depth") == F.coalesce("cut", F.lit(0)) + 1).select("conv_id", "s0", "s1")
            keyed = part.join(at, "conv_id")
        solved = saved(_shards(keyed.select(*KEY, "p0", "p1", "conv_id", "n_convs", "n_ends", "n_bytes", "n_children", "n_leaves", "saved_tokens", "s0", "s1")), "solved")
        out.append(solved)
        orphans.append(solved.where("not inside and depth > 0"))
        low, span = span, span * SPAN
    # The top of a shard learns its parent's smallest member from the tier where the parent is.
    names = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h0").alias("p0"), F.col("h1").alias("p1"), F.col("conv_id").alias("above"))
    tops = [o.join(_few(saved(names.join(_few(saved(o.select("depth", "p0", "p1").distinct(), "wanted")), ["depth", "p0", "p1"], "left_semi"), "above")), ["depth", "p0", "p1"], "left").withColumn("parent_conv_id", F.col("above")).select(*COLUMNS) for o in orphans]
    rows_out = known.select(*COLUMNS)
    for o in [*(x.where("inside or depth = 0").select(*COLUMNS) for x in out), *tops]:
        rows_out = rows_out.unionByName(o)
    none = hashlib.sha256(b"").hexdigest()
    got = rows_out.join(_ends(paths.where("last")), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
