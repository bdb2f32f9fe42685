"""Exact top-k inner products by dual-tree search over cover trees.

Vectors and queries are dealt into cells around a few pivots, each with its covering radius. A cell of vectors
goes to a cell of queries only if the bound of the two balls reaches the worst kth score that a sample already
warrants; what can't reach it is never moved. In a task cover trees are built over the queries and over each cell
of vectors and walked together: by the covering radii no product below a pair of nodes exceeds
q.p + |q|Rp + |p|Rq + RqRp, and a pair whose bound is below the worst kth score of its queries is pruned; in a
pair of leaves each query has a bound of its own. All arithmetic is on integers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import saved

#: Cells of a dimension at most; pivots are taken from a sample of so many rows.
PIVOTS = 64
SAMPLE = 512
#: Rows of a task's vectors and of its queries, about.
BLOCK = 4096
QUERY_BLOCK = 8192
LEAF = 16
#: Vectors of leaves that a leaf of queries meets at once.
TOGETHER = 512


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    norm: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


@dataclass
class Count:
    """Products of a query and a vector: those that a bound spared, for whole nodes and in leaves, and those computed."""

    by_nodes: int = 0
    in_leaves: int = 0
    computed: int = 0

    @property
    def share(self) -> float:
        return (self.by_nodes + self.in_leaves) / max(1, self.by_nodes + self.in_leaves + self.computed)


def farthest_first(x: np.ndarray, most: int, enough: float) -> tuple[list[int], np.ndarray, float]:
    """(centres, nearest centre of each row, covering radius): each new centre is the row farthest from those before.

    Ends once the radius is ``enough`` or there are ``most`` centres. Centres lie at least the covering radius apart.
    """
    square = (x**2).sum(1)
    from_ = lambda i: np.sqrt(np.maximum(square + square[i] - 2 * (x @ x[i]), 0))
    centres, nearest = [0], np.zeros(len(x), np.int64)
    near = from_(0)
    while len(centres) < most and near.max() > enough:
        far = int(near.argmax())
        d = from_(far)
        closer = d < near
        near[closer], nearest[closer] = d[closer], len(centres)
        centres.append(far)
    return centres, nearest, float(near.max())


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """A node's rows lie within its radius of its centre, and its children's centres at least their covering radius apart.

    Children cover their rows within half their parent's radius, unless that takes more than a child for each LEAF
    rows, as it does where vectors have no structure; then within what so many children give. A node of at most
    LEAF rows, or of equal ones, is a leaf.
    """
    rows = np.arange(len(x)) if rows is None else rows
    centre = x[rows[0]]
    radius = float(np.sqrt(((x[rows] - centre) ** 2).sum(1)).max())
    node = Node(centre, radius, float(np.sqrt((centre**2).sum())), rows)
    if len(rows) > LEAF and radius:
        centres, nearest, _ = farthest_first(x[rows], max(2, math.ceil(len(rows) / LEAF)), radius / 2)
        for i, c in enumerate(centres):
            nearest[c] = -1  # a child's centre comes first among its rows
            node.children.append(cover_tree(x, np.r_[rows[c], rows[nearest == i]]))
    return node


class Best:
    """The k best (score, smaller id first) of each query so far; an empty place has score -inf."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.worst = k, floor.copy()
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (queries x ids); -inf is no candidate."""
        s = np.concatenate([self.scores[queries], scores], 1)
        i = np.concatenate([self.ids[queries], np.broadcast_to(ids, scores.shape)], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[queries], self.ids[queries] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.worst[queries] = np.maximum(self.worst[queries], self.scores[queries, -1])


def _slack(bound):
    """A bound with room for the rounding of what it is made of."""
    return bound + np.abs(bound) * 1e-9 + 1e-6


def dual_search(qx: np.ndarray, q_ids: np.ndarray, q_tree: Node, rx: np.ndarray, r_ids: np.ndarray, r_tree: Node, best: Best, count: Count | None = None) -> None:
    """Adds to ``best`` every vector of ``r_tree`` that could be among the k best of a query of ``q_tree``."""
    count = count or Count()
    norms = np.sqrt((qx**2).sum(1))

    def stacked(nodes: list[Node]) -> tuple[np.ndarray, ...]:
        return np.array(nodes, object), np.stack([n.centre for n in nodes]), np.array([n.radius for n in nodes]), np.array([n.norm for n in nodes])

    def pruned(a: Node, nodes: np.ndarray, can: np.ndarray) -> None:
        count.by_nodes += len(a.rows) * sum(len(n.rows) for n in nodes[~can])

    def leaves(a: Node, nodes: list[Node], bounds: np.ndarray) -> None:
        """A leaf of queries against leaves of vectors; ``bounds`` (queries x leaves)."""
        rows, owner = np.concatenate([n.rows for n in nodes]), np.repeat(np.arange(len(nodes)), [len(n.rows) for n in nodes])
        can = (_slack(bounds) >= best.worst[a.rows][:, None]).any(1)
        q, ids = a.rows[can], r_ids[rows]
        count.in_leaves += (len(a.rows) - len(q)) * len(rows)
        count.computed += len(q) * len(rows)
        if not len(q):
            return
        scores = qx[q] @ rx[rows].T
        take = (scores >= best.worst[q][:, None]) & (ids != q_ids[q][:, None])
        some, few = take.any(1), take.any(0)
        if some.any():
            scores[~take] = -np.inf
            best.add(q[some], scores[some][:, few], ids[few])

    # A node of queries goes with all nodes of vectors that its parent could not prune.
    todo = [(q_tree, stacked([r_tree]))]
    while todo:
        a, (nodes, centres, radii, sizes) = todo.pop()
        can = _slack(centres @ a.centre + a.norm * radii + sizes * a.radius + a.radius * radii) >= best.worst[a.rows].min()
        pruned(a, nodes, can)
        if not can.any():
            continue
        nodes, centres, radii, sizes = (x[can] for x in (nodes, centres, radii, sizes))
        if a.children:
            wide = np.array([bool(n.children) and n.radius >= a.radius for n in nodes])
            if wide.any():
                nodes, centres, radii, sizes = stacked([*nodes[~wide], *(c for n in nodes[wide] for c in n.children)])
            todo += [(c, (nodes, centres, radii, sizes)) for c in a.children]
            continue
        ready, columns = [], []
        while len(nodes):  # each query of a leaf has its own bound for each node, level by level
            bounds = qx[a.rows] @ centres.T + norms[a.rows][:, None] * radii
            can = (_slack(bounds) >= best.worst[a.rows][:, None]).any(0)
            pruned(a, nodes, can)
            inner = np.array([bool(n.children) for n in nodes])
            ready += [*nodes[can & ~inner]]
            columns.append(bounds[:, can & ~inner])
            below = [c for n in nodes[can & inner] for c in n.children]
            nodes, centres, radii, _ = stacked(below) if below else (below, None, None, None)
        if ready:
            bounds = np.concatenate(columns, 1)
            order = np.argsort(-bounds.max(0), kind="stable")
            step = np.cumsum([len(ready[i].rows) for i in order]) // TOGETHER
            for part in np.split(order, np.flatnonzero(np.diff(step)) + 1):
                leaves(a, [ready[i] for i in part], bounds[:, part])


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    return np.asarray(flat, np.int64).reshape(len(column), -1)


def _exact(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles where all products are exact in them, else whole numbers of any length."""
    top = [float(np.abs(v).max()) if v.size else 0.0 for v in (x, y)]
    if top[0] * top[1] * max(1, x.shape[1]) < 2**52 and max(top) ** 2 * max(1, x.shape[1]) < 2**52:
        return x.astype(np.float64), y.astype(np.float64)
    return x.astype(object), y.astype(object)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<long>, dim): floor(scale * x) of each component; rows without an id or a whole finite vector go."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, fine))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.size(v).alias("dim"))


def _ranges(numbers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (first, last) joined where they meet."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(numbers):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _tasks(counts: list[int], most: int) -> list[tuple[int, int]]:
    """(first task, number of tasks) of each cell in order: small cells share a task, a large one has several."""
    out, task, held = [], 0, 0
    for n in counts:
        parts = math.ceil(n / most)
        if parts > 1:
            task += held > 0
            out.append((task, parts))
            task, held = task + parts, 0
            continue
        if held and held + n > most:
            task, held = task + 1, 0
        out.append((task, 1))
        held += n
    return out


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` marks its k largest inner products.

    Components count as floor(scale * x). Candidates are all rows with another id and as many components; ties
    go to the smaller id; a query with fewer than k candidates gets all of them. Rows whose id or vector is
    null, or whose vector holds a null, NaN or infinite component, take no part; rows that repeat an id with
    the same vector count once, those with other vectors are candidates of their own, and such an id asks with
    the least of its vectors (fewest components, then in order). Other columns are ignored. An empty table gives
    an empty table.
    """
    spark = vectors.sparkSession
    rows = saved(quantised(vectors, id_col, vector_col, scale).distinct(), "vectors")
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    queries = rows.join(asked, "id", "left_semi").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.v", "x.dim")
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()  # bounded: SAMPLE rows
    known = {d: ([r["id"] for r in sample if r["dim"] == d], np.array([r["v"] for r in sample if r["dim"] == d], np.float64)) for d in {r["dim"] for r in sample}}
    pivots = {d: x[farthest_first(x, PIVOTS, 0.0)[0]] for d, (_, x) in known.items()}

    def celled(with_floor: bool):
        def cells(batches):
            for batch in batches:
                dims = batch.column(2).to_numpy()
                cell, away, floor = np.zeros(len(dims), np.int64), np.zeros(len(dims)), np.full(len(dims), -np.inf)
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    x = _matrix(batch.column(1).take(pa.array(at))).astype(np.float64)
                    p = pivots.get(d, np.zeros((1, d)))
                    far = np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * x @ p.T, 0)
                    cell[at] = far.argmin(1)
                    away[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(1))
                    if with_floor and d in known:  # k candidates of the sample bound the kth score from below, whatever cell they lie in
                        ids = np.array(known[d][0])
                        own = batch.column(0).to_numpy()[at][:, None] == ids
                        s = np.where(own, -np.inf, x @ known[d][1].T)
                        if s.shape[1] >= k:
                            floor[at] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                cols = [*batch.columns, pa.array(cell), pa.array(away), pa.array(floor)]
                yield pa.RecordBatch.from_arrays(cols[: 5 + with_floor], names=["id", "v", "dim", "cell", "away", "floor"][: 5 + with_floor])

        return cells

    placed = saved(rows.mapInArrow(celled(False), "id long, v array<bigint>, dim int, cell long, away double"), "placed")
    queries = saved(queries.mapInArrow(celled(True), "id long, v array<bigint>, dim int, cell long, away double, floor double"), "queries")
    # A few figures for each cell: at most PIVOTS in a dimension.
    v_cells = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).orderBy("dim", "cell").collect()
    q_cells = queries.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r"), F.min("floor").alias("floor")).orderBy("dim", "cell").collect()
    v_tasks, q_tasks = _tasks([c["n"] for c in v_cells], BLOCK), _tasks([c["n"] for c in q_cells], QUERY_BLOCK)

    def reaches(q, v) -> bool:
        d = q["dim"]
        if d != v["dim"]:
            return False
        a, b = (pivots.get(d, np.zeros((1, d)))[c["cell"]] for c in (q, v))
        most = a @ b + math.sqrt(a @ a) * v["r"] + math.sqrt(b @ b) * q["r"] + q["r"] * v["r"]
        return most + abs(most) * 1e-9 + 1e-6 >= q["floor"]

    def sent(cells, tasks, others, other_tasks, meets) -> DataFrame:
        """Where the rows of each cell go: its own tasks, and ranges of the other side's."""
        out = []
        for c, (first, parts) in zip(cells, tasks):
            for lo, hi in _ranges([(t, t + m - 1) for o, (t, m) in zip(others, other_tasks) if meets(c, o)]):
                out.append((c["dim"], c["cell"], first, parts, lo, hi))
        return spark.createDataFrame(out, "dim int, cell long, first int, parts int, lo int, hi int")

    def dealt(df: DataFrame, table: DataFrame, own: str, other: str) -> DataFrame:
        held = df.join(F.broadcast(table), ["dim", "cell"])  # at most PIVOTS ranges for each of PIVOTS cells
        own_task = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
        return held.select("id", "v", "dim", "cell", *(c for c in ("floor",) if c in df.columns), own_task.alias(own), F.explode(F.sequence("lo", "hi")).alias(other))

    left = dealt(queries, sent(q_cells, q_tasks, v_cells, v_tasks, reaches), "qb", "g")
    right = dealt(placed, sent(v_cells, v_tasks, q_cells, q_tasks, lambda v, q: reaches(q, v)), "g", "qb")

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        got: list[tuple[np.ndarray, ...]] = []
        q_dims, r_dims = q.column("dim").to_numpy(), r.column("dim").to_numpy()
        for d in np.intersect1d(q_dims, r_dims):
            qs, rs = q.filter(pa.array(q_dims == d)), r.filter(pa.array(r_dims == d))
            q_ids, r_ids = qs.column("id").to_numpy(), rs.column("id").to_numpy()
            qx, rx = _exact(_matrix(qs.column("v").combine_chunks()), _matrix(rs.column("v").combine_chunks()))
            if qx.dtype == object:  # numbers too large for doubles: every product, no bounds
                for i in range(len(q_ids)):
                    keep = r_ids != q_ids[i]
                    scores = (rx[keep] * qx[i]).sum(1)
                    order = sorted(range(len(scores)), key=lambda j: (-scores[j], r_ids[keep][j]))[:k]
                    got.append((np.full(len(order), q_ids[i]), r_ids[keep][order], np.array([int(scores[j]) for j in order], np.int64)))
                continue
            best = Best(len(q_ids), k, qs.column("floor").to_numpy())
            q_tree, cells = cover_tree(qx), rs.column("cell").to_numpy()
            for c in np.unique(cells):
                dual_search(qx, q_ids, q_tree, rx, r_ids, cover_tree(rx, np.flatnonzero(cells == c)), best)
            i, j = np.nonzero(np.isfinite(best.scores))
            got.append((q_ids[i], best.ids[i, j], best.scores[i, j].astype(np.int64)))
        cols = [np.concatenate(x).astype(np.int64) for x in zip(*got)] if got else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))

    near = left.groupBy("qb", "g").cogroup(right.groupBy("qb", "g")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
