"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Columns of the matrix (n-grams) are dealt out by hash; a column that one document alone has can't add to
any overlap and goes at once. A document whose shared columns are fewer than the overlap that its size
demands goes next. Of the rest, only the first few columns in rising frequency can open a pair (a pair that
misses all of them can't reach the overlap that the sizes demand). For the pairs that are left the product is
computed block by block of columns; overlaps accumulate, and a pair that can't reach the bound of its sizes any
more is discarded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .bytehash import chunks, lower_ascii, mix, prefix, range_hash, tidy, windows, words
from .components import components
from .keys import keyed
from .scratch import drop, saved

#: Stands for a null doc_id where ids are compared.
NO_ID = -(1 << 63)
#: Columns of a block of the product.
COLUMNS = 8192
#: Buckets for each of the session's shuffle partitions: a task holds one, all of whose columns it sorts at once.
BUCKETS = 2
#: Shingles of the documents whose answers meet in one task, but for a single larger document.
PLACE = 2_000_000
#: Logarithm of the ratio of sizes within which documents have a leader in common.
LIKE = 0.1


def shingle_sets(column, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, hash, row) of the distinct k-word shingles of each row, by row."""
    for lo, hi, data, at in chunks(column):
        data = lower_ascii(data)
        start, end, row = words(data, at)
        hashes = range_hash(prefix(data), start, end)
        h, first = windows(hashes, row, k)
        rows = row[first]
        counts = np.bincount(row, minlength=hi - lo)
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):  # the whole sequence is the one shingle
            begin = np.searchsorted(row, few)
            one = np.zeros(len(few), np.uint64)
            for i in range(k - 1):
                has = counts[few] > i
                one[has] = mix(one[has] * np.uint64(31) + hashes[begin[has] + i] + np.uint64(1))
            h, rows = np.r_[h, mix(one ^ counts[few].astype(np.uint64))], np.r_[rows, few]
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        if len(h):
            fresh = np.r_[True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])]
            h, rows = h[fresh], rows[fresh]
        yield lo, hi, h, rows + lo


def set_sizes(docs: DataFrame, k: int) -> DataFrame:
    """(id, n) for every row: how many distinct shingles it has."""

    def sizes(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for _, _, _, rows in shingle_sets(batch.column(1), k):
                n += np.bincount(rows, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["id", "n"])

    return docs.mapInArrow(tidy(sizes), "id long, n long")


def _places(sizes: DataFrame, n: int) -> int:
    """How many tasks the answers of n buckets meet in: as many as the shingles of ``sizes`` need, not more than n.

    A bucket packs a row for each of them, so with n places for n buckets rows would grow with the square of the session's partitions.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return min(n, max(sizes.sparkSession.sparkContext.defaultParallelism, -(-total // PLACE)))


def _able(sent: DataFrame, sizes: DataFrame, percent: int, n: int) -> DataFrame:
    """(id, n, columns, shared) of the rows whose shared columns could reach the overlap that ``sizes`` demand; answers meet in n places.

    ``columns`` are those that others have too, in rising order of (frequency, column).
    """

    def shared(batches):
        for bucket, keys, ids in exchange.gathered(batches):
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            often = np.repeat(c := np.diff(np.r_[starts, len(keys)]), c)
            keep = often > 1
            packed = exchange.replies(ids[keep], [keys[keep] | np.uint64((bucket & 255) << 56), often[keep].astype("<i4")], n)
            yield exchange.reply_batch(packed, ["columns", "frequency"])

    def ordered(batches):
        for batch in batches:
            out = []
            for cs, fs in zip(batch.column(2), batch.column(3)):
                c, f = np.frombuffer(cs.as_buffer(), "<u8"), np.frombuffer(fs.as_buffer(), "<i4")
                out.append(c[np.lexsort((c, f))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), batch.column(4)], names=["id", "n", "columns", "shared"])

    names = ["columns", "frequency"]
    rows = exchange.per_id(sent.mapInArrow(tidy(shared), exchange.reply_schema(names)), names, [8, 4], n)
    rows = rows.withColumn("shared", (F.octet_length("frequency") / 4).cast("long")).join(sizes, "id").where(100 * F.col("shared") >= percent * F.col("n"))
    return rows.select("id", "n", "columns", "frequency", "shared").mapInArrow(tidy(ordered), "id long, n long, columns binary, shared long")


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, need: np.ndarray, width: int = COLUMNS) -> np.ndarray:
    """Overlap of sets[a] and sets[b] for each pair: the sparse product of rows of the incidence matrix, column block by column block.

    Overlaps add up over the blocks; a pair goes (-1) as soon as its overlap and what either row has left can't
    reach ``need``. A row may name a column once only.
    """
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    names, column = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True)
    wide = max(1, len(names))
    cells = np.sort(rows * wide + column)  # the matrix by rows, columns rising
    end = np.searchsorted(cells, (np.arange(len(sets)) + 1) * wide)
    at = np.searchsorted(cells, np.arange(len(sets)) * wide)
    found, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for lo in range(0, wide, width):
        stop = np.searchsorted(cells, np.arange(len(sets)) * wide + min(lo + width, wide))
        i, j = a[alive], b[alive]
        size = stop[j] - at[j]
        owner = np.repeat(np.arange(len(alive)), size)
        entry = cells[np.repeat(at[j] - (np.cumsum(size) - size), size) + np.arange(len(owner))]
        wanted = entry + (i - j)[owner] * wide  # the same columns in the other row
        place = np.minimum(np.searchsorted(cells, wanted), max(0, len(cells) - 1))
        found[alive] += np.bincount(owner[cells[place] == wanted] if len(cells) else owner, minlength=len(alive))
        at = stop
        left = np.minimum(end[i] - stop[i], end[j] - stop[j])
        can = found[alive] + left >= need[alive]
        found[alive[~can]] = -1
        alive = alive[can]
        if not len(alive):
            break
    return found


def links(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose overlap over all columns reaches the bound of their sizes."""

    def product(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(i) for i in range(4))
            both = np.r_[a.to_numpy(), b.to_numpy()]
            _, first, at = np.unique(both, return_index=True, return_inverse=True)
            m = batch.num_rows
            sets = [np.frombuffer((batch.column(4)[int(f)] if f < m else batch.column(5)[int(f) - m]).as_buffer(), "<i8") for f in first]
            total = na.to_numpy() + nb.to_numpy()
            need = -(-percent * total // (100 + percent))
            mask = pa.array(overlaps(sets, at[:m], at[m:], need) >= need)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("columns").alias("ca"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("columns").alias("cb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(tidy(product), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id that links reach.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer than k words has
    its whole sequence as its one shingle. Documents link when 100 * overlap >= percent * union of their
    shingle sets. A text that is null or has no words has an empty set, links with nothing and is its own
    component; every row is a document of its own, whatever its id; a null id counts as an id below all others
    and is returned as null. Shingles count as equal if their hashes are: 56 bits and those of their bucket.
    Other columns of ``docs`` are ignored. An empty table gives an empty table.
    """
    docs, plain = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "id")
    names, docs = docs.select("id", "doc_id"), docs.select("id", "text")
    buckets = BUCKETS * exchange.buckets(docs)
    sizes = saved(set_sizes(docs, k), "sizes")
    places = _places(sizes, buckets)

    def of_texts(batch):
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for _, _, h, rows in shingle_sets(batch.column(1), k):
            yield h, ids[rows]

    def of_classes(batch):
        for i, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            c = mix(np.frombuffer(blob.as_buffer(), "<u8"))
            yield c, np.full(len(c), i)

    rows = saved(_able(exchange.send(docs, of_texts, buckets), sizes, percent, places), "candidates")
    # Documents with the same size and the same shared columns overlap alike with all others: one row of each class goes on.
    # The classes are written before they are joined: then both sides of the join are dealt anew, and a class of very many rows is split.
    mark = saved(rows.select("id", "n", "shared", F.sha2("columns", 256).alias("mark")), "marks")
    reps = saved(mark.groupBy("mark", "n", "shared").agg(F.min("id").alias("rep")), "reps")
    member = saved(mark.join(reps, ["mark", "n", "shared"]).select("id", "rep", "n", "shared"), "members")
    drop(mark)
    drop(reps)
    classes = rows.join(member.where("id = rep").select("id"), "id", "left_semi")
    # Once more among the classes alone: columns that only copies or lost candidates shared go.
    classes = saved(_able(exchange.send(classes.select("id", "columns"), of_classes, buckets), classes.select("id", "n"), percent, places), "classes")
    drop(rows)

    def opening(batches):
        for batch in batches:
            out = []
            for i, n, blob, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                c = np.frombuffer(blob.as_buffer(), "<i8")[: s + percent * n // -100 + 1]
                out.append((c, np.full(len(c), i), np.full(len(c), n), n - s + np.arange(len(c))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["column", "id", "n", "pos"])

    # Two rows whose first common column is at pos can't have more in common than what follows it in either.
    fits = F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) >= F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100 + percent))
    side = lambda df, x: df.select("column", *(F.col(c).alias(c + x) for c in df.columns if c != "column"))
    postings = classes.mapInArrow(tidy(opening), "column long, id long, n long, pos long").withColumn("size", F.floor(F.log("n") / LIKE))
    lead = postings.groupBy("column", "size").agg(F.min(F.struct("id", "n", "pos")).alias("lead"))
    often = saved(postings.groupBy("column").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("column"), "columns")
    lead = lead.join(often, "column", "left_semi").select("column", "size", F.col("lead.id").alias("ida"), F.col("lead.n").alias("na"), F.col("lead.pos").alias("posa"))
    postings = saved(postings.join(often, "column", "left_semi"), "postings")
    stars = side(postings, "b").withColumnRenamed("sizeb", "size").join(lead, ["column", "size"]).where((F.col("ida") != F.col("idb")) & fits)
    stars = saved(stars.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct(), "stars")
    placed = lambda df, parts, node, name: df.join(parts.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    # First each row with one leader, then with the leaders of other components, at last all that is still apart.
    linked = saved(links(classes, stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), percent), "links")
    parts = components(linked)
    apart = placed(placed(stars, parts, "a", "pa"), parts, "b", "pb").where("pa <> pb").select("a", "b")
    linked = saved(linked.unionByName(links(classes, apart, percent)), "links")
    parts = components(linked)
    apart = placed(postings, parts, "id", "part")
    mixed = apart.groupBy("column").agg(F.min("part").alias("c1"), F.max("part").alias("c2")).where("c1 <> c2").select("column")
    apart = saved(apart.join(mixed, "column", "left_semi"), "apart")
    pairs = side(apart, "a").join(side(apart, "b"), "column").where((F.col("ida") < F.col("idb")) & (F.col("parta") != F.col("partb")) & fits)
    linked = saved(linked.unionByName(links(classes, pairs.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct(), percent)), "links")
    # Members of a class link with each other if their size allows; if not, they still share every link of the class.
    within = member.where((F.col("id") != F.col("rep")) & (100 * F.col("shared") >= percent * (2 * F.col("n") - F.col("shared")))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    touched = linked.select(F.col("a").alias("rep")).unionByName(linked.select(F.col("b").alias("rep"))).distinct()
    loose = member.where("id <> rep").join(touched, "rep", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    final = components(linked.unionByName(within).unionByName(loose))
    out = sizes.join(final.withColumnRenamed("node", "id"), "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("part"))
    if plain:
        return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("part").alias("component_id"))
    out = saved(out.join(names, "id").select("doc_id", "n_shingles", "part"), "parts")
    least = saved(out.groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least")), "least")
    return out.join(least, "part").select("doc_id", "n_shingles", F.when(F.col("least") != NO_ID, F.col("least")).alias("component_id"))
