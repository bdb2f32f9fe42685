"""A key for each row of a table of documents, whatever its ids are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved

#: Keys of rows with a null or repeated id begin here, below all ids in use; the least long itself stays free.
FIRST = -(1 << 63) + 1
#: At most so many repeated ids are broadcast; of more, all rows get new keys.
BROADCAST_ROWS = 200_000


def keyed(docs: DataFrame, id_col: str, name: str) -> tuple[DataFrame, bool]:
    """``docs`` with a long column ``name`` that no two rows share, and whether it is the id everywhere.

    A row keeps its id if no other row has it; rows with a null or repeated id are written once with a number.
    """
    i = F.col(id_col).cast("long")
    often = saved(docs.groupBy(i.alias("__again")).count().where("`count` > 1 or __again is null").select("__again"), "again")
    n = often.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return docs.withColumn(name, i), True
    odd, plain = docs, None
    if n <= BROADCAST_ROWS:
        met = i.eqNullSafe(F.col("__again"))
        odd, plain = docs.join(F.broadcast(often), met, "left_semi"), docs.join(F.broadcast(often), met, "left_anti").withColumn(name, i)
    odd = saved(odd.withColumn(name, F.lit(FIRST) + F.monotonically_increasing_id()), "odd")
    return (plain.unionByName(odd) if plain is not None else odd), False
