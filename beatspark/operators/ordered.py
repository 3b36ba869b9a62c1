"""Order inside keys of any size. No window spans a whole key: rows are dealt by ranges of their first order column
(an hour of a recording, which holds a bounded number of beats), counted there, and only the counts are summed up along a
key. With its number, a row is then dealt into blocks of equal size, to which the last rows of the block before are
added where an operator looks back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a range of the first order column (seconds, where that is a time), and rows of a block.
SPAN, BLOCK = 3600.0, 4096


def slot(column: str, span: float = SPAN) -> Column:
    """The range that a row lies in; missing values come first, as they do in the order."""
    return F.coalesce(F.floor(F.col(column) / F.lit(float(span))).cast("bigint"), F.lit(-(1 << 62)))


def ranked(df: DataFrame, key: str, order: Sequence[str], span: float = SPAN) -> DataFrame:
    """`df` with k, a row's number (from 0) in the order of its key, and n, the rows of the key. A null key is a key."""
    at, group = slot(order[0], span), F.struct(F.col(key))  # a struct, so that null keys meet
    held = df.groupBy(group.alias("__group"), at.alias("__slot")).agg(F.count(F.lit(1)).alias("__held"))
    along = Window.partitionBy("__group")  # a row for each range of a key
    before = held.select("__group", "__slot", (F.sum("__held").over(along.orderBy("__slot")) - F.col("__held")).alias("__before"), F.sum("__held").over(along).alias("n"))
    rows = df.withColumns({"__group": group, "__slot": at})
    inside = F.row_number().over(Window.partitionBy("__group", "__slot").orderBy(*order))
    return rows.join(before, ["__group", "__slot"]).withColumn("k", F.col("__before") + inside - 1).drop("__group", "__slot", "__before")


def blocks(rows: DataFrame, halo: int, size: int = BLOCK) -> DataFrame:
    """Numbered rows (k, n) dealt into blocks of `size`; each block also has the last `halo` rows of the one before, which are not its `own`."""
    if not 0 <= halo <= size:
        raise ValueError("a halo fits into a block")
    own = F.floor(F.col("k") / size).cast("bigint")
    looked_at = (F.col("k") % size >= size - halo) & ((own + 1) * size < F.col("n"))
    dealt = rows.withColumn("block", F.explode(F.when(looked_at, F.array(own, own + 1)).otherwise(F.array(own))))
    return dealt.withColumn("own", F.col("block") == own)


def in_block(key: str) -> Window:
    """The order inside a block."""
    return Window.partitionBy(key, "block").orderBy("k")
