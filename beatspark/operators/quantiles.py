"""Exact quantiles and ranks over any number of rows: a sketch narrows a quantile down to few values, which are counted;
no task ever holds a whole column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import Stages

#: Rank error of the sketches is a part in so many of all rows; groups of fewer values are counted as they are.
SKETCH = 10_000
#: Rows that a task numbers, about.
TASK_ROWS = 500_000


def summarised(long: DataFrame, key: str | None, x: str, at: Sequence[float], plain: Sequence[Column] = (), parts: int = SKETCH) -> DataFrame:
    """`key`, the (named) aggregates `plain`, n (values) and q, an array of the exact quantiles `at` with linear interpolation, for
    each of a few groups of `key`: two scans in all.

    The first scan makes the plain statistics and, for each quantile, a sketch's values on both sides of its rank. The
    second counts the values between these, of which there are few, and how many lie in the gaps before them; with that
    the ranks are exact. Equal values are counted before they are shuffled. A wanted rank outside its bounds, which the
    sketch's guarantee excludes, raises. Keys have to be few (columns, or the categories of a report), as their bounds
    come to the driver and are broadcast; a null key is a group of its own. Without a key there is one group, of all rows.
    """
    spark = long.sparkSession
    order = sorted(range(len(at)), key=lambda i: at[i])
    ends = [min(1.0, max(0.0, at[i] + d)) for i in order for d in (-2.5 / parts, 2.5 / parts)]
    group = F.struct((F.col(key) if key else F.lit(True)).alias("key"))
    rows = long.withColumns({"__g": group, "__x": F.col(x).cast("double")})
    aggregates = [*plain, F.count("__x").alias("__n"), F.percentile_approx("__x", ends, parts).alias("__b")]
    first = rows.groupBy("__g").agg(*aggregates) if key else rows.agg(*aggregates).withColumn("__g", group)
    names = [c for c in first.columns if c not in ("__g", "__n", "__b")]

    def bound(k: int, outside: str) -> Column:
        return F.when((F.col("__n") <= parts) | F.lit(ends[k] in (0.0, 1.0)), F.lit(float(outside))).otherwise(F.get("__b", F.lit(k)))

    sides = first.withColumns({"__low": F.array(*[bound(2 * i, "-inf") for i in range(len(at))]), "__high": F.array(*[bound(2 * i + 1, "inf") for i in range(len(at))])}).drop("__b")
    found = F.broadcast(spark.createDataFrame(sides.collect(), sides.schema))  # a row for each of the few groups

    seen = rows.where("__x IS NOT NULL").select("__g", "__x").join(found.select("__g", "__low", "__high"), "__g")
    # the first bracket that does not end before the value; where that has not begun, the value lies in the gap before it
    part = sum(((F.col("__x") > F.get("__high", F.lit(i))).cast("int") for i in range(len(at))), F.lit(0))
    dealt = seen.withColumn("__part", part)
    counted = dealt.select("__g", "__part", F.when(F.col("__x") >= F.get("__low", F.col("__part")), F.col("__x")).alias("__x")).groupBy("__g", "__part", "__x").agg(F.count(F.lit(1)).alias("held"))
    sums = counted.groupBy("__g", "__part").agg(F.sum("held").alias("all"), F.sum(F.when(F.col("__x").isNull(), F.col("held")).otherwise(0)).alias("gap"))
    before = sums.select("__g", "__part", (F.sum("all").over(Window.partitionBy("__g").orderBy("__part")) - F.col("all") + F.col("gap")).alias("before"))
    upto = F.col("before") + F.sum("held").over(Window.partitionBy("__g", "__part").orderBy("__x"))
    ranked = counted.where("__x IS NOT NULL").join(F.broadcast(before), ["__g", "__part"]).join(found.select("__g", "__n"), "__g").withColumn("upto", upto)

    place = lambda p: (F.col("__n") - 1) * F.lit(float(p))
    at_rank = lambda k: F.max(F.when((F.col("upto") - F.col("held") <= k) & (k < F.col("upto")), F.col("__x")))
    sought = ranked.groupBy("__g").agg(*[at_rank(f(place(p))).alias(f"{side}{i}") for i, p in enumerate(at) for side, f in (("a", F.floor), ("b", F.ceil))])

    def value(i: int) -> Column:
        a, b, share = F.col(f"a{i}"), F.col(f"b{i}"), place(at[i]) - F.floor(place(at[i]))
        return F.when(F.col("__n") == 0, F.lit(None).cast("double")).when(a.isNull() | b.isNull(), F.raise_error("a rank lies outside its sketch bounds").cast("double")).otherwise(a + (b - a) * share)

    return found.join(sought, "__g", "left").select(*([F.col("__g.key").alias(key)] if key else []), *names, F.col("__n").alias("n"), F.array(*[value(i) for i in range(len(at))]).alias("q"))


def quantiles(long: DataFrame, key: str, x: str, at: Sequence[float], parts: int = SKETCH) -> DataFrame:
    """(key, p, value): exact quantiles of `x` in each of a few groups of `key` that have values."""
    each = summarised(long, key, x, at, parts=parts).where("n > 0")
    return each.select(key, F.inline(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.get("q", F.lit(i)).alias("value")) for i, p in enumerate(at)])))


def wide_quantiles(df: DataFrame, column: str, at: dict[str, float], plain: Sequence[Column] = ()) -> DataFrame:
    """One row: the aggregates `plain` over all rows, and the quantiles of a column, under their names; NULL where there is no value."""
    one = summarised(df, None, column, list(at.values()), plain)
    return one.select(*[c for c in one.columns if c not in ("n", "q")], *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(at)])


def numbered(rows: DataFrame, order: Column, prefix: Sequence[int] = (1, 2, 4, 8), name: str = "k") -> DataFrame:
    """`rows` with their number (from 1) in the order of a text, which has to be different in each row.

    Rows with the same beginning lie together in the order: rows of longer and longer beginnings are summed inside the
    next shorter one, and rows are only sorted inside the longest. The shortest beginnings are few; no other window spans
    the table. Rows are dealt by the longest beginning over as many tasks as their number asks for, and sorted once, so a task
    holds as many of them in any table.
    """
    text = rows.withColumn("__order", order)
    deep = text.withColumn("__at", F.substring("__order", 1, prefix[-1]))
    held = Stages(rows.sparkSession).table("beginnings", lambda: deep.groupBy("__at").agg(F.count(F.lit(1)).alias("__n")))
    names = [f"__p{k}" for k in range(len(prefix))]
    counts = held.withColumns({p: F.substring("__at", 1, n) for p, n in zip(names, prefix)})
    # the shortest beginnings are few: their numbers come from a table of their own
    top = counts.groupBy(names[0]).agg(F.sum("__n").alias("__held"))
    counts = counts.join(top.select(names[0], (F.sum("__held").over(Window.partitionBy(F.lit(0)).orderBy(names[0])) - F.col("__held")).alias("__start")), names[0])
    for k in range(1, len(prefix)):
        upto = F.sum("__n").over(Window.partitionBy(*names[:k]).orderBy(names[k]).rangeBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("__start", F.col("__start") + upto - F.sum("__n").over(Window.partitionBy(*names[: k + 1])))
    total = held.agg(F.sum("__n")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    inside = F.row_number().over(Window.partitionBy("__at").orderBy("__order"))
    placed = deep.repartition(parts, "__at").withColumn("__inside", inside)
    return placed.join(counts.select("__at", "__start"), "__at").withColumn(name, F.col("__start") + F.col("__inside")).drop("__order", "__start", "__inside", "__at")
