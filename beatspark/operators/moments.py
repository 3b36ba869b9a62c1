"""Means and co-moments that can be merged: one aggregation by patient serves statistics inside patients, between them
and over all rows, without a join of rows back to their means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, means, and sums of squares and products of deviations from the means.
PARTS = ("n", "mx", "my", "cxx", "cyy", "cxy")
#: Lists that the keys of a group are dealt into.
LISTS = 4096


def record(x: str | Column, y: str | Column) -> Column:
    """An aggregate: the record of the rows where both are there."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x)
    return F.struct(n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_pop(x) * n).alias("cxx"), (F.var_pop(y) * n).alias("cyy"), (F.covar_pop(x, y) * n).alias("cxy"))


def shifted(m: Column, x: Column, y: Column) -> Column:
    """The record of values less x and y: only the means move."""
    return F.struct(m["n"].alias("n"), (m["mx"] - x).alias("mx"), (m["my"] - y).alias("my"), *[m[c].alias(c) for c in PARTS[3:]])


def correlation(m: Column) -> Column:
    """Pearson's r of a record; NULL where either side is constant."""
    return F.try_divide(m["cxy"], F.sqrt(m["cxx"]) * F.sqrt(m["cyy"]))


def variance(m: Column, ddof: int) -> Column:
    """The variance of x; NULL where there are too few rows."""
    return F.when(m["n"] > ddof, m["cxx"] / (m["n"] - ddof))


def single(x: Column) -> Column:
    """The record of one value (both sides); of none, where it is NULL."""
    zero = F.lit(0.0)
    return F.struct(x.isNotNull().cast("bigint").alias("n"), x.alias("mx"), x.alias("my"), zero.alias("cxx"), zero.alias("cyy"), zero.alias("cxy"))


def _merge(a: Column, b: Column) -> Column:
    """Both records as one: sums inside them, and their means around the common one."""
    n = a["n"] + b["n"]
    mean = lambda m, f: F.coalesce(m[f], F.lit(0.0))
    dx, dy = mean(b, "mx") - mean(a, "mx"), mean(b, "my") - mean(a, "my")
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    sums = {f: F.coalesce(a[f], F.lit(0.0)) + F.coalesce(b[f], F.lit(0.0)) + d * a["n"] * share for f, d in (("cxx", dx * dx), ("cyy", dy * dy), ("cxy", dx * dy))}
    return F.struct(n.alias("n"), (mean(a, "mx") + share * dx).alias("mx"), (mean(a, "my") + share * dy).alias("my"), *[v.alias(f) for f, v in sums.items()])


def merged(records: DataFrame, by: list[str], columns: list[str], key: str = "patient_id") -> DataFrame:
    """The records in `columns` merged over the groups `by`, in two levels: first those of the keys of equal hash, so that no
    list holds more than a part of all keys, then these. What has no rows has n = 0."""
    empty = F.lit(0).cast("bigint"), *[F.lit(0.0)] * 5
    nothing = F.struct(*[v.alias(f) for v, f in zip(empty, PARTS)])
    fold = lambda df: df.select(*by, *[F.aggregate(c, nothing, _merge).alias(c) for c in columns])
    lists = [F.collect_list(c).alias(c) for c in columns]
    return fold(fold(records.groupBy(*by, F.pmod(F.xxhash64(key), F.lit(LISTS)).alias("__part")).agg(*lists)).groupBy(*by).agg(*lists))


_RECORD = "pair int, part bigint, m struct<n: bigint, mx: double, my: double, cxx: double, cyy: double, cxy: double>"


def _of(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """The record of values without gaps. Counted from the first value, so that equal values deviate by nothing."""
    n = len(x)
    if not n:
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    dx, dy = x - x[0], y - y[0]
    mx, my = dx.mean(), dy.mean()
    dx, dy = dx - mx, dy - my
    return n, x[0] + mx, y[0] + my, float((dx * dx).sum()), float((dy * dy).sum()), float((dx * dy).sum())


def _both(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
    """`_merge` for records of a task."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, dx, dy = a[0] + b[0], b[1] - a[1], b[2] - a[2]
    share = b[0] / n
    return n, a[1] + share * dx, a[2] + share * dy, a[3] + b[3] + dx * dx * a[0] * share, a[4] + b[4] + dy * dy * a[0] * share, a[5] + b[5] + dx * dy * a[0] * share


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, r): Pearson's r of each of many pairs of columns (by their number in `pairs`), over the rows where both are
    there; NULL where either side is constant.

    Tasks make one record for each pair from whole batches, an array at a time, which so many aggregates beside each
    other do a value at a time; the records of all tasks are merged.
    """
    columns = [*dict.fromkeys(c for pair in pairs for c in pair)]
    places = [(columns.index(a), columns.index(b)) for a, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [_of(np.zeros(0), np.zeros(0))] * len(places), None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(len(columns))[0].as_py() if part is None else part
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[: len(columns)]]
            there = [c.is_valid().to_numpy(zero_copy_only=False) if c.null_count else None for c in batch.columns[: len(columns)]]
            for k, (i, j) in enumerate(places):
                masks = [m for m in (there[i], there[j]) if m is not None]
                both = np.logical_and.reduce(masks) if masks else slice(None)
                held[k] = _both(held[k], _of(values[i][both], values[j][both]))
        if part is not None:
            made = [dict(zip(PARTS, (int(m[0]), *map(float, m[1:])))) for m in held]
            kind = pa.struct([("n", pa.int64()), *[(f, pa.float64()) for f in PARTS[1:]]])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array([part] * len(made), pa.int64()), pa.array(made, kind)], ["pair", "part", "m"])

    own = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.spark_partition_id().cast("bigint").alias("__part"))
    empty = F.struct(F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(f) for f in PARTS[1:]])
    # a table without rows has its pairs too
    none = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("pair"), F.lit(-1).cast("bigint").alias("part"), empty.alias("m"))
    return merged(own.mapInArrow(run, _RECORD).union(none), ["pair"], ["m"], "part").select("pair", correlation(F.col("m")).alias("r"))
