"""Per-patient normalisation. Statistics come from one aggregation and are joined back: a window for each column
would sort the beats once more for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_corr

TIME = ("timestamp", "cycle_index")


def _with_stats(df: DataFrame, stats: dict[str, Column], key: str = "patient_id") -> DataFrame:
    """Rows with the statistics of their patient; rows without a patient are a group of their own."""
    found = df.groupBy(F.col(key).alias("__key")).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(found, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def patient_zscore(df: DataFrame, columns: list[str], population: bool = False, epsilon: float = 1e-6) -> DataFrame:
    """`<column>_norm`: distance from the patient's mean in (sample) standard deviations."""
    std = F.stddev_pop if population else F.stddev_samp
    wide = _with_stats(df, {f"__m_{c}": F.avg(c) for c in columns} | {f"__s_{c}": std(c) for c in columns})
    made = {f"{c}_norm": F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}") + epsilon) for c in columns}
    return wide.withColumns(made).drop(*[f"__{k}_{c}" for k in "ms" for c in columns])


def baseline_delta(df: DataFrame, columns: dict[str, str], first: int = 100) -> DataFrame:
    """Each column less its median over the patient's first rows; `columns` maps it to the new name."""
    order = Window.partitionBy("patient_id").orderBy(*TIME)
    head = df.select("patient_id", *TIME, *columns).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= first)
    base = head.groupBy(F.col("patient_id").alias("__key")).agg(*[F.median(c).alias(f"__b_{c}") for c in columns])
    return df.join(base, F.col("patient_id").eqNullSafe(F.col("__key")), "left").drop("__key").withColumns({new: F.col(c) - F.col(f"__b_{c}") for c, new in columns.items()}).drop(*[f"__b_{c}" for c in columns])


def patient_deviation(df: DataFrame, columns: list[str]) -> DataFrame:
    """`<column>_dev`: distance from the patient's mean."""
    return _with_stats(df, {f"__m_{c}": F.avg(c) for c in columns}).withColumns({f"{c}_dev": F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(*[f"__m_{c}" for c in columns])


def norm_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and spread over patients of each patient's mean of normalised columns; ok below a spread of 0.05."""
    means = df.groupBy("patient_id").agg(*[F.avg(c).alias(c) for c in columns]).unpivot(["patient_id"], columns, "feature", "m")
    return means.groupBy("feature").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std")).withColumn("ok", F.col("std") < 0.05)


def zscore_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Global r of two columns after population z-scores per patient."""
    wide = _with_stats(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), {"__mx": F.avg(x), "__sx": F.stddev_pop(x), "__my": F.avg(y), "__sy": F.stddev_pop(y)})
    return wide.agg(safe_corr(F.try_divide(F.col(x) - F.col("__mx"), F.col("__sx")), F.try_divide(F.col(y) - F.col("__my"), F.col("__sy"))).alias("r"))
