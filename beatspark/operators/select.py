"""Small projections and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import template_corr

def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a missing value (in `columns`, or any) and with systolic above diastolic pressure. A condition for each
    column, so that a join before has each checked on its own side, and columns that nobody asks for stay there."""
    kinds = dict(df.dtypes)
    there = [F.col(f"`{c}`").isNotNull() & (~F.isnan(f"`{c}`") if kinds[c] in ("float", "double") else F.lit(True)) for c in (df.columns if columns is None else columns)]
    return df.where(reduce(Column.__and__, there, F.col("sbp_reference") > F.col("dbp_reference")))


def impute_mean(df: DataFrame, column: str, by: str = "caseid") -> DataFrame:
    """Missing values become the mean of their recording: one aggregation, joined back."""
    means = df.groupBy(F.col(by).alias("__key")).agg(F.avg(column).alias("__m"))
    return df.join(means, F.col(by).eqNullSafe(F.col("__key")), "left").withColumn(column, F.coalesce(F.col(column), F.col("__m"))).drop("__m", "__key")


def first_difference(column: str, by: str, order: str) -> Column:
    return F.coalesce(F.col(column) - F.lag(column).over(Window.partitionBy(by).orderBy(order)), F.lit(0.0))


def adaptive_threshold(df: DataFrame, column: str, by: str = "caseid", order: str = "bp_idx", size: int = 1000) -> DataFrame:
    """0.4 of the mean and 0.15 of the maximum of the last `size` absolute differences."""
    last = Window.partitionBy(by).orderBy(order).rowsBetween(1 - size, 0)
    steps = df.withColumn("slope", F.abs(first_difference(column, by, order)))
    return steps.withColumn("threshold", 0.4 * F.avg("slope").over(last) + 0.15 * F.max("slope").over(last))


def first_patients(df: DataFrame, k: int, order: tuple[str, ...] = ("timestamp", "cycle_index")) -> DataFrame:
    """Rows of the k patients that appear first when rows are read in the given order."""
    seen = df.groupBy("patient_id").agg(F.min(F.struct(*order)).alias("__first"))
    few = seen.orderBy("__first", "patient_id").limit(k).select("patient_id")
    return df.join(F.broadcast(few), "patient_id", "left_semi")  # k rows


def template_correlation_filter(cycles: DataFrame, template: DataFrame, column: str = "ppg", least: float = 0.85) -> DataFrame:
    """Beats that resemble their case's median beat; the correlation becomes `cycle_correlation`."""
    return cycles.join(template, "caseid").withColumn("cycle_correlation", template_corr(F.col(column), F.col("template"))).where(F.col("cycle_correlation") >= least).drop("template")


def median_template(cycles: DataFrame, column: str = "ppg") -> DataFrame:
    """caseid and template: at each place of the (equally long) beats of a case, their exact median."""
    at = cycles.select("caseid", F.posexplode(column).alias("pos", "v")).groupBy("caseid", "pos").agg(F.median("v").alias("v"))
    return at.groupBy("caseid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("template"))


def storage_keys(cases: DataFrame, tracks: list[str]) -> DataFrame:
    """File and array names of each case's tracks."""
    each = cases.select("caseid", F.explode(F.array(*[F.lit(t) for t in tracks])).alias("track"))
    return each.select("caseid", F.concat(F.lit("case_"), F.lpad(F.col("caseid").cast("string"), 5, "0"), F.lit(".npz")).alias("file"), F.concat(F.lit("wave_"), F.replace("track", F.lit("/"), F.lit("_"))).alias("key"))
