"""Ordered cleaning rules and what each removes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_failed


@dataclass(frozen=True)
class Thresholds:
    """Inclusive limits of the cleaning rules."""

    ptt_peak: tuple[float, float] = (100, 500)
    ptt_foot: tuple[float, float] = (50, 350)
    pat: tuple[float, float] = (50, 350)
    sbp: tuple[float, float] = (60, 220)
    dbp: tuple[float, float] = (30, 130)
    hr: tuple[float, float] = (30, 220)
    ratio: tuple[float, float] = (0.0, 1.0)
    correlation: float = 0.7


def rules(df: DataFrame, strict: bool = True, limits: Thresholds = Thresholds()) -> list[tuple[str, Column]]:
    """(rule, kept when), in order; a rule on a column that is not there is left out."""
    here, c = set(df.columns), F.col
    both = {"sbp_reference", "dbp_reference"} <= here
    listed = [
        ("ptt_peak_zero", "ptt_peak_to_peak" in here, lambda: c("ptt_peak_to_peak") > 0),
        ("ptt_foot_zero", "ptt_peak_to_foot" in here, lambda: c("ptt_peak_to_foot") > 0),
        ("ptt_peak_range", "ptt_peak_to_peak" in here, lambda: c("ptt_peak_to_peak").between(*limits.ptt_peak)),
        ("ptt_foot_range", "ptt_peak_to_foot" in here, lambda: c("ptt_peak_to_foot").between(*limits.ptt_foot)),
        ("sbp_range", both, lambda: c("sbp_reference").between(*limits.sbp)),
        ("dbp_range", both, lambda: c("dbp_reference").between(*limits.dbp)),
        ("sbp_dbp_violation", both, lambda: c("sbp_reference") > c("dbp_reference")),
        ("amp_ratio_range", strict and "amplitude_ratio_ra" in here, lambda: c("amplitude_ratio_ra").between(*limits.ratio)),
        ("hr_range", "hr_bpm" in here, lambda: c("hr_bpm").between(*limits.hr)),
        ("low_correlation", strict and "cycle_correlation" in here, lambda: c("cycle_correlation") >= limits.correlation),
        ("pat_range", "pat_ecg_ppg" in here, lambda: c("pat_ecg_ppg").between(*limits.pat)),
        ("nan_values", True, lambda: F.array_size(F.filter(F.array(*[c(x).isNull() for x in df.columns]), lambda x: x)) == 0),
    ]
    return [(name, kept()) for name, there, kept in listed if there]


def first_failed_rule(df: DataFrame, strict: bool = True, limits: Thresholds = Thresholds()) -> DataFrame:
    return df.withColumn("first_failed_rule", first_failed(rules(df, strict, limits)))


def clean_samples(df: DataFrame, strict: bool = True, limits: Thresholds = Thresholds()) -> DataFrame:
    return first_failed_rule(df, strict, limits).where("first_failed_rule IS NULL").drop("first_failed_rule")


def cleaning_stats(df: DataFrame, strict: bool = True, limits: Thresholds = Thresholds()) -> DataFrame:
    """Rows removed by each rule that removes any, in one pass. The zero rules report rows equal to zero only."""
    return removed_by_rule(first_failed_rule(df, strict, limits))


def removed_by_rule(judged: DataFrame) -> DataFrame:
    """The same of rows with their `first_failed_rule`."""
    zero = (F.col("first_failed_rule") == "ptt_peak_zero") & (F.col("ptt_peak_to_peak") == 0) | (F.col("first_failed_rule") == "ptt_foot_zero") & (F.col("ptt_peak_to_foot") == 0)
    counted = F.when(F.col("first_failed_rule").isin("ptt_peak_zero", "ptt_foot_zero"), F.when(zero, 1).otherwise(0)).otherwise(1)
    return judged.where("first_failed_rule IS NOT NULL").groupBy(F.col("first_failed_rule").alias("rule")).agg(F.sum(counted).alias("removed"))


def removed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `before` that `after` lacks, by key."""
    return before.join(after.select(*keys).distinct(), keys, "left_anti")
