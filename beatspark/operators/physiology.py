"""Beat-level bounds and per-patient validation of the pressure relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ptt_column, reasons, safe_corr


def recordable() -> Column:
    """Both pressures are there, inside the recordable range."""
    return F.col("sbp_reference").between(50, 250) & F.col("dbp_reference").between(30, 150)


def reference_bp_filter(df: DataFrame) -> DataFrame:
    return df.where(recordable())


def valid_beat(strict: bool = False) -> Column:
    """Heart rate, transit time and amplitude ratio inside physiological bounds; a missing value is outside."""
    (hr, tt, ra, part) = ((40, 180), (50, 350), (0.1, 0.9), 0.5) if strict else ((20, 250), (30, 400), (0.01, 1.2), 0.6)
    cycle = F.try_divide(F.lit(60000.0), F.col("hr_bpm"))
    ok = F.col("hr_bpm").between(*hr) & F.col("pat_ecg_ppg").between(*tt) & F.col("ptt_peak_to_foot").between(*tt) & F.col("amplitude_ratio_ra").between(*ra) & (F.col("ptt_peak_to_foot") <= part * cycle)
    return F.coalesce(ok & (F.col("amplitude_ratio_ra") != 1.0) if strict else ok, F.lit(False))


def boundary_filter(df: DataFrame) -> DataFrame:
    ptt = F.col(ptt_column(df))
    return df.where((ptt > 50) & (ptt < 600) & (F.col("amplitude_ratio_ra") > 0.02) & (F.col("amplitude_ratio_ra") < 0.97))


def patient_physiology(df: DataFrame, min_samples: int = 100, strict: bool = False) -> DataFrame:
    """One row for each patient: correlations, spreads, is_valid and the reasons against. A missing r passes."""
    ptt = ptt_column(df)
    seen = df.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_samples"), safe_corr(ptt, "sbp_reference").alias("ptt_sbp_r"), safe_corr(ptt, "hr_bpm").alias("ptt_hr_r"),
        safe_corr("hr_bpm", "sbp_reference").alias("hr_sbp_r"), F.stddev_samp(ptt).alias("ptt_std"), F.stddev_samp("sbp_reference").alias("sbp_std"),
    )
    few = F.col("n_samples") < min_samples
    hr, sbp = (F.col("ptt_hr_r") >= 0, F.col("ptt_sbp_r") >= 0) if strict else (F.col("ptt_hr_r") > 0.3, F.col("ptt_sbp_r") > 0.2)
    against = reasons([("low_ptt_var", F.col("ptt_std") < (15 if strict else 10)), ("positive_ptt_hr", hr), ("positive_ptt_sbp", sbp), ("low_sbp_var", F.col("sbp_std") < 5)])
    reason = F.when(few, F.lit("insufficient_samples")).otherwise(against)
    return seen.withColumn("reason", reason).withColumn("is_valid", F.col("reason") == "")


def filter_valid_patients(df: DataFrame, strict: bool = False, remove_boundary: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of the patients that pass, and the table of all patients."""
    rows = boundary_filter(df) if remove_boundary else df
    metrics = patient_physiology(rows, strict=strict)
    return rows.join(metrics.where("is_valid").select("patient_id"), "patient_id", "left_semi"), metrics


def invalid_reason_counts(metrics: DataFrame) -> DataFrame:
    """How often each kind of reason stands against a patient."""
    each = metrics.where("NOT is_valid").select(F.explode(F.split("reason", "\\|")).alias("r"))
    return each.groupBy(F.substring_index("r", "_", 2).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def physiology_signs(df: DataFrame, at_least: int = 100) -> DataFrame:
    ptt = ptt_column(df)
    return df.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n"), safe_corr(ptt, "sbp_reference").alias("r_sbp"), safe_corr(ptt, "hr_bpm").alias("r_hr"), F.stddev_samp(ptt).alias("ptt_std"),
        F.avg("stat_std").alias("amplitude"), F.avg("sbp_reference").alias("sbp_mean"), F.stddev_samp("sbp_reference").alias("sbp_std"),
    ).where(F.col("n") >= at_least).withColumn("good", F.coalesce((F.col("r_sbp") < 0) & (F.col("r_hr") < 0), F.lit(False)))


def patient_corr_distribution(df: DataFrame, more_than: int = 50) -> DataFrame:
    r = df.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), safe_corr(ptt_column(df), "sbp_reference").alias("r")).where((F.col("n") > more_than) & F.col("r").isNotNull())
    return r.agg(F.count(F.lit(1)).alias("n_patients"), F.avg("r").alias("mean_r"), F.median("r").alias("median_r"), F.stddev_samp("r").alias("std_r"), F.avg((F.col("r") < 0).cast("double")).alias("share_negative"), F.count_if(F.col("r") < -0.1).alias("n_below"))
