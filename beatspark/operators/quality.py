"""Reports on a beat table: one row, or one row for each patient, session or column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import masked_corr, percent, ptt_column, reasons, safe_corr
from .ordered import SPAN, slot
from .quantiles import summarised, wide_quantiles


#: Columns that the report of a beat table, its verdict and the counts of removed rows read.
REPORTED = ("patient_id", "session_id", "ptt_peak_to_peak", "ptt_peak_to_foot", "pat_ecg_ppg", "amplitude_ratio_ra", "sbp_reference", "dbp_reference", "hr_bpm", "cycle_correlation")


def quality_report(df: DataFrame, low_correlation: float = 0.7) -> DataFrame:
    """All metrics and flags of a beat table in one row: counts, shares, means and spreads on valid rows, correlations on
    valid rows (0 up to 100 of them). One aggregation, one for rows per patient and one for the median.
    """
    c, n = F.col, F.count(F.lit(1))
    ptt, pat, ra, sbp, dbp, hr = (c(x) for x in ("ptt_peak_to_peak", "pat_ecg_ppg", "amplitude_ratio_ra", "sbp_reference", "dbp_reference", "hr_bpm"))

    def spread(name: str, x: Column, valid: Column | None = None) -> list[Column]:
        x = x if valid is None else F.when(valid, x)
        return [F.avg(x).alias(f"{name}_mean"), F.stddev_samp(x).alias(f"{name}_std")]

    def share(name: str, condition: Column) -> list[Column]:
        return [F.count_if(condition).alias(name), percent(condition).alias(f"{name}_pct")]

    def related(name: str, x: str, y: str, valid: Column) -> Column:
        return F.coalesce(masked_corr(x, y, valid, 100), F.lit(0.0)).alias(name)

    per_patient = df.groupBy("patient_id").agg(n.alias("n")).agg(F.count("patient_id").alias("total_patients"), F.avg("n").alias("samples_per_patient_mean"), F.stddev_samp("n").alias("samples_per_patient_std"))
    valid_ptt = (ptt > 0) & (ptt < 500)
    report = df.agg(
        n.alias("total_samples"), F.count_distinct("session_id").alias("total_sessions"),
        *share("ptt_zeros", ptt == 0), F.count_if(ptt < 30).alias("ptt_outliers_low"), F.count_if(ptt > 300).alias("ptt_outliers_high"), *spread("ptt", ptt, ptt > 0),
        *share("pat_zeros", pat == 0), *spread("pat", pat, pat > 0),
        *share("amplitude_ones", ra == 1.0), *share("amplitude_zeros", ra < 0.01), *spread("amplitude", ra, (ra > 0.01) & (ra < 0.99)),
        *spread("sbp", sbp), F.min(sbp).alias("sbp_min"), F.max(sbp).alias("sbp_max"), *spread("dbp", dbp), F.count_if(sbp <= dbp).alias("sbp_dbp_violations"),
        (F.count_if((sbp < 60) | (sbp > 200)) + F.count_if((dbp < 30) | (dbp > 120))).alias("bp_outliers"),
        *spread("hr", hr), F.count_if((hr < 30) | (hr > 200)).alias("hr_outliers"),
        F.count_if(c("cycle_correlation") < low_correlation).alias("low_correlation_count"), percent(c("cycle_correlation") < low_correlation).alias("low_correlation_pct"), F.avg("cycle_correlation").alias("correlation_mean"),
        related("ptt_sbp_correlation", "ptt_peak_to_peak", "sbp_reference", valid_ptt), related("ptt_dbp_correlation", "ptt_peak_to_peak", "dbp_reference", valid_ptt),
        related("pat_sbp_correlation", "pat_ecg_ppg", "sbp_reference", (pat > 0) & (pat < 600)), related("hr_sbp_correlation", "hr_bpm", "sbp_reference", (hr > 30) & (hr < 200)),
    )
    # a scan of its own: a sketch beside them would take all these aggregates out of generated code
    median = wide_quantiles(df.where(ptt > 0), "ptt_peak_to_peak", {"ptt_median": 0.5})
    flags = {"has_valid_ptt_bp_relationship": c("ptt_sbp_correlation") < -0.3, "has_sufficient_samples": c("total_samples") > 100_000, "has_good_signal_quality": c("low_correlation_pct") < 30}
    return one_row(report, per_patient, median).withColumns(flags)


def one_row(*parts: DataFrame) -> DataFrame:
    """Tables of one row each, side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))
    return out


def compare_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """What cleaning changed: differences of two reports of one row each, and which flags it turned on."""
    b, a = before.select(F.struct("*").alias("b")), after.select(F.struct("*").alias("a"))
    fewer = lambda c: F.col(f"b.{c}") - F.col(f"a.{c}")
    gained = lambda c: ~F.col(f"b.{c}") & F.col(f"a.{c}")
    return one_row(b, a).select(
        fewer("total_samples").alias("samples_removed"), F.coalesce(F.try_divide(100.0 * fewer("total_samples"), F.col("b.total_samples")), F.lit(0.0)).alias("samples_removed_pct"),
        fewer("ptt_zeros").alias("ptt_zeros_removed"), fewer("amplitude_ones").alias("amplitude_ones_removed"), fewer("sbp_dbp_violations").alias("sbp_dbp_violations_removed"),
        fewer("low_correlation_count").alias("low_corr_removed"), (-fewer("ptt_sbp_correlation")).alias("ptt_sbp_corr_change"), (-fewer("ptt_dbp_correlation")).alias("ptt_dbp_corr_change"),
        gained("has_valid_ptt_bp_relationship").alias("valid_ptt_bp_relationship_gained"), gained("has_good_signal_quality").alias("good_signal_quality_gained"))


def quick_quality(df: DataFrame) -> DataFrame:
    p, c = ptt_column(df), F.col
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(c(p) == 0).alias("ptt_zeros"), F.count_if(c("amplitude_ratio_ra") == 1.0).alias("ra_ones"), F.count_if(c("sbp_reference") <= c("dbp_reference")).alias("bp_violations"), F.count_if(c("cycle_correlation") < 0.7).alias("low_correlation"), masked_corr(p, "sbp_reference", (c(p) > 0) & (c(p) < 500)).alias("r"))


def patient_quality(df: DataFrame) -> DataFrame:
    p, c = ptt_column(df), F.col
    return df.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_samples"), percent(c(p) == 0).alias("ptt_zeros_pct"), F.avg(F.when(c(p) > 0, c(p))).alias("ptt_mean"), percent(c("amplitude_ratio_ra") == 1.0).alias("ra_one_pct"),
        F.avg("cycle_correlation").alias("mean_corr"), F.avg("sbp_reference").alias("sbp_mean"), F.stddev_samp("sbp_reference").alias("sbp_std"), masked_corr(p, "sbp_reference", c(p) > 0, 10).alias("r"))


#: Impossible below and above, and the limits of low and high pressure.
PRESSURE_LIMITS = {"sbp_reference": (0, 300, 60, 200), "dbp_reference": (0, 200, 30, 120)}


def sigma_outliers(df: DataFrame, k: float = 3.0) -> DataFrame:
    """For each pressure: range, mean and spread, rows beyond k (sample) standard deviations, impossible, low and high values."""
    names = list(PRESSURE_LIMITS)
    stats = df.agg(*[f(c).alias(f"__{m}_{c}") for c in names for m, f in (("m", F.avg), ("s", F.stddev_samp))])
    aggs, rows = [], []
    for c, (least, most, low, high) in PRESSURE_LIMITS.items():
        x = F.col(c)
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.count_if(F.abs(x - F.col(f"__m_{c}")) > k * F.col(f"__s_{c}")).alias("n_far"), F.count_if((x < least) | (x > most)).alias("n_impossible"), F.count_if(x < low).alias("n_low"), F.count_if(x > high).alias("n_high")).alias(c))
        rows.append(F.col(c))
    return df.select(*names).join(F.broadcast(stats), F.lit(True)).agg(*aggs).select(F.inline(F.array(*rows)))


def feature_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Missing, extreme, mean, infinite and out-of-range values of each column, with shares, in one aggregation."""
    aggs, n = [], F.count(F.lit(1))
    for name, (lo, hi) in ranges.items():
        x = F.col(name).cast("double")
        out = (x < lo) | (x > hi)
        aggs.append(F.struct(
            F.lit(name).alias("feature"), F.count_if(x.isNull()).alias("missing"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.count_if(out).alias("outside"), F.try_divide(100.0 * F.count_if(out), n).alias("outside_pct"), F.count_if(F.abs(x) == float("inf")).alias("infinite"), F.try_divide(100.0 * F.count_if(x.isNull()), n).alias("missing_pct")).alias(name))
    return df.agg(*aggs).select(F.inline(F.array(*ranges)))


def null_profile(df: DataFrame) -> DataFrame:
    names, kinds = df.columns, dict(df.dtypes)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c).alias("nulls")) for c in names])))


def session_duration(df: DataFrame) -> DataFrame:
    each = df.groupBy("session_id").agg((F.max("timestamp") - F.min("timestamp")).alias("d"))
    return wide_quantiles(each, "d", {"median": 0.5}, [F.min("d").alias("least"), F.max("d").alias("most")])


def summary_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, spread and exact quartiles of each column."""
    long = df.select(*columns).unpivot([], columns, "column", "x").where("x IS NOT NULL")
    plain = [F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most")]
    return summarised(long, "column", "x", (0.25, 0.5, 0.75), plain).select("column", "n", "mean", "std", "least", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "most")


def temporal_integrity(df: DataFrame, span: float = SPAN) -> DataFrame:
    """Per session: repeated time stamps, steps back, gaps over 5 s, and breaks in the cycle numbers. A row is compared with
    the one before inside ranges of `span` cycles, which are sorted once; a range's first row with the last one of the
    range before it."""
    group, row = F.struct("session_id").alias("group"), F.struct("timestamp", "cycle_index")  # a struct, so that null keys meet
    order = Window.partitionBy("group", "slot").orderBy("cycle_index")
    rows = df.select(group, slot("cycle_index", span).alias("slot"), "timestamp", "cycle_index")
    near = rows.select("*", *[F.lag(c).over(order).alias(f"prev_{c}") for c in ("timestamp", "cycle_index")], F.row_number().over(order).alias("k"), F.lead(F.lit(True)).over(order).alias("more"))

    def steps(timestamp: Column, cycle_index: Column) -> list[Column]:
        return [F.count_if(timestamp <= 0).alias("backward"), F.count_if(timestamp > 5).alias("gaps"), F.count_if(cycle_index != 1).alias("breaks")]

    own = steps(F.col("timestamp") - F.col("prev_timestamp"), F.col("cycle_index") - F.col("prev_cycle_index"))
    inside = near.groupBy("group", "slot").agg(F.count(F.lit(1)).alias("n"), *own, F.max(F.when(F.col("k") == 1, row)).alias("first"), F.max(F.when(F.col("more").isNull(), row)).alias("last"))
    along = Window.partitionBy("group").orderBy("slot")  # a row for each range of a session
    crossed = steps(*[F.col(f"first.{c}") - F.col(f"before.{c}") for c in ("timestamp", "cycle_index")])
    edges = inside.withColumn("before", F.lag("last").over(along)).groupBy("group").agg(*crossed)
    sums = inside.groupBy("group").agg(*[F.sum(c).alias(f"__{c}") for c in ("n", "backward", "gaps", "breaks")])
    times = df.groupBy("session_id", "timestamp").agg(F.lit(1)).groupBy(group).agg(F.count("timestamp").alias("times"))
    both = sums.join(edges, "group").join(times, "group")
    return both.select("group.session_id", F.col("__n").alias("n"), (F.col("__n") - F.col("times")).alias("duplicates"), *[(F.col(f"__{c}") + F.col(c)).alias(c) for c in ("backward", "gaps", "breaks")])


def validation_verdict(df: DataFrame) -> DataFrame:
    """Errors and warnings against a cleaned table, and whether it passes (no error)."""
    p, c = ptt_column(df), F.col
    seen = df.agg(
        F.count(F.lit(1)).alias("total_samples"), percent(c(p) == 0).alias("zeros"), percent(c("amplitude_ratio_ra") == 1.0).alias("ones"), safe_corr(p, "sbp_reference").alias("r"), safe_corr(p, "dbp_reference").alias("r_dbp"),
        percent(c("sbp_reference") <= c("dbp_reference")).alias("violations"), F.avg("sbp_reference").alias("sbp_mean"), F.stddev_samp("sbp_reference").alias("sbp_std"), F.avg("dbp_reference").alias("dbp_mean"), F.stddev_samp("dbp_reference").alias("dbp_std"))
    listed = lambda *rules: F.array_join(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules]), lambda x: x.isNotNull()), "|")
    warnings = listed(("ptt_zeros", c("zeros") > 5), ("ratio_ones", c("ones") > 1), ("few_samples", c("total_samples") < 500_000))
    errors = listed(("weak_correlation", c("r") > -0.3))
    return seen.withColumns({"warnings": warnings, "errors": errors}).withColumn("passed", F.col("errors") == "")


#: Limits beyond which a table has an issue.
ISSUES = {"weak_features": 0.2, "patient_imbalance": 30.0, "between_patients": 5.0, "missing_values": 0.01}


def diagnostic_issues(df: DataFrame, features: list[str], k: int = 10) -> DataFrame:
    """One row of what speaks against a table as training data, and the issues that follow: no feature related to the
    pressure, few patients with most rows, more variance between than within patients, missing values.
    """
    strongest = F.greatest(*[F.coalesce(F.abs(safe_corr(f, "sbp_reference")), F.lit(0.0)) for f in features]) if len(features) > 1 else F.coalesce(F.abs(safe_corr(features[0], "sbp_reference")), F.lit(0.0))
    plain = df.agg(strongest.alias("strongest"), F.count(F.lit(1)).alias("n"), sum((F.count_if(F.col(f).isNull()) for f in features), F.lit(0)).alias("missing"))
    each = df.groupBy("patient_id").agg(F.count(F.lit(1)).alias("rows"), F.avg("sbp_reference").alias("m"), F.var_samp("sbp_reference").alias("v"))
    top = each.orderBy(F.desc("rows"), "patient_id").limit(k).agg(F.sum("rows").alias("top_rows"))
    seen = one_row(plain, top, each.agg(F.var_samp("m").alias("between"), F.avg("v").alias("within"))).withColumn("top_share", F.try_divide(100.0 * F.col("top_rows"), F.col("n")))
    tests = [("weak_features", F.col("strongest") < ISSUES["weak_features"]), ("patient_imbalance", F.col("top_share") > ISSUES["patient_imbalance"]), ("between_patients", F.col("between") > ISSUES["between_patients"] * F.col("within")), ("missing_values", F.col("missing") > F.col("n") * len(features) * ISSUES["missing_values"])]
    return seen.select("strongest", "top_share", "between", "within", "missing", reasons(tests).alias("issues"), F.array_size(F.filter(F.array(*[F.coalesce(t, F.lit(False)) for _, t in tests]), lambda x: x)).alias("n_issues"))


def extraction_failures(beats: DataFrame, reason: str = "reason") -> DataFrame:
    """Attempts, and their share, for each failure reason; attempts without one are 'valid'. Figures in a reason are dropped."""
    kind = F.regexp_replace(F.coalesce(F.when(F.col(reason) != "", F.col(reason)), F.lit("valid")), "_[0-9.]+$", "")
    counts = beats.groupBy(kind.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return one_row(counts, counts.agg(F.sum("n").alias("attempts"))).withColumn("share", 100.0 * F.col("n") / F.col("attempts"))
