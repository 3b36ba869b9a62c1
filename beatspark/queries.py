"""Every operator as a query on the given tables, beside the same question in SQL."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import arrays
from .functions import expr
from .operators import cleaning, evaluate, joins, modelprep, normalize, physiology, quality, select, stats
from .operators.quantiles import numbered
from .plans import jobs
from .sources import io
from .streaming import quality_stream, replay
from .streaming.ema import ema_stream
from .waves import beats as beat_kernels
from .waves import recordings
from .waves.chunks import detect_r_peaks

QUERIES, ORACLES = {}, {}
B = f"WITH b AS MATERIALIZED ({fx.BEATS_FX})"
FEATURES = ["ptt_peak_to_foot", "ptt_peak_to_peak", "amplitude_ratio_ra", "hr_bpm", "max_upslope", "stat_std", "cycle_correlation"]
BANDS = [40.0, 60.0, 80.0, 100.0, 120.0, 150.0, 200.0, 300.0]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, digits: int = 6, source: str | None = fx.BEATS_FX):
    """Registers a function of the beats (or another input) with its SQL."""

    def take(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(fx.view(spark, sf_dir, source)) if source else f(spark, sf_dir), digits)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def _r(x: str, y: str, digits: int = 6) -> str:
    """Pearson's r in DuckDB, NULL where a side is constant."""
    return f"round(CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END, {digits})"


def _nn(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


# ---- cleaning -------------------------------------------------------------------------------------------------
_RULE = """CASE WHEN NOT coalesce(ptt_peak_to_peak > 0, false) THEN 'ptt_peak_zero' WHEN NOT coalesce(ptt_peak_to_foot > 0, false) THEN 'ptt_foot_zero'
 WHEN NOT coalesce(ptt_peak_to_peak BETWEEN 100 AND 500, false) THEN 'ptt_peak_range' WHEN NOT coalesce(ptt_peak_to_foot BETWEEN 50 AND 350, false) THEN 'ptt_foot_range'
 WHEN NOT coalesce(sbp_reference BETWEEN 60 AND 220, false) THEN 'sbp_range' WHEN NOT coalesce(dbp_reference BETWEEN 30 AND 130, false) THEN 'dbp_range'
 WHEN NOT coalesce(sbp_reference > dbp_reference, false) THEN 'sbp_dbp_violation' WHEN NOT coalesce(amplitude_ratio_ra BETWEEN 0 AND 1.0, false) THEN 'amp_ratio_range'
 WHEN NOT coalesce(hr_bpm BETWEEN 30 AND 220, false) THEN 'hr_range' WHEN NOT coalesce(cycle_correlation >= 0.7, false) THEN 'low_correlation'
 WHEN NOT coalesce(pat_ecg_ppg BETWEEN 50 AND 350, false) THEN 'pat_range'
 WHEN bmi IS NULL OR position IS NULL OR approach IS NULL OR dx IS NULL OR opname IS NULL THEN 'nan_values' END"""


@query(f"{B} SELECT patient_id, cycle_index, sbp_reference, dbp_reference FROM b WHERE ({_RULE}) IS NULL")
def p6_clean_samples(b):
    return cleaning.clean_samples(b).select("patient_id", "cycle_index", "sbp_reference", "dbp_reference")


@query(f"""{B}, f AS (SELECT *, {_RULE} AS rule FROM b)
SELECT rule, CAST(sum(CASE WHEN rule = 'ptt_peak_zero' THEN CAST(ptt_peak_to_peak = 0 AS INT) WHEN rule = 'ptt_foot_zero' THEN CAST(ptt_peak_to_foot = 0 AS INT) ELSE 1 END) AS BIGINT) AS removed FROM f WHERE rule IS NOT NULL GROUP BY rule""")
def p7_cleaning_stats(b):
    return cleaning.cleaning_stats(b)


@query(f"{B} SELECT patient_id, CAST(count(*) AS BIGINT) AS removed FROM b WHERE ({_RULE}) IS NOT NULL GROUP BY patient_id")
def u3_removed_rows(b):
    gone = cleaning.removed_rows(b, cleaning.clean_samples(b), ["patient_id", "cycle_index"])
    return gone.groupBy("patient_id").agg(F.count(F.lit(1)).alias("removed"))


@query(f"{B} SELECT patient_id, cycle_index FROM b WHERE sbp_reference BETWEEN 50 AND 250 AND dbp_reference BETWEEN 30 AND 150")
def p3_reference_bp_filter(b):
    return physiology.reference_bp_filter(b).select("patient_id", "cycle_index")


def _valid(lo_hr, hi_hr, lo, hi, lo_ra, hi_ra, part, more=""):
    return f"hr_bpm BETWEEN {lo_hr} AND {hi_hr} AND pat_ecg_ppg BETWEEN {lo} AND {hi} AND ptt_peak_to_foot BETWEEN {lo} AND {hi} AND amplitude_ratio_ra BETWEEN {lo_ra} AND {hi_ra} AND ptt_peak_to_foot <= {part} * 60000 / hr_bpm{more}"


@query(f"""{B} SELECT patient_id, CAST(count(*) FILTER ({_valid(20, 250, 30, 400, 0.01, 1.2, 0.6)}) AS BIGINT) AS n_valid,
 CAST(count(*) FILTER ({_valid(40, 180, 50, 350, 0.1, 0.9, 0.5, ' AND amplitude_ratio_ra <> 1.0')}) AS BIGINT) AS n_strict FROM b GROUP BY patient_id""")
def p8_validate_beat(b):
    return b.groupBy("patient_id").agg(F.count_if(physiology.valid_beat()).alias("n_valid"), F.count_if(physiology.valid_beat(True)).alias("n_strict"))


_P9 = "ptt_peak_to_foot > 50 AND ptt_peak_to_foot < 600 AND amplitude_ratio_ra > 0.02 AND amplitude_ratio_ra < 0.97"


@query(f"{B} SELECT patient_id, CAST(count(*) AS BIGINT) AS n FROM b WHERE {_P9} GROUP BY patient_id")
def p9_boundary_filter(b):
    return physiology.boundary_filter(b).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


def _a6(rows: str, strict: bool) -> str:
    low, hr, sbp = (15, ">= 0", ">= 0") if strict else (10, "> 0.3", "> 0.2")
    return f"""m AS (SELECT patient_id, count(*) AS n_samples, CASE WHEN isnan(corr(ptt_peak_to_foot, sbp_reference)) THEN NULL ELSE corr(ptt_peak_to_foot, sbp_reference) END AS r1,
 CASE WHEN isnan(corr(ptt_peak_to_foot, hr_bpm)) THEN NULL ELSE corr(ptt_peak_to_foot, hr_bpm) END AS r2, CASE WHEN isnan(corr(hr_bpm, sbp_reference)) THEN NULL ELSE corr(hr_bpm, sbp_reference) END AS r3,
 stddev_samp(ptt_peak_to_foot) AS s1, stddev_samp(sbp_reference) AS s2 FROM {rows} GROUP BY patient_id),
 v AS (SELECT *, CASE WHEN n_samples < 100 THEN 'insufficient_samples' ELSE concat_ws('|', CASE WHEN s1 < {low} THEN 'low_ptt_var' END, CASE WHEN r2 {hr} THEN 'positive_ptt_hr' END, CASE WHEN r1 {sbp} THEN 'positive_ptt_sbp' END, CASE WHEN s2 < 5 THEN 'low_sbp_var' END) END AS reason FROM m)"""


_A6_OUT = "SELECT patient_id, CAST(n_samples AS BIGINT) AS n_samples, round(r1, 6) AS ptt_sbp_r, round(r2, 6) AS ptt_hr_r, round(r3, 6) AS hr_sbp_r, round(s1, 6) AS ptt_std, round(s2, 6) AS sbp_std, reason, reason = '' AS is_valid FROM v"


@query(f"{B}, {_a6('b', False)} {_A6_OUT}")
def a6_patient_physiology(b):
    return physiology.patient_physiology(b)


@query(f"{B}, {_a6('b', True)} {_A6_OUT}")
def a6_patient_physiology_strict(b):
    return physiology.patient_physiology(b, strict=True)


@query(f"{B}, p AS (SELECT * FROM b WHERE {_P9}), {_a6('p', True)} SELECT p.patient_id, CAST(count(*) AS BIGINT) AS n, round(avg(sbp_reference), 6) AS sbp FROM p JOIN v ON p.patient_id = v.patient_id WHERE reason = '' GROUP BY p.patient_id")
def a7_filter_valid_patients(b):
    return physiology.filter_valid_patients(b, strict=True)[0].groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.avg("sbp_reference").alias("sbp"))


@query(f"""{B}, {_a6('b', True)}, e AS (SELECT unnest(string_split(reason, '|')) AS r FROM v WHERE reason <> '')
SELECT split_part(r, '_', 1) || '_' || split_part(r, '_', 2) AS reason, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1""")
def a8_invalid_reason_counts(b):
    return physiology.invalid_reason_counts(physiology.patient_physiology(b, strict=True))


@query(f"""{B}, m AS (SELECT patient_id, count(*) AS n, {_r('ptt_peak_to_foot', 'sbp_reference', 12)} AS r FROM b GROUP BY patient_id)
SELECT CAST(count(*) AS BIGINT) AS n_patients, round(avg(r), 6) AS mean_r, round(median(r), 6) AS median_r, round(stddev_samp(r), 6) AS std_r, round(avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END), 6) AS share_negative, CAST(count(*) FILTER (r < -0.1) AS BIGINT) AS n_below FROM m WHERE n > 50 AND r IS NOT NULL""")
def a17_patient_corr_distribution(b):
    return physiology.patient_corr_distribution(b)


@query(f"""{B}, m AS (SELECT patient_id, count(*) AS n, {_r('ptt_peak_to_foot', 'sbp_reference')} AS r_sbp, {_r('ptt_peak_to_foot', 'hr_bpm')} AS r_hr, round(stddev_samp(ptt_peak_to_foot), 6) AS ptt_std, round(avg(stat_std), 6) AS amplitude, round(avg(sbp_reference), 6) AS sbp_mean, round(stddev_samp(sbp_reference), 6) AS sbp_std FROM b GROUP BY patient_id)
SELECT *, coalesce(r_sbp < 0 AND r_hr < 0, false) AS good FROM m WHERE n >= 100""")
def a18_physiology_signs(b):
    return physiology.physiology_signs(b)


# ---- normalisation ----------------------------------------------------------------------------------------------
@query(f"""{B} SELECT patient_id, cycle_index, {', '.join(f"round(({c} - avg({c}) OVER w) / (stddev_samp({c}) OVER w + 1e-6), 6) AS {c}_norm" for c in FEATURES[:4])} FROM b WINDOW w AS (PARTITION BY patient_id)""")
def w1_patient_zscore(b):
    return normalize.patient_zscore(b, FEATURES[:4]).select("patient_id", "cycle_index", *[f"{c}_norm" for c in FEATURES[:4]])


@query(f"""{B}, z AS (SELECT (ptt_peak_to_foot - avg(ptt_peak_to_foot) OVER w) / nullif(stddev_pop(ptt_peak_to_foot) OVER w, 0) AS x, (sbp_reference - avg(sbp_reference) OVER w) / nullif(stddev_pop(sbp_reference) OVER w, 0) AS y FROM b WHERE sbp_reference IS NOT NULL AND ptt_peak_to_foot IS NOT NULL WINDOW w AS (PARTITION BY patient_id)) SELECT {_r('x', 'y')} AS r FROM z""")
def w1b_zscore_pop(b):
    return normalize.zscore_correlation(b, "ptt_peak_to_foot", "sbp_reference")


@query(f"""{B}, h AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp, cycle_index) AS k FROM b), m AS (SELECT patient_id, median(sbp_reference) AS s, median(ptt_peak_to_foot) AS p FROM h WHERE k <= 100 GROUP BY patient_id)
SELECT b.patient_id, cycle_index, round(sbp_reference - s, 6) AS sbp_delta, round(ptt_peak_to_foot - p, 6) AS ptt_delta FROM b JOIN m ON b.patient_id = m.patient_id""")
def w2_baseline_delta(b):
    return normalize.baseline_delta(b, {"sbp_reference": "sbp_delta", "ptt_peak_to_foot": "ptt_delta"}).select("patient_id", "cycle_index", "sbp_delta", "ptt_delta")


@query(f"{B} SELECT patient_id, cycle_index, round(sbp_reference - avg(sbp_reference) OVER (PARTITION BY patient_id), 6) AS sbp_reference_dev FROM b")
def w3_patient_deviation(b):
    return normalize.patient_deviation(b, ["sbp_reference"]).select("patient_id", "cycle_index", "sbp_reference_dev")


_NORM = "z AS (SELECT patient_id, " + ", ".join(f"({c} - avg({c}) OVER w) / (stddev_samp({c}) OVER w + 1e-6) AS {c}_norm" for c in FEATURES[:4]) + " FROM b WINDOW w AS (PARTITION BY patient_id)), m AS (SELECT patient_id, " + ", ".join(f"avg({c}_norm) AS {c}_norm" for c in FEATURES[:4]) + " FROM z GROUP BY patient_id)"


@query(f"{B}, {_NORM} " + " UNION ALL ".join(f"SELECT '{c}_norm' AS feature, round(avg({c}_norm), 6) AS mean, round(stddev_samp({c}_norm), 6) AS std, stddev_samp({c}_norm) < 0.05 AS ok FROM m" for c in FEATURES[:4]))
def a25_norm_check(b):
    return normalize.norm_check(normalize.patient_zscore(b, FEATURES[:4]), [f"{c}_norm" for c in FEATURES[:4]])


# ---- reports ----------------------------------------------------------------------------------------------------
_PCT = lambda c: f"100.0 * count(*) FILTER ({c}) / count(*)"


def _spread(name: str, x: str, valid: str = "true") -> str:
    return f"avg({x}) FILTER ({valid}) AS {name}_mean, stddev_samp({x}) FILTER ({valid}) AS {name}_std"


def _share(name: str, c: str) -> str:
    return f"count(*) FILTER ({c}) AS {name}, {_PCT(c)} AS {name}_pct"


def _related(name: str, x: str, y: str, valid: str) -> str:
    return f"CASE WHEN count(*) FILTER ({valid} AND {x} IS NOT NULL AND {y} IS NOT NULL) > 100 THEN corr({x}, {y}) FILTER ({valid}) ELSE 0e0 END AS {name}"


_REPORT = f"""SELECT count(*) AS total_samples, count(DISTINCT session_id) AS total_sessions, {_share('ptt_zeros', 'ptt_peak_to_peak = 0')}, count(*) FILTER (ptt_peak_to_peak < 30) AS ptt_outliers_low,
 count(*) FILTER (ptt_peak_to_peak > 300) AS ptt_outliers_high, {_spread('ptt', 'ptt_peak_to_peak', 'ptt_peak_to_peak > 0')}, median(ptt_peak_to_peak) FILTER (ptt_peak_to_peak > 0) AS ptt_median,
 {_share('pat_zeros', 'pat_ecg_ppg = 0')}, {_spread('pat', 'pat_ecg_ppg', 'pat_ecg_ppg > 0')}, {_share('amplitude_ones', 'amplitude_ratio_ra = 1.0')}, {_share('amplitude_zeros', 'amplitude_ratio_ra < 0.01')},
 {_spread('amplitude', 'amplitude_ratio_ra', 'amplitude_ratio_ra > 0.01 AND amplitude_ratio_ra < 0.99')}, {_spread('sbp', 'sbp_reference')}, min(sbp_reference) AS sbp_min, max(sbp_reference) AS sbp_max, {_spread('dbp', 'dbp_reference')},
 count(*) FILTER (sbp_reference <= dbp_reference) AS sbp_dbp_violations, count(*) FILTER (sbp_reference < 60 OR sbp_reference > 200) + count(*) FILTER (dbp_reference < 30 OR dbp_reference > 120) AS bp_outliers,
 {_spread('hr', 'hr_bpm')}, count(*) FILTER (hr_bpm < 30 OR hr_bpm > 200) AS hr_outliers, count(*) FILTER (cycle_correlation < 0.7) AS low_correlation_count, {_PCT('cycle_correlation < 0.7')} AS low_correlation_pct, avg(cycle_correlation) AS correlation_mean,
 {_related('ptt_sbp_correlation', 'ptt_peak_to_peak', 'sbp_reference', 'ptt_peak_to_peak > 0 AND ptt_peak_to_peak < 500')}, {_related('ptt_dbp_correlation', 'ptt_peak_to_peak', 'dbp_reference', 'ptt_peak_to_peak > 0 AND ptt_peak_to_peak < 500')},
 {_related('pat_sbp_correlation', 'pat_ecg_ppg', 'sbp_reference', 'pat_ecg_ppg > 0 AND pat_ecg_ppg < 600')}, {_related('hr_sbp_correlation', 'hr_bpm', 'sbp_reference', 'hr_bpm > 30 AND hr_bpm < 200')} FROM """
_COUNTED = ("total_samples", "total_sessions", "ptt_zeros", "ptt_outliers_low", "ptt_outliers_high", "pat_zeros", "amplitude_ones", "amplitude_zeros", "sbp_dbp_violations", "bp_outliers", "hr_outliers", "low_correlation_count")
_MEASURED = ("ptt_zeros_pct", "ptt_mean", "ptt_std", "ptt_median", "pat_zeros_pct", "pat_mean", "pat_std", "amplitude_ones_pct", "amplitude_zeros_pct", "amplitude_mean", "amplitude_std", "sbp_mean", "sbp_std", "sbp_min", "sbp_max", "dbp_mean", "dbp_std", "hr_mean", "hr_std", "low_correlation_pct", "correlation_mean", "ptt_sbp_correlation", "ptt_dbp_correlation", "pat_sbp_correlation", "hr_sbp_correlation")


@query(f"""{B}, r AS ({_REPORT} b), k AS (SELECT count(*) AS n FROM b GROUP BY patient_id)
SELECT {', '.join(_COUNTED)}, {', '.join(_nn(c) + f' AS {c}' for c in _MEASURED)}, (SELECT count(*) FROM k) AS total_patients, round((SELECT avg(n) FROM k), 6) AS samples_per_patient_mean, round((SELECT stddev_samp(n) FROM k), 6) AS samples_per_patient_std,
 ptt_sbp_correlation < -0.3 AS has_valid_ptt_bp_relationship, total_samples > 100000 AS has_sufficient_samples, low_correlation_pct < 30 AS has_good_signal_quality FROM r""")
def a3_quality_report(b):
    return quality.quality_report(b)


@query(f"""{B}, c AS (SELECT * FROM b WHERE ({_RULE}) IS NULL), x AS ({_REPORT} b), y AS ({_REPORT} c)
SELECT x.total_samples - y.total_samples AS samples_removed, round(100.0 * (x.total_samples - y.total_samples) / x.total_samples, 6) AS samples_removed_pct, x.ptt_zeros - y.ptt_zeros AS ptt_zeros_removed, x.amplitude_ones - y.amplitude_ones AS amplitude_ones_removed,
 x.sbp_dbp_violations - y.sbp_dbp_violations AS sbp_dbp_violations_removed, x.low_correlation_count - y.low_correlation_count AS low_corr_removed, round(y.ptt_sbp_correlation - x.ptt_sbp_correlation, 6) AS ptt_sbp_corr_change, round(y.ptt_dbp_correlation - x.ptt_dbp_correlation, 6) AS ptt_dbp_corr_change,
 x.ptt_sbp_correlation >= -0.3 AND y.ptt_sbp_correlation < -0.3 AS valid_ptt_bp_relationship_gained, x.low_correlation_pct >= 30 AND y.low_correlation_pct < 30 AS good_signal_quality_gained FROM x, y""")
def j8_compare_reports(b):
    return quality.compare_reports(quality.quality_report(b), quality.quality_report(cleaning.clean_samples(b)))


@query(f"{B} SELECT count(*) AS n, count(*) FILTER (ptt_peak_to_foot = 0) AS ptt_zeros, count(*) FILTER (amplitude_ratio_ra = 1.0) AS ra_ones, count(*) FILTER (sbp_reference <= dbp_reference) AS bp_violations, count(*) FILTER (cycle_correlation < 0.7) AS low_correlation, round(corr(ptt_peak_to_foot, sbp_reference) FILTER (ptt_peak_to_foot > 0 AND ptt_peak_to_foot < 500), 6) AS r FROM b")
def a4_quick_quality(b):
    return quality.quick_quality(b)


@query(f"""{B} SELECT patient_id, count(*) AS n_samples, round({_PCT('ptt_peak_to_foot = 0')}, 6) AS ptt_zeros_pct, round(avg(ptt_peak_to_foot) FILTER (ptt_peak_to_foot > 0), 6) AS ptt_mean, round({_PCT('amplitude_ratio_ra = 1.0')}, 6) AS ra_one_pct, round(avg(cycle_correlation), 6) AS mean_corr, round(avg(sbp_reference), 6) AS sbp_mean, round(stddev_samp(sbp_reference), 6) AS sbp_std, round(corr(ptt_peak_to_foot, sbp_reference) FILTER (ptt_peak_to_foot > 0), 6) AS r FROM b GROUP BY patient_id""")
def a5_patient_quality(b):
    return quality.patient_quality(b)


@query(f"{B} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c}), 6) AS least, round(max({c}), 6) AS most, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, count(*) FILTER (abs({c} - m) > 3 * s) AS n_far, count(*) FILTER ({c} < 0 OR {c} > {top}) AS n_impossible, count(*) FILTER ({c} < {low}) AS n_low, count(*) FILTER ({c} > {high}) AS n_high FROM b, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM b)" for c, top, low, high in (("sbp_reference", 300, 60, 200), ("dbp_reference", 200, 30, 120))))
def a38_sigma_outliers(b):
    return quality.sigma_outliers(b)


_RANGES = {"ptt_peak_to_foot": (50, 400), "amplitude_ratio_ra": (0, 10), "hr_bpm": (40, 180), "cycle_correlation": (0, 1), "bmi": (10, 60)}


@query(f"{B} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, round(min({c}), 6) AS least, round(max({c}), 6) AS most, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS outside, round({_PCT(f'{c} < {lo} OR {c} > {hi}')}, 6) AS outside_pct, count(*) FILTER (isinf({c})) AS infinite, round({_PCT(f'{c} IS NULL')}, 6) AS missing_pct FROM b" for c, (lo, hi) in _RANGES.items()))
def a39_feature_ranges(b):
    return quality.feature_ranges(b, _RANGES)


@query(f"{B} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM b" for c in ("sbp_reference", "bmi", "hr_bpm", "dx")))
def a40_null_profile(b):
    return quality.null_profile(b.select("sbp_reference", "bmi", "hr_bpm", "dx")).drop("type")


@query(f"{B}, e AS (SELECT max(timestamp) - min(timestamp) AS d FROM b GROUP BY session_id) SELECT round(min(d), 6) AS least, round(max(d), 6) AS most, round(median(d), 6) AS median FROM e")
def a41_session_duration(b):
    return quality.session_duration(b)


@query(f"{B} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS least, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS most FROM b" for c in FEATURES[:5]))
def a42_summary_stats(b):
    return quality.summary_stats(b, FEATURES[:5])


@query(f"""{B}, d AS (SELECT session_id, timestamp, timestamp - lag(timestamp) OVER w AS d, cycle_index - lag(cycle_index) OVER w AS step FROM b WINDOW w AS (PARTITION BY session_id ORDER BY cycle_index))
SELECT session_id, count(*) AS n, count(*) - count(DISTINCT timestamp) AS duplicates, count(*) FILTER (d <= 0) AS backward, count(*) FILTER (d > 5) AS gaps, count(*) FILTER (step <> 1) AS breaks FROM d GROUP BY session_id""")
def w7_temporal_integrity(b):
    return quality.temporal_integrity(b)


@query(f"""{B}, s AS (SELECT count(*) AS n, {_PCT('ptt_peak_to_foot = 0')} AS zeros, {_PCT('amplitude_ratio_ra = 1.0')} AS ones, corr(ptt_peak_to_foot, sbp_reference) AS r, corr(ptt_peak_to_foot, dbp_reference) AS r_dbp, {_PCT('sbp_reference <= dbp_reference')} AS violations,
 avg(sbp_reference) AS sm, stddev_samp(sbp_reference) AS ss, avg(dbp_reference) AS dm, stddev_samp(dbp_reference) AS ds FROM b),
 e AS (SELECT *, CASE WHEN r > -0.3 THEN 'weak_correlation' ELSE '' END AS errors, concat_ws('|', CASE WHEN zeros > 5 THEN 'ptt_zeros' END, CASE WHEN ones > 1 THEN 'ratio_ones' END, CASE WHEN n < 500000 THEN 'few_samples' END) AS warnings FROM s)
SELECT n AS total_samples, round(zeros, 6) AS zeros, round(ones, 6) AS ones, round(r, 6) AS r, round(r_dbp, 6) AS r_dbp, round(violations, 6) AS violations, round(sm, 6) AS sbp_mean, round(ss, 6) AS sbp_std, round(dm, 6) AS dbp_mean, round(ds, 6) AS dbp_std, warnings, errors, errors = '' AS passed FROM e""")
def a43_validation_verdict(b):
    return quality.validation_verdict(b)


@query(f"""{B}, n AS (SELECT patient_id, count(*) AS n, avg(sbp_reference) AS m, var_samp(sbp_reference) AS v FROM b GROUP BY patient_id), t AS (SELECT sum(n) AS top FROM (SELECT n FROM n ORDER BY n DESC, patient_id LIMIT 10)),
 s AS (SELECT greatest({', '.join(f"coalesce(abs(CASE WHEN isnan(corr({c}, sbp_reference)) THEN NULL ELSE corr({c}, sbp_reference) END), 0)" for c in FEATURES)}) AS strongest, count(*) AS n, {' + '.join(f"count(*) - count({c})" for c in FEATURES)} AS missing FROM b),
 p AS (SELECT var_samp(m) AS bt, avg(v) AS wi FROM n), a AS (SELECT strongest, 100.0 * top / n AS share, bt, wi, missing, n FROM s, t, p),
 i AS (SELECT *, strongest < 0.2 AS i1, share > 30 AS i2, bt > 5 * wi AS i3, missing > n * {len(FEATURES)} * 0.01 AS i4 FROM a)
SELECT round(strongest, 6) AS strongest, round(share, 6) AS top_share, round(bt, 6) AS "between", round(wi, 6) AS within, missing, concat_ws('|', CASE WHEN i1 THEN 'weak_features' END, CASE WHEN i2 THEN 'patient_imbalance' END, CASE WHEN i3 THEN 'between_patients' END, CASE WHEN i4 THEN 'missing_values' END) AS issues,
 coalesce(CAST(i1 AS INT), 0) + coalesce(CAST(i2 AS INT), 0) + coalesce(CAST(i3 AS INT), 0) + coalesce(CAST(i4 AS INT), 0) AS n_issues FROM i""")
def a44_diagnostic_issues(b):
    return quality.diagnostic_issues(b, FEATURES)


@query(f"{B}, r AS (SELECT CASE WHEN ptt_peak_to_foot = 0 THEN 'flat_signal' WHEN cycle_correlation < 0.7 THEN 'low_snr' WHEN hr_bpm > 100 THEN 'invalid_ptt' ELSE 'valid' END AS reason FROM b) SELECT reason, count(*) AS n, (SELECT count(*) FROM b) AS attempts, round(100.0 * count(*) / (SELECT count(*) FROM b), 6) AS share FROM r GROUP BY reason")
def a9_extraction_failures(b):
    reason = F.when(F.col("ptt_peak_to_foot") == 0, "flat_signal").when(F.col("cycle_correlation") < 0.7, F.concat(F.lit("low_snr_"), F.col("cycle_correlation").cast("string"))).when(F.col("hr_bpm") > 100, "invalid_ptt").otherwise("")
    return quality.extraction_failures(b.withColumn("reason", reason))


# ---- statistics -------------------------------------------------------------------------------------------------
_N = "n AS (SELECT patient_id, count(*) AS n FROM b GROUP BY patient_id)"


@query(f"{B}, {_N} SELECT count(*) AS n_patients, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS least, max(n) AS most, count(*) FILTER (n < 30) AS n_short, " + ", ".join(f"round(quantile_cont(n, {q}), 6) AS q{int(100 * q)}" for q in stats.QUANTILES) + " FROM n")
def a10_samples_per_patient(b):
    return stats.samples_per_patient(b)


@query(f"{B}, {_N}, t AS (SELECT n FROM n ORDER BY n DESC, patient_id LIMIT 10) SELECT CAST((SELECT sum(n) FROM t) AS BIGINT) AS top_rows, CAST(sum(n) AS BIGINT) AS rows, round(100.0 * (SELECT sum(n) FROM t) / sum(n), 6) AS share FROM n")
def a11_top_patient_share(b):
    return stats.top_patient_share(b)


@query(f"{B}, {_N} SELECT patient_id, n FROM n ORDER BY n DESC, patient_id LIMIT 10")
def k1_top_patients(b):
    return stats.top_patients(b)


@query(f"{B} SELECT count(DISTINCT patient_id) AS patients, count(DISTINCT session_id) AS sessions, count(DISTINCT dx) AS dx FROM b")
def a12_distinct_counts(b):
    return b.agg(F.count_distinct("patient_id").alias("patients"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("dx").alias("dx"))


_PAIRS = [(a, c) for k, a in enumerate(FEATURES) for c in FEATURES[k + 1 :]]


@query(f"{B} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, {_r(a, c)} AS r FROM b" for a, c in _PAIRS))
def a13_correlation_matrix(b):
    return stats.correlation_pairs(b, FEATURES)


@query(f"{B}, f AS (SELECT {', '.join(FEATURES + ['sbp_reference', 'bmi'])} FROM b WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES + ['sbp_reference', 'bmi'])}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, {_r(a, c)} AS r FROM f" for a, c in combinations(FEATURES + ["sbp_reference", "bmi"], 2)))
def a13_complete_correlations(b):
    return stats.complete_correlations(b, FEATURES + ["sbp_reference", "bmi"])


@query(f"{B} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} > {lo} AND {c} < {hi} AND sbp_reference IS NOT NULL) AS n, round(CASE WHEN count(*) FILTER ({c} > {lo} AND {c} < {hi} AND sbp_reference IS NOT NULL) > 100 THEN corr({c}, sbp_reference) FILTER ({c} > {lo} AND {c} < {hi}) END, 6) AS r FROM b" for c, (lo, hi) in stats.VALID.items()))
def a15_masked_correlation(b):
    return stats.masked_correlations(b)


@query(f"{B}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, {_r(a, c)} AS r FROM b" for a, c in _PAIRS) + ") SELECT * FROM p WHERE abs(r) > 0.9")
def a16_high_corr_pairs(b):
    return stats.correlation_pairs(b, FEATURES).where(F.abs("r") > 0.9)


@query(f"{B}, f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(c, 'sbp_reference')} AS r_sbp, {_r(c, 'dbp_reference')} AS r_dbp FROM b" for c in FEATURES) + ") SELECT *, CASE WHEN abs(r_sbp) > 0.3 THEN 'strong' WHEN abs(r_sbp) > 0.1 THEN 'moderate' ELSE 'weak' END AS strength FROM f")
def a14_feature_bp_correlation(b):
    return stats.feature_bp_correlation(b, FEATURES)


@query(f"{B}, l AS (" + " UNION ALL ".join(f"SELECT patient_id, sbp_reference, '{c}' AS feature, {c} AS x, {c} - avg({c}) OVER (PARTITION BY patient_id) AS dx, sbp_reference - avg(sbp_reference) OVER (PARTITION BY patient_id) AS dy FROM b" for c in FEATURES[:4]) + f"), e AS (SELECT feature, patient_id, count(*) AS n, {_r('x', 'sbp_reference', 12)} AS r FROM l GROUP BY 1, 2), w AS (SELECT feature, avg(r) AS m, stddev_pop(r) AS s FROM e WHERE n > 30 GROUP BY 1), g AS (SELECT feature, {_r('x', 'sbp_reference', 12)} AS r, {_r('dx', 'dy', 12)} AS c FROM l GROUP BY 1) SELECT g.feature, round(r, 6) AS global_r, round(c, 6) AS centred_r, round(m, 6) AS within_mean, round(s, 6) AS within_std, sign(r) <> sign(m) AS sign_flip, round(c * c, 6) AS centred_r2 FROM g JOIN w ON g.feature = w.feature")
def a19_global_vs_within_corr(b):
    return stats.global_vs_within(b, FEATURES[:4])


@query(f"{B}, e AS (SELECT avg(sbp_reference) AS m, var_samp(sbp_reference) AS v FROM b GROUP BY patient_id), p AS (SELECT var_samp(m) AS bt, avg(v) AS wi, (SELECT var_samp(sbp_reference) FROM b) AS tot FROM e) SELECT round(tot, 6) AS total, round(bt, 6) AS \"between\", round(wi, 6) AS within, round(100 * bt / tot, 6) AS between_pct, round(100 * wi / tot, 6) AS within_pct, round(bt / wi, 6) AS ratio FROM p")
def a20_variance_decomposition(b):
    return stats.variance_decomposition(b, "sbp_reference")


_SLOPES = "s AS (SELECT patient_id, count(*) AS n, regr_slope(sbp_reference, ptt_peak_to_foot) * (stddev_pop(ptt_peak_to_foot) + 1e-7) AS slope, avg(sbp_reference) AS intercept, regr_r2(sbp_reference, ptt_peak_to_foot) AS r2 FROM b WHERE sbp_reference IS NOT NULL AND ptt_peak_to_foot IS NOT NULL GROUP BY patient_id HAVING count(*) >= 50)"


@query(f"{B}, {_SLOPES} SELECT patient_id, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM s")
def a21_patient_slopes(b):
    return stats.patient_slopes(b, "ptt_peak_to_foot")


@query(f"{B}, {_SLOPES} SELECT count(slope) AS n_patients, round(avg(slope), 6) AS mean, round(stddev_pop(slope), 6) AS std, round(min(slope), 6) AS least, round(max(slope), 6) AS most, round(stddev_pop(slope) / abs(avg(slope)), 6) AS cv, round(avg(r2), 6) AS r2_mean, round(median(r2), 6) AS r2_median FROM s")
def a21_slope_summary(b):
    return stats.slope_summary(stats.patient_slopes(b, "ptt_peak_to_foot"))


@query(f"{B} SELECT count(*) AS n, round(regr_slope(sbp_reference, ptt_peak_to_foot), 6) AS slope, round(regr_intercept(sbp_reference, ptt_peak_to_foot), 6) AS intercept FROM b WHERE ptt_peak_to_foot > 0 AND sbp_reference IS NOT NULL")
def a22_linear_trend(b):
    return stats.linear_trend(b, "ptt_peak_to_foot", "sbp_reference")


@query(f"{B}, d AS (SELECT stddev_samp(x) AS s FROM (SELECT sbp_reference - avg(sbp_reference) OVER (PARTITION BY patient_id) AS x FROM b)) SELECT round(s, 6) AS std_dev, round(1 - (8 / s) * (8 / s), 6) AS required_r2, round(s * sqrt(1 - 0.144), 6) AS achievable_std FROM d")
def a23_theoretical_limits(b):
    return stats.theoretical_limits(b)


@query(f"{B}, n AS (SELECT count(*) AS n FROM b), k AS (SELECT n, skip, 0.94e0 ^ skip AS r_skip, n // skip AS n_skip FROM n, (VALUES (1), (5), (10), (20)) AS t(skip)) SELECT n, skip, round(r_skip, 6) AS r_skip, n_skip, round(n_skip * (1 - r_skip) / (1 + r_skip), 6) AS effective FROM k")
def a24_effective_sample_size(b):
    return stats.effective_sample_size(b)


def _bands(column: str, edges: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {column} >= {lo}e0 AND {column} < {hi}e0 THEN {lo}e0" for lo, hi in zip(edges, edges[1:])) + " END"


@query(f"{B} " + " UNION ALL ".join(f"SELECT {x}e0 AS bound, count(*) FILTER (ptt_peak_to_foot BETWEEN {x - 1} AND {x + 1}) AS near, round(100.0 * count(*) FILTER (ptt_peak_to_foot BETWEEN {x - 1} AND {x + 1}) / count(ptt_peak_to_foot), 6) AS share FROM b" for x in (40, 50, 80, 100, 120, 200, 248, 250, 300)))
def a26_boundary_clusters(b):
    return stats.boundary_clusters(b, "ptt_peak_to_foot", (40, 50, 80, 100, 120, 200, 248, 250, 300), 1)


@query(f"{B}, x AS (SELECT {_bands('ptt_peak_to_foot', BANDS)} AS lower FROM b) SELECT lower, count(*) AS n FROM x WHERE lower IS NOT NULL GROUP BY lower")
def a27_range_distribution(b):
    return stats.range_distribution(b, "ptt_peak_to_foot", BANDS)


@query(f"{B}, x AS (SELECT *, {_bands('ptt_peak_to_foot', BANDS)} AS lower FROM b) SELECT lower, count(*) AS n, {_r('ptt_peak_to_foot', 'sbp_reference')} AS r FROM x WHERE lower IS NOT NULL GROUP BY lower HAVING count(*) > 50")
def a28_corr_by_range(b):
    return stats.corr_by_range(b, "ptt_peak_to_foot", BANDS)


@query(f"{B} SELECT patient_id, count(*) AS n, round(avg(CASE WHEN ptt_peak_to_foot BETWEEN 79 AND 81 THEN 1e0 ELSE 0e0 END), 6) AS near_80, round(avg(CASE WHEN ptt_peak_to_foot BETWEEN 39 AND 41 THEN 1e0 ELSE 0e0 END), 6) AS near_40, {_r('ptt_peak_to_foot', 'sbp_reference')} AS r, round(avg(ptt_peak_to_foot), 6) AS mean_ptt FROM b GROUP BY patient_id HAVING count(*) >= 50")
def a29_patient_boundary_share(b):
    return stats.patient_boundary_share(b)


@query(f"""{B}, m AS (SELECT patient_id, count(*) AS n, {_r('ptt_peak_to_foot', 'sbp_reference', 12)} AS r, avg(ptt_peak_to_foot) AS mean_ptt, avg(CASE WHEN ptt_peak_to_foot BETWEEN 79 AND 81 THEN 1e0 ELSE 0e0 END) AS near_80 FROM b GROUP BY patient_id HAVING count(*) >= 100),
 s AS (SELECT *, CASE WHEN r > 0 THEN 'positive' WHEN r < -0.1 THEN 'negative' END AS sign FROM m), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY sign ORDER BY r, patient_id) AS INT) AS place FROM s WHERE sign IS NOT NULL)
SELECT sign, place, patient_id, n, round(r, 6) AS r, round(mean_ptt, 6) AS mean_ptt, round(near_80, 6) AS near_80 FROM p WHERE place <= 10""")
def a29_patients_by_sign(b):
    return stats.patients_by_sign(b)


@query(f"{B} SELECT round_even(amplitude_ratio_ra, 3) AS value, count(*) AS n FROM b WHERE amplitude_ratio_ra IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def a30_common_values(b):
    return stats.common_values(b, "amplitude_ratio_ra")


@query(f"{B} SELECT round(max(abs(pat_ecg_ppg - ptt_peak_to_foot)), 6) AS largest, count(*) FILTER (abs(pat_ecg_ppg - ptt_peak_to_foot) > 1) AS n_apart, round(avg(pat_ecg_ppg), 6) AS mean, round(median(pat_ecg_ppg), 6) AS median, round(min(pat_ecg_ppg), 6) AS least, round(max(pat_ecg_ppg), 6) AS most, count(*) FILTER (pat_ecg_ppg = 180) AS at_180, count(*) FILTER (pat_ecg_ppg = 200) AS at_200 FROM b")
def a31_column_agreement(b):
    return stats.column_agreement(b, "pat_ecg_ppg", "ptt_peak_to_foot", (180.0, 200.0))


@query(f"{B} SELECT patient_id, round(avg(CASE WHEN amplitude_ratio_ra = 0.5 THEN 1e0 ELSE 0e0 END), 6) AS share, round(avg(amplitude_ratio_ra), 6) AS mean, count(*) FILTER (amplitude_ratio_ra <> 0.5) AS n_other FROM b GROUP BY patient_id")
def a32_fallback_share(b):
    return stats.fallback_share(b)


@query(f"{B}, r AS (SELECT * FROM b WHERE amplitude_ratio_ra <> 0.5) SELECT (SELECT count(*) FROM r) AS n_rest, round(100.0 * (SELECT count(*) FROM r) / count(*), 6) AS rest_pct, round((SELECT avg(amplitude_ratio_ra) FROM r), 6) AS mean, round((SELECT median(amplitude_ratio_ra) FROM r), 6) AS median, round((SELECT avg(sbp_reference) FROM r), 6) AS sbp_rest, round((SELECT avg(hr_bpm) FROM r), 6) AS hr_rest, round(avg(sbp_reference), 6) AS sbp_all, round(avg(hr_bpm), 6) AS hr_all FROM b")
def a32_fallback_rest(b):
    return stats.fallback_rest(b)


@query(f"{B}, l AS (SELECT min(hr_bpm) AS lo, max(hr_bpm) AS hi FROM b) SELECT CAST(least(49, floor((hr_bpm - lo) * 50 / (hi - lo))) AS INT) AS bin, count(*) AS n FROM b, l GROUP BY 1")
def a33_histogram(b):
    return stats.histogram(b, "hr_bpm")


_CATEGORIES = "l AS (SELECT sbp_reference, dbp_reference, 'dx' AS \"column\", dx AS value FROM b UNION ALL SELECT sbp_reference, dbp_reference, 'sex', sex FROM b UNION ALL SELECT sbp_reference, dbp_reference, 'position', position FROM b)"


@query(f"{B}, {_CATEGORIES}, e AS (SELECT \"column\", value, count(*) AS n, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY count(*) DESC, value) AS INT) AS rank, " + ", ".join(f"CASE WHEN count(*) > 50 THEN round(avg({t}_reference), 6) END AS {t}_mean, CASE WHEN count(*) > 50 THEN round(stddev_samp({t}_reference), 6) END AS {t}_std, CASE WHEN count(*) > 50 THEN count({t}_reference) END AS {t}_n" for t in ("sbp", "dbp")) + " FROM l GROUP BY 1, 2) SELECT * FROM e WHERE rank <= 10")
def a34_category_stats(b):
    return stats.category_stats(b, ["dx", "sex", "position"])


@query(f"{B}, {_CATEGORIES} SELECT \"column\", count(DISTINCT value) AS n_values, count(DISTINCT value) > 20 AS wide, count(*) FILTER (value IS NULL OR lower(value) IN ('nan', 'unknown', '')) AS n_unknown, round(100.0 * count(*) FILTER (value IS NULL OR lower(value) IN ('nan', 'unknown', '')) / count(*), 6) AS unknown_pct FROM l GROUP BY 1")
def a34_category_profile(b):
    return stats.category_profile(b, ["dx", "sex", "position"])


@query(f"{B}, e AS (SELECT dx, count(*) AS n, avg(sbp_reference) AS m, var_samp(sbp_reference) AS v FROM b WHERE sbp_reference IS NOT NULL AND dx IS NOT NULL GROUP BY dx HAVING count(*) > 50), g AS (SELECT sum(n * m) / sum(n) AS gm FROM e) SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 4) AS f FROM e, g", digits=4)
def a35_anova_oneway(b):
    return stats.anova_oneway(b, "dx").drop("p", "significant")


@query()
def a35_anova_p_value(b):
    return stats.anova_oneway(b, "dx", more_than=5)


def _boxes(column: str) -> str:
    """Quartiles of the ten most frequent categories, or of those with over 50 rows where these are ten at most."""
    return f"""c AS (SELECT {column}, count(*) AS n FROM b WHERE {column} IS NOT NULL GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, {column}) AS k, (SELECT count(*) FROM c WHERE n > 50) > 10 AS many FROM c), t AS (SELECT {column} FROM k WHERE k <= 10 AND (many OR n > 50))
SELECT {column}, min(sbp_reference) AS least, round(quantile_cont(sbp_reference, 0.25), 6) AS q25, round(quantile_cont(sbp_reference, 0.5), 6) AS q50, round(quantile_cont(sbp_reference, 0.75), 6) AS q75, max(sbp_reference) AS most FROM b WHERE {column} IN (SELECT {column} FROM t) AND sbp_reference IS NOT NULL GROUP BY 1"""


@query(f"{B}, {_boxes('dx')}")
def a36_box_stats_wide(b):
    return stats.box_stats(b, "dx", "sbp_reference")


@query(f"{B}, {_boxes('position')}")
def a36_box_stats(b):
    return stats.box_stats(b, "position", "sbp_reference")


@query(f"{B} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {p}e0 AS p, round(quantile_cont({c}, {p}), 6) AS value FROM b" for c in ("sbp_reference", "dbp_reference") for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)))
def a37_target_percentiles(b):
    return stats.target_percentiles(b)


@query(f"{B} SELECT patient_id, count(*) AS n, round(avg(ptt_peak_to_foot), 6) AS mean, round(stddev_samp(ptt_peak_to_foot), 6) AS std FROM b GROUP BY patient_id HAVING count(*) >= 100")
def a49_patient_ptt_variability(b):
    return b.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ptt_peak_to_foot").alias("mean"), F.stddev_samp("ptt_peak_to_foot").alias("std")).where("n >= 100")


_LAGS = (1, 5, 10, 20, 50, 100)


@query(f"{B}, l AS (SELECT patient_id, sbp_reference, {', '.join(f'lag(sbp_reference, {k}) OVER w AS l{k}' for k in _LAGS)} FROM b WINDOW w AS (PARTITION BY patient_id ORDER BY timestamp, cycle_index)), e AS (SELECT patient_id, count(*) AS n, {', '.join(_r('sbp_reference', f'l{k}', 12) + f' AS r{k}' for k in _LAGS)} FROM l GROUP BY patient_id) " + " UNION ALL ".join(f"SELECT {k} AS lag, round(avg(r{k}) FILTER (n > {k + 10}), 6) AS autocorr, count(r{k}) FILTER (n > {k + 10}) AS n_patients FROM e" for k in _LAGS))
def w8_autocorrelation(b):
    return stats.autocorrelation(b)


@query(f"""{B}, k AS (SELECT patient_id, ptt_peak_to_foot AS x, sbp_reference AS y, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp, cycle_index) - 1 AS k, count(*) OVER (PARTITION BY patient_id) AS n FROM b), q AS (SELECT *, CASE WHEN k < n // 4 THEN 1 WHEN k < n // 2 THEN 2 WHEN k < 3 * n // 4 THEN 3 ELSE 4 END AS q FROM k WHERE n >= 200),
 r AS (SELECT patient_id, {', '.join(f'CASE WHEN isnan(corr(x, y) FILTER (q = {i})) THEN NULL ELSE corr(x, y) FILTER (q = {i}) END AS q{i}' for i in range(1, 5))} FROM q GROUP BY patient_id)
SELECT patient_id, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(q4, 6) AS q4, round(greatest(q1, q2, q3, q4) - least(q1, q2, q3, q4), 6) AS range, CAST(sign(q1) <> sign(q2) AS INT) + CAST(sign(q2) <> sign(q3) AS INT) + CAST(sign(q3) <> sign(q4) AS INT) AS sign_changes FROM r""")
def w9_quarter_correlation(b):
    return stats.quarter_correlation(b)


@query(f"""{B}, k AS (SELECT patient_id, ptt_peak_to_foot AS x, sbp_reference AS y, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp, cycle_index) - 1 AS k, count(*) OVER (PARTITION BY patient_id) AS n FROM b), p AS (SELECT DISTINCT patient_id, n, n // 4 AS size, n // 4 // 2 AS step FROM k), w AS (SELECT patient_id, size, step, n, unnest(generate_series(0, (n - size) // step)) AS w FROM p WHERE step > 0)
SELECT w.patient_id, w.w, {_r('x', 'y')} AS r, round(max(100.0 * w.w * step / w.n), 6) AS position FROM w JOIN k ON k.patient_id = w.patient_id AND k.k >= w.w * step AND k.k < w.w * step + size GROUP BY 1, 2""")
def w10_rolling_correlation(b):
    return stats.rolling_correlation(b)


# ---- joins --------------------------------------------------------------------------------------------------------
@query(f"WITH t AS ({fx.TRACKS_FX}) SELECT caseid FROM t GROUP BY caseid HAVING count(DISTINCT track) = 3", source=fx.TRACKS_FX)
def u1_suitable_cases(t):
    return joins.suitable_cases(t)


@query(f"WITH c AS ({fx.CASES_FX}) SELECT caseid, round((caseend - casestart) / 60, 6) AS duration_min FROM c WHERE (caseend - casestart) / 60 >= 30", source=fx.CASES_FX)
def p1_case_duration(c):
    return joins.case_duration(c).select("caseid", "duration_min")


@query(f"WITH c AS ({fx.CASES_FX}), t AS ({fx.TRACKS_FX}) SELECT caseid FROM c WHERE caseid NOT IN (SELECT caseid FROM t WHERE track = 'ART')", source=None)
def s7_pending_cases(spark, sf_dir):
    done = fx.view(spark, sf_dir, fx.TRACKS_FX).where("track = 'ART'")
    return joins.pending_cases(fx.view(spark, sf_dir, fx.CASES_FX), done).select("caseid")


_RR = f"p AS ({fx.PEAKS_FX}), l AS (SELECT *, (lead(sample_idx) OVER (PARTITION BY caseid ORDER BY sample_idx) - sample_idx) * 1000.0 / 500 AS len_ms FROM p), rr AS (SELECT *, 60000.0 / len_ms AS hr FROM l WHERE len_ms IS NOT NULL)"


@query(f"WITH {_RR} SELECT caseid, peak_no, round(len_ms, 6) AS len_ms, round(hr, 6) AS hr FROM rr WHERE len_ms BETWEEN 300 AND 1500", source=fx.PEAKS_FX)
def p2_cycle_length_filter(p):
    return joins.cycle_length_filter(joins.rr_intervals(p)).select("caseid", "peak_no", "len_ms", "hr")


@query(f"WITH {_RR} SELECT caseid, count(*) AS n, round(avg(len_ms), 6) AS rr_mean, round(stddev_pop(len_ms), 6) AS rr_std, round(greatest(40.0, least(180.0, avg(hr))), 6) AS hr, round(greatest(0.0, 1 - stddev_pop(len_ms) / avg(len_ms)), 6) AS quality FROM rr GROUP BY caseid HAVING count(*) + 1 >= 10", source=fx.PEAKS_FX)
def a1_rr_stats(p):
    return joins.rr_stats(joins.rr_intervals(p))


@query(f"WITH p AS ({fx.PEAKS_FX}), n AS ({fx.NUMERICS_FX}) SELECT p.caseid, peak_no, round(sbp, 6) AS sbp, round(dbp, 6) AS dbp FROM p JOIN n ON p.caseid = n.caseid AND n.bp_idx = CAST(round_even(sample_idx / 500.0 / 2.0, 0) AS INT)", source=None)
def j1_nearest_bp(spark, sf_dir):
    return joins.nearest_bp(fx.view(spark, sf_dir, fx.PEAKS_FX), fx.view(spark, sf_dir, fx.NUMERICS_FX)).select("caseid", "peak_no", "sbp", "dbp")


@query(f"""WITH p AS (SELECT caseid, peak_no, sample_idx / 500e0 AS t FROM ({fx.PEAKS_FX})), n AS (SELECT caseid, bp_idx * 2e0 + bp_idx % 3 * 0.25e0 AS t, sbp FROM ({fx.NUMERICS_FX}) WHERE sbp IS NOT NULL), m AS (SELECT p.caseid, peak_no, p.t, n.t AS bp_t, sbp, row_number() OVER (PARTITION BY p.caseid, peak_no ORDER BY abs(p.t - n.t), n.t) AS k FROM p JOIN n ON p.caseid = n.caseid)
SELECT caseid, peak_no, round(t, 6) AS t, round(bp_t, 6) AS bp_t, round(sbp, 6) AS sbp FROM m WHERE k = 1""", source=None)
def j1b_nearest_bp_irregular(spark, sf_dir):
    p = fx.view(spark, sf_dir, fx.PEAKS_FX).select("caseid", "peak_no", (F.col("sample_idx") / 500).alias("t"))
    n = fx.view(spark, sf_dir, fx.NUMERICS_FX).where("sbp IS NOT NULL").select("caseid", (F.col("bp_idx") * 2.0 + F.col("bp_idx") % 3 * 0.25).alias("t"), "sbp")
    return joins.nearest_bp_irregular(p, n).where("sbp IS NOT NULL")


@query(f"{B} SELECT coalesce(ptt_peak_to_foot BETWEEN 24 AND 28, false) AS inside, count(*) AS n, round(avg(sbp_reference), 6) AS sbp, round(avg(dbp_reference), 6) AS dbp, round(avg(hr_bpm), 6) AS hr FROM b GROUP BY 1")
def j9_boundary_vs_rest(b):
    return joins.boundary_vs_rest(b, "ptt_peak_to_foot")


@query(f"{B}, m AS (SELECT patient_id, count(*) FILTER (ptt_peak_to_foot BETWEEN 124 AND 148) AS n_inside, count(*) AS n FROM b GROUP BY patient_id) SELECT patient_id, n_inside, n, round(100.0 * n_inside / n, 6) AS inside_pct FROM m WHERE n_inside > 0")
def j9_patients_in_band(b):
    return joins.patients_in_band(b, "ptt_peak_to_foot", 124, 148)


@query(f"WITH c AS ({fx.CASES_FX}), t AS ({fx.TRACKS_FX}), u AS (SELECT caseid FROM t GROUP BY caseid HAVING count(DISTINCT track) = 3) SELECT caseid, sex FROM c WHERE caseid IN (SELECT caseid FROM u)", source=None)
def j5_keep_listed_cases(spark, sf_dir):
    return joins.keep_listed_cases(fx.view(spark, sf_dir, fx.CASES_FX), joins.suitable_cases(fx.view(spark, sf_dir, fx.TRACKS_FX))).select("caseid", "sex")


@query(f"WITH t AS ({fx.TRACKS_FX}) SELECT DISTINCT caseid FROM t ORDER BY caseid LIMIT 7", source=fx.TRACKS_FX)
def k7_first_files(t):
    return joins.first_cases(t, 7)


@query(f"WITH c AS ({fx.CASES_FX}), t AS ({fx.TRACKS_FX}) SELECT count(*) AS total, count(*) FILTER (caseid IN (SELECT caseid FROM t WHERE track = 'ART')) AS ok, count(*) FILTER (caseid NOT IN (SELECT caseid FROM t WHERE track = 'ART')) AS failed FROM c", source=None)
def s8_run_summary(spark, sf_dir):
    done = fx.view(spark, sf_dir, fx.TRACKS_FX).where("track = 'ART'").select("caseid", F.lit(True).alias("done"))
    cases = fx.view(spark, sf_dir, fx.CASES_FX).join(done, "caseid", "left")
    return io.run_summary(cases.withColumn("status", F.when(F.col("done"), "ok").otherwise("failed")))


@query(f"WITH c AS ({fx.CASES_FX}) SELECT caseid, coalesce(department, 'unknown') AS department, 'unknown' AS dx, age, CAST(NULL AS DOUBLE) AS bmi FROM c", source=fx.CASES_FX)
def p12_metadata_defaults(c):
    return joins.metadata_defaults(c, ("department", "dx"), ("age", "bmi")).select("caseid", "department", "dx", "age", "bmi")


@query(f"WITH c AS ({fx.CASES_FX}), t AS ({fx.TRACKS_FX}) SELECT t.caseid, t.track, coalesce(sex, 'unknown') AS sex, coalesce(department, 'unknown') AS department, coalesce(approach, 'unknown') AS approach FROM t LEFT JOIN c ON c.caseid = t.caseid", source=None)
def j3_attach_clinical(spark, sf_dir):
    return joins.attach_clinical(fx.view(spark, sf_dir, fx.TRACKS_FX), fx.view(spark, sf_dir, fx.CASES_FX)).select("caseid", "track", "sex", "department", "approach")


@query(f"""WITH s AS (SELECT CAST(user_id AS INT) AS caseid, event_id AS i, value AS v, event_type = 'signup' AS pk FROM events), c AS (SELECT *, sum(CAST(pk AS INT)) OVER (PARTITION BY caseid ORDER BY i ROWS UNBOUNDED PRECEDING) AS beat FROM s), m AS (SELECT *, max(beat) OVER (PARTITION BY caseid) AS last FROM c)
SELECT caseid, CAST(beat AS BIGINT) AS beat, min(i) AS start, count(*) AS n, round(sum(v), 6) AS total FROM m WHERE beat > 0 AND beat < last GROUP BY caseid, beat""", source="SELECT CAST(user_id AS INT) AS caseid, event_id AS sample_idx, value AS v, event_type = 'signup' AS is_peak FROM events")
def j2_segment_cycles(s):
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return joins.segment_cycles(s).select("caseid", "beat", "start", F.size("values").cast("bigint").alias("n"), total.alias("total"))


@query(f"""WITH c AS (SELECT *, CASE WHEN age > 0 AND age <= 40 THEN 1 WHEN age > 40 AND age <= 60 THEN 2 WHEN age > 60 AND age <= 100 THEN 3 END AS age_group FROM ({fx.CASES_FX})), k AS (SELECT caseid, age_group, row_number() OVER (PARTITION BY age_group ORDER BY md5('42|' || caseid), caseid) AS k FROM c WHERE age_group IS NOT NULL) SELECT caseid, age_group FROM k WHERE k <= 10""", source=fx.CASES_FX)
def k5_stratified_sample(c):
    return joins.stratified_sample(c, 30).select("caseid", "age_group")


# ---- model input ----------------------------------------------------------------------------------------------------
@query(f"{B}, m AS (SELECT avg(bmi) AS m FROM b) SELECT patient_id, count(*) AS n, round(avg(coalesce(bmi, m)), 6) AS bmi, count(*) FILTER (coalesce(dx, 'Unknown') = 'Unknown') AS n_unknown FROM b, m GROUP BY patient_id")
def p11_fill_static(b):
    filled = modelprep.fill_static(b, ["bmi"], ["dx"])
    return filled.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.avg("bmi").alias("bmi"), F.count_if(F.col("dx") == "Unknown").alias("n_unknown"))


@query(f"{B}, t AS (SELECT opname FROM b WHERE opname IS NOT NULL GROUP BY opname ORDER BY count(*) DESC, opname LIMIT 50) SELECT CASE WHEN t.opname IS NULL THEN 'Other' ELSE t.opname END AS opname, count(*) AS n FROM b LEFT JOIN t ON b.opname = t.opname GROUP BY 1")
def k2_top_k_categories(b):
    return modelprep.top_k_categories(b, "opname").groupBy("opname").agg(F.count(F.lit(1)).alias("n"))


@query(f"{B}, d AS (SELECT dx, CAST(dense_rank() OVER (ORDER BY dx) - 1 AS INT) AS dx_code FROM (SELECT DISTINCT dx FROM b WHERE dx IS NOT NULL)) SELECT patient_id, cycle_index, dx_code FROM b LEFT JOIN d ON b.dx = d.dx")
def f5_label_encode(b):
    return modelprep.label_encode(b, "dx").select("patient_id", "cycle_index", F.col("dx_code").cast("int").alias("dx_code"))


_SPLIT = "i AS (SELECT patient_id, row_number() OVER (ORDER BY md5('42|' || patient_id), patient_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT patient_id FROM b)), sp AS (SELECT patient_id, CASE WHEN k <= floor(floor(n * 0.8) * 0.9) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS part FROM i)"


@query(f"{B}, {_SPLIT} SELECT patient_id, part FROM sp")
def w12_patient_split(b):
    return modelprep.patient_split(b)


@query(f"{B}, {_SPLIT} SELECT patient_id, CAST(k % 5 AS INT) AS fold FROM i")
def w12b_group_kfold(b):
    return modelprep.group_kfold(b)


@query(f"{B}, {_SPLIT}, f AS (SELECT avg(hr_bpm) AS m, stddev_pop(hr_bpm) AS s FROM b JOIN sp ON b.patient_id = sp.patient_id WHERE part = 'train') SELECT b.patient_id, cycle_index, part, round((hr_bpm - m) / (s + 1e-7), 6) AS hr_bpm FROM b JOIN sp ON b.patient_id = sp.patient_id, f")
def w14_fit_transform_scaler(b):
    return modelprep.fit_transform_scaler(b, modelprep.patient_split(b), ["hr_bpm"]).select("patient_id", "cycle_index", "part", "hr_bpm")


@query(f"""{B}, s AS (SELECT patient_id, cycle_index, row_number() OVER w AS k, count(*) OVER (PARTITION BY patient_id) AS n, sum(hr_bpm) OVER (PARTITION BY patient_id ORDER BY timestamp, cycle_index ROWS 29 PRECEDING) AS total, sbp_reference AS y, age FROM b WINDOW w AS (PARTITION BY patient_id ORDER BY timestamp, cycle_index))
SELECT patient_id, cycle_index AS end_idx, 30 AS size, round(total, 3) AS total, round(y, 3) AS target, age AS static_cont, CAST(age AS INT) % 7 AS static_cat FROM s WHERE k >= 30 AND n > 30""", digits=3)
def w13_sliding_sequences(b):
    s = modelprep.sliding_sequences(b.withColumn("age_code", F.col("age").cast("int") % 7), ["hr_bpm"], ["sbp_reference"], numbers=["age"], codes=["age_code"])
    first = lambda c: F.col(c)[0].cast("double").alias(c)
    return s.select("patient_id", "end_idx", F.size("seq").alias("size"), F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[0].cast("double")).alias("total"), first("target"), first("static_cont"), F.col("static_cat")[0].alias("static_cat"))


@query(f"{B}, {_SPLIT} SELECT part, count(*) AS n, round(sum(hr_bpm), 4) AS hr FROM b JOIN sp ON b.patient_id = sp.patient_id GROUP BY part", digits=4)
def w14_inverse_scaler(b):
    split = modelprep.patient_split(b)
    fit = modelprep.fit_scaler(modelprep.split_members(b, split, "train"), ["hr_bpm"])
    back = modelprep.unscale(modelprep.scale(b, fit, ["hr_bpm"]), fit, ["hr_bpm"])
    return back.join(split, "patient_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("hr_bpm").alias("hr"))


@query(f"{B}, {_SPLIT} SELECT b.patient_id, cycle_index FROM b JOIN sp ON b.patient_id = sp.patient_id WHERE part = 'test'")
def j6_split_members(b):
    return modelprep.split_members(b, modelprep.patient_split(b), "test").select("patient_id", "cycle_index")


@query(f"{B} SELECT patient_id, cycle_index FROM b ORDER BY md5('42|' || patient_id || '|' || cycle_index), patient_id, cycle_index LIMIT 5000")
def k4_sample_rows(b):
    return modelprep.sample_rows(b, 5000, ["patient_id", "cycle_index"]).select("patient_id", "cycle_index")


# ---- evaluation -------------------------------------------------------------------------------------------------------
def _metrics(by: str) -> str:
    one = ", ".join(f"avg({t}_pred - {t}_true) AS {t}_me, stddev_pop({t}_pred - {t}_true) AS {t}_std, avg(abs({t}_pred - {t}_true)) AS {t}_mae, sqrt(avg(({t}_pred - {t}_true) * ({t}_pred - {t}_true))) AS {t}_rmse, 1 - avg(({t}_pred - {t}_true) * ({t}_pred - {t}_true)) / nullif(var_pop({t}_true), 0) AS {t}_r2" for t in ("sbp", "dbp"))
    cols = ", ".join(f"round({t}_{m}, 6) AS {t}_{m}" for t in ("sbp", "dbp") for m in ("me", "std", "mae", "rmse", "r2"))
    both = "round(sqrt((sbp_rmse * sbp_rmse + dbp_rmse * dbp_rmse) / 2), 6) AS rmse, round((sbp_mae + dbp_mae) / 2, 6) AS mae, round((sbp_r2 + dbp_r2) / 2, 6) AS r2"
    return f"SELECT {by}n, {cols}, {both} FROM (SELECT {by}count(*) AS n, {one} FROM p {'GROUP BY ' + by.rstrip(', ') if by else ''}) m"


@query(f"WITH p AS ({fx.PREDICTIONS_FX}) {_metrics('')}", source=fx.PREDICTIONS_FX)
def a45_regression_metrics(p):
    return evaluate.regression_metrics(p)


@query(f"WITH p AS ({fx.PREDICTIONS_FX}), m AS ({_metrics('patient_id, ')}) SELECT *, abs(sbp_me) <= 5 AND sbp_std <= 8 AND abs(dbp_me) <= 5 AND dbp_std <= 8 AS aami_pass FROM m", source=fx.PREDICTIONS_FX)
def a46_aami_compliance(p):
    return evaluate.aami_compliance(evaluate.regression_metrics(p, ["patient_id"]))


_WEIGHT = "CASE WHEN dbp_true < 60 OR dbp_true > 90 THEN 2 WHEN sbp_true < 70 OR sbp_true > 160 THEN 3 WHEN sbp_true < 90 OR sbp_true > 140 THEN 2 ELSE 1 END"


_E = {t: f"({t}_pred - {t}_true)" for t in ("sbp", "dbp")}
_HUBER = {t: f"CASE WHEN abs({e}) <= 1 THEN {e} * {e} / 2 ELSE abs({e}) - 0.5 END" for t, e in _E.items()}


@query(f"""WITH p AS ({fx.PREDICTIONS_FX}) SELECT round(avg({_WEIGHT} * ({_E['sbp']} * {_E['sbp']} + {_E['dbp']} * {_E['dbp']}) / 2), 6) AS weighted_mse, round(avg(({_HUBER['sbp']} + {_HUBER['dbp']}) / 2), 6) AS huber,
 round(avg({_E['sbp']}) * avg({_E['sbp']}) + var_samp({_E['sbp']}) + avg({_E['dbp']}) * avg({_E['dbp']}) + var_samp({_E['dbp']}), 6) AS aami_loss, round(avg(greatest(0.0, dbp_pred - sbp_pred)), 6) AS order_penalty, round(avg(greatest(0.0, 10 - (sbp_pred - dbp_pred)) + greatest(0.0, sbp_pred - dbp_pred - 150)), 6) AS pulse_penalty,
 round(avg(greatest(0.0, 40 - sbp_pred) + greatest(0.0, sbp_pred - 250) + greatest(0.0, 20 - dbp_pred) + greatest(0.0, dbp_pred - 150)), 6) AS range_penalty FROM p""", source=fx.PREDICTIONS_FX)
def a47_weighted_error(p):
    return evaluate.weighted_error(p)


def _ema_sql(t: str, alphas: tuple[float, ...] = (0.1,)) -> str:
    """Running averages of earlier readings: s (patient_id, cycle_index, k, a, y, ema)."""
    listed = ", ".join(f"({a}e0)" for a in alphas)
    return f"""o{t} AS (SELECT patient_id, cycle_index, {t}_reference AS y, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp, cycle_index) AS k FROM b),
 m{t} AS (SELECT *, count(y) OVER (PARTITION BY patient_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o{t}),
 w{t} AS (SELECT *, CASE WHEN m = 0 THEN y / (1 - a) ELSE a * y / pow(1 - a, m + 1) END AS w FROM m{t}, (VALUES {listed}) AS v(a)),
 s{t} AS (SELECT patient_id, cycle_index, k, a, y, CASE WHEN m = 0 THEN y ELSE pow(1 - a, m) * sum(w) OVER (PARTITION BY patient_id, a ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS ema FROM w{t})"""


@query(f"{B}, {_ema_sql('sbp')} SELECT patient_id, cycle_index, round(ema, 4) AS sbp_pred FROM ssbp", digits=4)
def w11_ema_baseline(b):
    return evaluate.ema_baseline(b).select("patient_id", "cycle_index", "sbp_pred")


@query(f"""{B}, o AS (SELECT patient_id, cycle_index, sbp_reference AS y, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp, cycle_index) AS k FROM b), h AS (SELECT patient_id, avg(y) AS start FROM o WHERE k <= 50 GROUP BY patient_id),
 l AS (SELECT patient_id, list(y ORDER BY k) FILTER (y IS NOT NULL) AS ys FROM o WHERE k > 50 GROUP BY patient_id), m AS (SELECT *, count(y) OVER (PARTITION BY patient_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o WHERE k > 50)
SELECT m.patient_id, cycle_index, round(list_reduce(list_concat([start], l.ys[1:m]), lambda e, x: 0.1e0 * x + 0.9e0 * e), 4) AS sbp_pred FROM m JOIN h ON m.patient_id = h.patient_id JOIN l ON m.patient_id = l.patient_id""", digits=4)
def w11b_ema_warmup(b):
    return evaluate.ema_warmup(b).select("patient_id", "cycle_index", "sbp_pred")


_SWEEP = (0.05, 0.1, 0.2, 0.3)


@query(f"""{B}, {_ema_sql('sbp', _SWEEP)}, {_ema_sql('dbp', _SWEEP)},
 p AS (SELECT ssbp.patient_id, ssbp.a AS alpha, ssbp.ema - ssbp.y AS es, sdbp.ema - sdbp.y AS ed FROM ssbp JOIN sdbp ON ssbp.patient_id = sdbp.patient_id AND ssbp.k = sdbp.k AND ssbp.a = sdbp.a WHERE ssbp.y IS NOT NULL AND sdbp.y IS NOT NULL),
 e AS (SELECT alpha, patient_id, avg(es) AS ms, stddev_pop(es) AS ss, avg(ed) AS md, stddev_pop(ed) AS sd FROM p GROUP BY 1, 2)
SELECT alpha, count(*) AS n_patients, round(avg(CASE WHEN abs(ms) <= 5 AND ss <= 8 AND abs(md) <= 5 AND sd <= 8 THEN 1e0 ELSE 0e0 END), 5) AS share_pass, round(avg(ms), 5) AS sbp_me, round(avg(ss), 5) AS sbp_std, round(avg(sd), 5) AS dbp_std FROM e GROUP BY alpha""", digits=5)
def a48_alpha_sweep(b):
    return evaluate.alpha_sweep(b)


# ---- arrays --------------------------------------------------------------------------------------------------------------
_CYCLES = "SELECT label AS caseid, vec_id AS cycle_index, CAST(embedding AS ARRAY<DOUBLE>) AS ppg FROM embeddings"
_C = "WITH c AS (SELECT label AS caseid, vec_id AS cycle_index, CAST(embedding AS DOUBLE[]) AS ppg FROM embeddings)"


@query(f"{_C} SELECT cycle_index, round(list_sum(list_transform(ppg, lambda x: (x - list_min(ppg)) / (list_max(ppg) - list_min(ppg)))), 6) AS total FROM c", source=_CYCLES)
def f3_minmax_normalise(c):
    return c.select("cycle_index", F.aggregate(arrays.minmax_normalise(F.col("ppg")), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"{_C}, m AS (SELECT cycle_index, ppg, list_avg(ppg) AS m, list_stddev_pop(ppg) AS s FROM c) SELECT cycle_index, round(m, 6) AS mean, round(s, 6) AS std, round(list_avg(list_transform(ppg, lambda x: (x - m) * (x - m) * (x - m))) / (s * s * s), 6) AS skew, round(list_avg(list_transform(ppg, lambda x: (x - m) * (x - m) * (x - m) * (x - m))) / (s * s * s * s) - 3, 6) AS kurtosis FROM m", source=_CYCLES)
def f6_array_stats(c):
    return c.select("cycle_index", arrays.mean(F.col("ppg")).alias("mean"), arrays.pop_std(F.col("ppg")).alias("std"), arrays.skewness(F.col("ppg")).alias("skew"), arrays.excess_kurtosis(F.col("ppg")).alias("kurtosis"))


@query(f"{_C}, d AS (SELECT cycle_index, list_transform(generate_series(1, len(ppg) - 1), lambda i: (ppg[i + 1] - ppg[i]) * 500) AS d FROM c), e AS (SELECT *, list_transform(generate_series(1, len(d) - 1), lambda i: (d[i + 1] - d[i]) * 500) AS dd FROM d) SELECT cycle_index, round(list_max(d), 4) AS max_upslope, round(list_min(d), 4) AS max_downslope, round(abs(list_min(d) / (list_max(d) + 1e-6)), 4) AS slope_ratio, round(list_max(dd), 4) AS max_acceleration, round(list_min(dd), 4) AS min_acceleration FROM e", digits=4, source=_CYCLES)
def f7_array_derivatives(c):
    return c.select("cycle_index", arrays.derivatives(F.col("ppg")).alias("d")).select("cycle_index", "d.*")


@query(f"{_C}, p AS (SELECT *, list_position(ppg, list_max(ppg)) AS pk FROM c), t AS (SELECT cycle_index, pk, list_transform(generate_series(1, len(ppg) - 1), lambda i: (ppg[i + 1] + ppg[i]) / 2) AS a FROM p) SELECT cycle_index, round(CASE WHEN list_sum(a) > 0 THEN coalesce(list_sum(a[1:pk - 1]), 0) / list_sum(a) ELSE 0.5 END, 4) AS ratio FROM t", digits=4, source=_CYCLES)
def f8_area_ratio(c):
    return c.select("cycle_index", arrays.area_ratio(F.col("ppg")).alias("ratio"))


@query(f"{_C}, m AS (SELECT caseid, i, median(ppg[i]) AS v FROM c, generate_series(1, 64) AS g(i) GROUP BY 1, 2), t AS (SELECT caseid, list(v ORDER BY i) AS t FROM m GROUP BY caseid) SELECT cycle_index, round(list_sum(list_transform(generate_series(1, 64), lambda i: (ppg[i] - list_avg(ppg)) / (list_stddev_pop(ppg) + 1e-6) * (t[i] - list_avg(t)) / (list_stddev_pop(t) + 1e-6))) / 64, 6) AS r FROM c JOIN t ON c.caseid = t.caseid", source=_CYCLES)
def a2_template_match(c):
    template = select.median_template(c)
    return c.join(template, "caseid").select("cycle_index", arrays.template_corr(F.col("ppg"), F.col("template")).alias("r"))


_TEMPLATE = "m AS (SELECT caseid, i, median(ppg[i]) AS v FROM c, generate_series(1, 64) AS g(i) GROUP BY 1, 2), t AS (SELECT caseid, list(v ORDER BY i) AS t FROM m GROUP BY caseid), r AS (SELECT cycle_index, list_sum(list_transform(generate_series(1, 64), lambda i: (ppg[i] - list_avg(ppg)) / (list_stddev_pop(ppg) + 1e-6) * (t[i] - list_avg(t)) / (list_stddev_pop(t) + 1e-6))) / 64 AS r FROM c JOIN t ON c.caseid = t.caseid)"


@query(f"{_C}, {_TEMPLATE} SELECT cycle_index, round(r, 6) AS cycle_correlation FROM r WHERE r >= 0.3", source=_CYCLES)
def p4_template_correlation_filter(c):
    return select.template_correlation_filter(c, select.median_template(c), least=0.3).select("cycle_index", "cycle_correlation")


@query(f"{_C}, h AS (SELECT cycle_index, list_transform(ppg, lambda x: (x - list_min(ppg)) / (list_max(ppg) - list_min(ppg))) AS n FROM c), k AS (SELECT cycle_index, list_min(list_filter(generate_series(1, len(n) - 1), lambda i: n[i] < 0.5 AND n[i + 1] >= 0.5)) AS r, list_min(list_filter(generate_series(1, len(n) - 1), lambda i: n[i] >= 0.5 AND n[i + 1] < 0.5)) AS f FROM h) SELECT cycle_index, round(coalesce(CASE WHEN f > r THEN (f - r) * 1000.0 / 500 END, 0), 6) AS width FROM k", source=_CYCLES)
def f9_pulse_width_50(c):
    return c.select("cycle_index", arrays.pulse_width_50(F.col("ppg")).alias("width"))


@query(f"{_C}, p AS (SELECT *, list_position(ppg, list_max(ppg)) AS pk FROM c), d AS (SELECT cycle_index, list_transform(generate_series(1, greatest(pk - 1, 1)), lambda i: ppg[i + 1] - ppg[i]) AS d FROM p) SELECT cycle_index, CAST(list_position(d, list_max(d)) - 1 AS BIGINT) AS at FROM d", source=_CYCLES)
def f10_max_slope(c):
    return c.select("cycle_index", arrays.max_slope(F.col("ppg")).cast("bigint").alias("at"))


# segments of several sizes, with a slow wave in some and samples missing in others
def _segment():
    return F.when(F.col("cycle_index") % 11 == 0, F.slice("ppg", 1, 15)).when(F.col("cycle_index") % 3 == 0, F.transform("ppg", lambda x, i: F.when(i % 4 == 0, x * (F.col("cycle_index") % 40)))).when(F.col("cycle_index") % 3 == 1, F.transform("ppg", lambda x, i: x + 9.0 * F.sin(i / 6.0))).otherwise(F.transform("ppg", lambda x: x * (F.col("cycle_index") % 40)))


_QUALITY = "CASE WHEN n < 20 THEN 'too_short' WHEN len(v) = 0 THEN 'all_null' WHEN len(v) < 20 THEN 'few_valid' WHEN list_max(v) - list_min(v) < 1e-6 THEN 'flat' WHEN list_stddev_pop(v) < 3 THEN 'low_amplitude' WHEN len(list_distinct(v)) < 5 THEN 'saturated' WHEN list_stddev_pop(d2) / 2 > 0.01 AND list_stddev_pop(v) < 5 * list_stddev_pop(d2) / 2 THEN 'low_snr' WHEN list_stddev_pop(d1) / sqrt(2) > 0.01 AND list_max(v) - list_min(v) < 3 * list_stddev_pop(d1) / sqrt(2) THEN 'weak_pulse' ELSE '' END"


@query(f"""{_C}, s AS (SELECT cycle_index, CASE WHEN cycle_index % 11 = 0 THEN ppg[1:15] WHEN cycle_index % 3 = 0 THEN list_transform(ppg, lambda x, i: CASE WHEN (i - 1) % 4 = 0 THEN x * (cycle_index % 40) END) WHEN cycle_index % 3 = 1 THEN list_transform(ppg, lambda x, i: x + 9 * sin((i - 1) / 6e0)) ELSE list_transform(ppg, lambda x: x * (cycle_index % 40)) END AS a FROM c),
 v AS (SELECT cycle_index, len(a) AS n, list_filter(a, lambda x: x IS NOT NULL) AS v FROM s), d AS (SELECT *, list_transform(generate_series(1, len(v) - 1), lambda i: v[i + 1] - v[i]) AS d1 FROM v), e AS (SELECT *, list_transform(generate_series(1, len(d1) - 1), lambda i: d1[i + 1] - d1[i]) AS d2 FROM d) SELECT cycle_index, {_QUALITY} AS reason FROM e""", source=_CYCLES)
def p10_segment_quality(c):
    return c.select("cycle_index", _segment().alias("a")).select("cycle_index", arrays.segment_quality(F.col("a")).alias("reason"))


@query(f"{B} SELECT patient_id, cycle_index FROM b WHERE sbp_reference > dbp_reference AND bmi IS NOT NULL AND position IS NOT NULL AND dx IS NOT NULL")
def p5_drop_incomplete(b):
    return select.drop_incomplete(b).select("patient_id", "cycle_index")


@query(f"WITH n AS ({fx.NUMERICS_FX}) SELECT caseid, bp_idx, round(coalesce(sbp, avg(sbp) OVER (PARTITION BY caseid)), 8) AS sbp FROM n", digits=8, source=fx.NUMERICS_FX)
def p13_impute_mean(n):
    return select.impute_mean(n, "sbp").select("caseid", "bp_idx", "sbp")


@query(f"WITH p AS ({fx.PREDICTIONS_FX}) SELECT patient_id, CAST({_WEIGHT} AS DOUBLE) AS weight, count(*) AS n FROM p GROUP BY 1, 2", source=fx.PREDICTIONS_FX)
def p15_bp_range_weight(p):
    return p.groupBy("patient_id", evaluate.bp_range_weight("sbp_true", "dbp_true").alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH n AS ({fx.NUMERICS_FX}) SELECT caseid, bp_idx, round(coalesce(dbp - lag(dbp) OVER (PARTITION BY caseid ORDER BY bp_idx), 0), 6) AS d FROM n", source=fx.NUMERICS_FX)
def w5_first_difference(n):
    return n.select("caseid", "bp_idx", select.first_difference("dbp", "caseid", "bp_idx").alias("d"))


@query(f"WITH n AS ({fx.NUMERICS_FX}), s AS (SELECT caseid, bp_idx, abs(coalesce(dbp - lag(dbp) OVER (PARTITION BY caseid ORDER BY bp_idx), 0)) AS s FROM n) SELECT caseid, bp_idx, round(0.4 * avg(s) OVER w + 0.15 * max(s) OVER w, 8) AS threshold FROM s WINDOW w AS (PARTITION BY caseid ORDER BY bp_idx ROWS 999 PRECEDING)", digits=8, source=fx.NUMERICS_FX)
def w4_adaptive_threshold(n):
    return select.adaptive_threshold(n, "dbp").select("caseid", "bp_idx", "threshold")


@query(f"WITH {_RR} SELECT caseid, peak_no, round(len_ms, 6) AS len_ms, round(hr, 6) AS hr FROM rr", source=fx.PEAKS_FX)
def w6_rr_intervals(p):
    return joins.rr_intervals(p).select("caseid", "peak_no", "len_ms", "hr")


@query(f"{B}, f AS (SELECT patient_id FROM (SELECT patient_id, timestamp, cycle_index, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp, cycle_index) AS k FROM b) WHERE k = 1 ORDER BY timestamp, cycle_index, patient_id LIMIT 5) SELECT patient_id, count(*) AS n FROM b WHERE patient_id IN (SELECT patient_id FROM f) GROUP BY patient_id")
def w15_first_patients(b):
    return select.first_patients(b, 5).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{B}, {_N} SELECT count(*) FILTER (n < 600) AS n_short FROM n")
def a50_short_patients(b):
    return stats.samples_per_patient(b, 600).select("n_short")


@query(f"{B} SELECT patient_id, cycle_index, round(greatest(40, least(100, hr_bpm)), 6) AS hr, round(round_even(amplitude_ratio_ra * 10, 0), 6) AS tenths FROM b")
def f4_clip_round(b):
    return b.select("patient_id", "cycle_index", expr.clip("hr_bpm", 40, 100).alias("hr"), expr.half_even(F.col("amplitude_ratio_ra") * 10).alias("tenths"))


@query(f"{B}, n AS (SELECT patient_id, cycle_index, lead(sbp_reference) OVER (PARTITION BY patient_id ORDER BY timestamp, cycle_index) - sbp_reference AS d FROM b) SELECT patient_id, cycle_index, CASE WHEN d < -5 THEN 0 WHEN d > 5 THEN 2 ELSE 1 END AS trend FROM n WHERE d IS NOT NULL")
def f13_trend_label(b):
    later = F.lead("sbp_reference").over(normalize.Window.partitionBy("patient_id").orderBy("timestamp", "cycle_index"))
    return b.withColumn("later", later).select("patient_id", "cycle_index", arrays.trend_label(F.col("sbp_reference"), F.col("later")).alias("trend")).where("trend IS NOT NULL")


@query(f"WITH c AS ({fx.CASES_FX}) SELECT caseid, 'case_' || lpad(CAST(caseid AS VARCHAR), 5, '0') || '.npz' AS file, 'wave_' || replace(t, '/', '_') AS key FROM c, (VALUES ('SNUADC/ECG_II'), ('SNUADC/PLETH')) AS v(t)", source=fx.CASES_FX)
def f2_key_names(c):
    return select.storage_keys(c, ["SNUADC/ECG_II", "SNUADC/PLETH"])


@query(f"{B}, f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(c, 'sbp_reference')} AS r_sbp FROM b" for c in FEATURES) + ") SELECT feature, r_sbp, CAST(row_number() OVER (ORDER BY abs(r_sbp) DESC, feature) AS INT) AS place FROM f")
def k3_sort_by_abs_corr(b):
    r = rounded(stats.feature_bp_correlation(b, FEATURES).select("feature", "r_sbp"))
    return r.withColumn("place", F.row_number().over(normalize.Window.orderBy(F.abs("r_sbp").desc(), "feature")))


@query(f"{B} SELECT patient_id, round(avg(ptt_peak_to_foot), 6) AS with_foot, round(avg(pat_ecg_ppg), 6) AS without_foot FROM b GROUP BY patient_id")
def p14_ptt_column_choice(b):
    less = b.drop("ptt_peak_to_foot")
    both = b.withColumns({"x": F.col(expr.ptt_column(b)), "y": F.col(expr.ptt_column(less))})
    return both.groupBy("patient_id").agg(F.avg("x").alias("with_foot"), F.avg("y").alias("without_foot"))


@query(f"{B} SELECT patient_id, cycle_index, row_number() OVER (ORDER BY session_id, timestamp, cycle_index) AS place FROM b")
def k6_global_time_sort(b):
    key = F.concat_ws("|", "session_id", F.lpad((F.col("timestamp") * 1000).cast("bigint").cast("string"), 15, "0"), F.lpad(F.col("cycle_index").cast("string"), 10, "0"))
    return numbered(b, key, (6, 8, 10, 20), "place").select("patient_id", "cycle_index", F.col("place").cast("bigint").alias("place"))


@query(f"{B} SELECT patient_id, cycle_index, coalesce({_valid(20, 250, 30, 400, 0.01, 1.2, 0.6)}, false) AS valid, ({_RULE}) AS first_failed_rule FROM b")
def t3_stream_quality(b):
    return quality_stream.judged(b).select("patient_id", "cycle_index", "valid", "first_failed_rule")


# ---- waveforms ----------------------------------------------------------------------------------------------------
# Kernels on arrays have an SQL twin where SQL can ask the same; jobs on recordings are compared with plain NumPy in tests.
_SPIKED = "s AS (SELECT cycle_index, list_transform(ppg, lambda x, i: CASE WHEN (i - 1) % 16 = cycle_index % 16 THEN x * 50 ELSE x END) AS a FROM c)"


def _spiked():
    return F.transform("ppg", lambda x, i: F.when(i % 16 == F.col("cycle_index") % 16, x * 50).otherwise(x))


def _summed(column: str):
    """A sum of an array that tells places apart."""
    return F.aggregate(F.transform(column, lambda x, i: x * (i % 7 + 1)), F.lit(0.0), lambda a, x: a + x)


@query(f"""{_C}, {_SPIKED}, m AS (SELECT cycle_index, a, list_median(a) AS m FROM s), d AS (SELECT *, 5 * 1.4826 * list_median(list_transform(a, lambda x: abs(x - m))) AS lim FROM m),
 g AS (SELECT *, list_filter(generate_series(1, len(a)), lambda i: abs(a[i] - m) <= lim) AS good FROM d),
 r AS (SELECT cycle_index, list_transform(generate_series(1, len(a)), lambda i: CASE WHEN abs(a[i] - m) <= lim THEN a[i]
   WHEN list_max(list_filter(good, lambda k: k < i)) IS NULL THEN a[good[1]] WHEN list_min(list_filter(good, lambda k: k > i)) IS NULL THEN a[good[-1]]
   ELSE a[list_max(list_filter(good, lambda k: k < i))] + (a[list_min(list_filter(good, lambda k: k > i))] - a[list_max(list_filter(good, lambda k: k < i))]) * (i - list_max(list_filter(good, lambda k: k < i))) / (list_min(list_filter(good, lambda k: k > i)) - list_max(list_filter(good, lambda k: k < i))) END) AS y FROM g)
SELECT cycle_index, round(list_sum(list_transform(y, lambda x, i: x * ((i - 1) % 7 + 1))), 5) AS total, round(list_max(y), 5) AS most FROM r""", digits=5, source=_CYCLES)
def g4_remove_spikes(c):
    clean = c.select("cycle_index", recordings.remove_spikes(_spiked()).alias("y"))
    return clean.select("cycle_index", _summed("y").alias("total"), F.array_max("y").alias("most"))


@query(f"""{_C}, y AS (SELECT cycle_index, list_transform(generate_series(0, 31), lambda j: list_sum(list_transform(generate_series(0, 63), lambda n: ppg[n + 1] * (1 + 2 * list_sum(list_transform(generate_series(1, 15), lambda k: cos(2 * pi() * k * (j / 32e0 - n / 64e0)))) + 2 * cos(pi() * n / 2) * cos(pi() * j)))) / 64) AS y FROM c)
SELECT cycle_index, round(list_sum(list_transform(y, lambda x, i: x * ((i - 1) % 7 + 1))), 6) AS total, round(list_max(y), 6) AS most FROM y""", source=_CYCLES)
def g3_resample_cycle(c):
    short = c.select("cycle_index", recordings.resample("ppg", 32).alias("y"))
    return short.select("cycle_index", _summed("y").alias("total"), F.array_max("y").alias("most"))


@query(f"""{_C}, w AS (SELECT cycle_index, list_transform(ppg, lambda x, i: (x - list_avg(ppg)) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 64))) AS w FROM c),
 p AS (SELECT cycle_index, list_transform(generate_series(0, 8), lambda k: (pow(list_sum(list_transform(w, lambda x, i: x * cos(2 * pi() * k * (i - 1) / 64))), 2) + pow(list_sum(list_transform(w, lambda x, i: x * sin(2 * pi() * k * (i - 1) / 64))), 2)) / (32 * 24) * CASE WHEN k > 0 THEN 2 ELSE 1 END) AS p FROM w)
SELECT cycle_index, round(list_sum(p[2:9]), 6) AS cardiac, round(p[1], 6) AS low FROM p""", source=_CYCLES)
def g11_welch_power(c):
    # 64 samples at 32 Hz: bins of half a Hertz
    return c.select("cycle_index", recordings.welch_power("ppg", 32).alias("w")).select("cycle_index", F.col("w")[0].alias("cardiac"), F.col("w")[1].alias("low"))


_LAGGED = "list_transform(generate_series(1, 64), lambda i: coalesce(ppg[i - cycle_index % 9], 0))"


@query(f"""{_C}, s AS (SELECT cycle_index, ppg AS a, {_LAGGED} AS b FROM c), x AS (SELECT cycle_index, lag, list_sum(list_transform(generate_series(greatest(1, 1 - lag), least(64, 64 - lag)), lambda i: (a[i] - list_avg(a)) * (b[i + lag] - list_avg(b)))) AS v FROM s, generate_series(-12, 12) AS g(lag))
SELECT cycle_index, CAST(arg_max(lag, v) AS BIGINT) AS lag FROM x GROUP BY cycle_index""", source=_CYCLES)
def g13_best_lag(c):
    late = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.coalesce(F.when(i > F.col("cycle_index") % 9, F.get("ppg", (i - F.col("cycle_index") % 9 - 1).cast("int"))), F.lit(0.0)))
    return c.select("cycle_index", recordings.best_lag(F.col("ppg"), late, 12).alias("lag"))


@query(f"{_C}, m AS (SELECT caseid, i, median(ppg[i]) AS v FROM c, generate_series(1, 64) AS g(i) GROUP BY 1, 2), t AS (SELECT caseid, list(v ORDER BY i) AS t FROM m GROUP BY caseid) SELECT cycle_index, round(abs(list_sum(list_transform(generate_series(1, 64), lambda i: (ppg[i] - list_avg(ppg)) * (t[i] - list_avg(t)))) / 64 / (list_stddev_pop(ppg) * list_stddev_pop(t))), 6) AS likeness FROM c JOIN t ON c.caseid = t.caseid", source=_CYCLES)
def f14_waveform_correlation(c):
    return c.join(select.median_template(c), "caseid").select("cycle_index", recordings.waveform_correlation("ppg", "template").alias("likeness"))


def _range_and_sum(x: np.ndarray) -> np.ndarray:
    """Least and largest value of a signal, and a sum that tells places apart."""
    fine = x[~np.isnan(x)]
    return np.array([*((fine.min(), fine.max()) if len(fine) else (np.nan, np.nan)), (x * (np.arange(len(x)) % 7 + 1)).sum()])


def _waves(spark, sf_dir):
    return fx.wave_source(spark, sf_dir), fx.view(spark, sf_dir, fx.WAVE_NUMERICS_FX)


@query(source=None)
def g1_detect_r_peaks(spark, sf_dir):
    return detect_r_peaks(_waves(spark, sf_dir)[0])


@query(source=None)
def g2_wavelet_filter(spark, sf_dir):
    chunks = _waves(spark, sf_dir)[0]
    rates = joins.rr_stats(joins.rr_intervals(detect_r_peaks(chunks)))
    made = recordings.wavelet_filter(chunks, rates, "ppg", "ppg")
    found = made.select("caseid", "chunk_id", recordings.per_array(_range_and_sum)("ppg").alias("y"))
    return found.select("caseid", "chunk_id", *[F.get("y", F.lit(k)).alias(name) for k, name in enumerate(("least", "most", "total"))])


@query(source=None, digits=4)
def g5_bandpass(spark, sf_dir):
    made = fx.waves(spark, sf_dir).select("caseid", "chunk_id", recordings.bandpass("ppg").alias("y"))
    return made.select("caseid", "chunk_id", F.array_min("y").alias("least"), F.array_max("y").alias("most"))


@query(source=None)
def g6_detect_polarity(spark, sf_dir):
    chunks = _waves(spark, sf_dir)[0]
    return recordings.detect_polarity(chunks, detect_r_peaks(chunks))


@query(source=None)
def g14_energy_r_peaks(spark, sf_dir):
    return fx.waves(spark, sf_dir).select("caseid", "chunk_id", recordings.energy_r_peaks("ecg").alias("peaks")).select("caseid", "chunk_id", F.size("peaks").alias("n_peaks"), F.get("peaks", F.lit(0)).alias("first_peak"))


@query(source=None)
def g15_adaptive_peaks(spark, sf_dir):
    return fx.waves(spark, sf_dir).select("caseid", "chunk_id", recordings.adaptive_peaks("ppg").alias("peaks")).select("caseid", "chunk_id", F.size("peaks").alias("n_peaks"), F.get("peaks", F.lit(0)).alias("first_peak"))


@query(source=None)
def g13_ecg_ppg_lag(spark, sf_dir):
    return recordings.ecg_ppg_lag(fx.waves(spark, sf_dir))


def _raw_cycles(spark, sf_dir):
    """Beats of the recordings, unfiltered, with the known polarity of their case."""
    chunks = _waves(spark, sf_dir)[0]
    spans = joins.cycle_length_filter(joins.rr_intervals(detect_r_peaks(chunks))).select("caseid", "peak_no", "sample_idx", "end_idx")
    cycles = recordings.cut_beats(chunks, spans, "ppg")
    return cycles.select("caseid", F.col("peak_no").alias("cycle_index"), "ppg", (F.col("caseid") % 4 == 3).alias("inverted"))


def _landmarks(columns: tuple[str, ...]):
    def run(spark, sf_dir):
        return rounded(recordings.extract_features(_raw_cycles(spark, sf_dir), features=columns).select("caseid", "cycle_index", *columns, "reason"), 6)

    return run


QUERIES |= {
    "g7_systolic_peak": _landmarks(("pat_to_peak", "crest_time")), "g8_ppg_foot": _landmarks(("ptt_peak_to_foot", "time_to_maxslope_t1")),
    "g9_dicrotic_notch": _landmarks(("systolic_duration_tsd", "diastolic_duration_tfd")), "g10_amplitude_ratio": _landmarks(("amplitude_ratio_ra", "reflection_index")),
    "g12_extract_features": _landmarks(beat_kernels.FEATURES),
}


@query(source=None)
def g16_process_recordings(spark, sf_dir):
    return recordings.process_recordings(*_waves(spark, sf_dir)).drop("stat_power_ratio")


@query(source=None)
def x1_build_beats(spark, sf_dir):
    made = recordings.build_beats(*_waves(spark, sf_dir), fx.view(spark, sf_dir, fx.CASES_FX), ("sex", "department", "approach"), ("age",))
    return made.select("patient_id", "session_id", "cycle_index", "sbp_reference", "dbp_reference", "cycle_correlation", "ptt_peak_to_foot", "ptt_peak_to_peak", "amplitude_ratio_ra", "hr_bpm", "sex", "department", "age")


# ---- streams ------------------------------------------------------------------------------------------------------
# a seventh, as sums of tenths end in fives, which no two engines round alike; days
_STREAM_ALPHA, _STREAM_IDLE = 1 / 7, 1


def _stream_sql(kind: str) -> str:
    """The estimator without a stream: spells between idle days, parts from calibration to calibration, and weights of their readings."""
    def side(t: str) -> str:
        a = _STREAM_ALPHA
        return f"""c{t} AS (SELECT *, {t} IS NOT NULL AND ({kind} = 'calibrate' OR count({t}) OVER (PARTITION BY patient_id, spell ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0) AS cal FROM o),
 g{t} AS (SELECT *, sum(CAST(cal AS INT)) OVER (PARTITION BY patient_id, spell ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM c{t}),
 j{t} AS (SELECT *, count({t}) OVER (PARTITION BY patient_id, spell, part ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS j FROM g{t}),
 e{t} AS (SELECT event_id, CASE WHEN cal OR part = 0 THEN {t} ELSE sum({t} * CASE WHEN cal THEN 1 ELSE {a} END * pow(1 - {a}, 1 - j)) OVER (PARTITION BY patient_id, spell, part ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * pow(1 - {a}, j - CASE WHEN {t} IS NULL THEN 1 ELSE 2 END) END AS {t}_pred FROM j{t})"""

    return f"""WITH r AS ({fx.STREAM_BP_FX}), l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY patient_id ORDER BY ts, event_id) >= INTERVAL {_STREAM_IDLE} DAY AS pause FROM r),
 o AS (SELECT *, sum(CAST(coalesce(pause, false) AS INT)) OVER (PARTITION BY patient_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spell FROM l), {side('sbp')}, {side('dbp')}
SELECT o.patient_id, o.event_id, round(sbp_pred, 4) AS sbp_pred, round(dbp_pred, 4) AS dbp_pred FROM o JOIN esbp ON esbp.event_id = o.event_id JOIN edbp ON edbp.event_id = o.event_id"""


def _replayed(spark, sf_dir, sql):
    readings = replay.arrivals(spark, f"{sf_dir}/events.parquet", sql, "events")
    made = replay.finished(ema_stream(readings, _STREAM_ALPHA, idle=f"{_STREAM_IDLE} days"))
    return made.select("patient_id", "event_id", "sbp_pred", "dbp_pred")


@query(_stream_sql("'measure'"), digits=4, source=None)
def t1_ema_stream(spark, sf_dir):
    return _replayed(spark, sf_dir, f"SELECT patient_id, ts, event_id, 'measure' AS event_kind, sbp, dbp FROM ({fx.STREAM_BP_FX})")


@query(_stream_sql("event_kind"), digits=4, source=None)
def t2_recalibrate(spark, sf_dir):
    return _replayed(spark, sf_dir, fx.STREAM_BP_FX)


def _long(name: str, sql: str, texts: tuple[str, ...] = ()) -> str:
    """A report in long form: its texts as a line, each of its numbers as a row."""
    listed = ", ".join(f'"{t}"' for t in texts)
    line, numbers = (f"concat_ws('|', {listed})", f"COLUMNS(* EXCLUDE ({listed}))") if texts else ("''", "COLUMNS(*)")
    return f"""SELECT '{name}' AS report, line, metric, round(value, 6) AS value FROM (SELECT {line} AS line, CAST({numbers} AS DOUBLE) FROM ({sql})) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE (line))))"""


def _reports(**parts: tuple[str, ...]) -> str:
    """Reports under each other: by their name, the query whose SQL (or the SQL) is the same, and the texts in it."""
    return " UNION ALL ".join(_long(name, ORACLES.get(q, q), tuple(texts)) for name, (q, *texts) in parts.items())


def _of_clean(name: str) -> str:
    """The SQL of a report on the beats that cleaning keeps."""
    return ORACLES[name].replace(B, f"WITH b AS MATERIALIZED (SELECT * FROM ({fx.BEATS_FX}) WHERE ({_RULE}) IS NULL)", 1)


_TYPES = {"int": ("patient_id", "cycle_index"), "string": ("session_id", "sex", "position", "approach", "dx", "opname"), "double": ("timestamp", "sbp_reference", "dbp_reference", "cycle_correlation", "pat_ecg_ppg", "ptt_peak_to_foot", "ptt_peak_to_peak", "amplitude_ratio_ra", "hr_bpm", "max_upslope", "stat_std", "age", "bmi")}
_NULLS = f"{B} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) - count({c}) AS nulls FROM b" for t, names in _TYPES.items() for c in names)
_PAIRS = f"{B}, f AS (SELECT * FROM b WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, {_r(a, c)} AS r FROM f" for a, c in combinations(FEATURES, 2))
_PROFILE = dict(ranges=("a39_feature_ranges", "feature"), outliers=("a38_sigma_outliers", "column"), categories=("a34_category_stats", "column", "value"), patients=("a10_samples_per_patient",))


# ---- composed jobs ------------------------------------------------------------------------------------------------
def _published(name: str, rows: str) -> str:
    return f"""SELECT '{name}' AS dataset, count(*) AS n, round(sum(z * z), 4) AS z2, round(avg(d), 5) AS sbp_delta FROM (
 SELECT (ptt_peak_to_foot - avg(ptt_peak_to_foot) OVER w) / (stddev_samp(ptt_peak_to_foot) OVER w + 1e-6) AS z, sbp_reference - m AS d FROM {rows} r
 JOIN (SELECT patient_id AS p, median(sbp_reference) AS m FROM (SELECT patient_id, sbp_reference, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp, cycle_index) AS k FROM {rows}) WHERE k <= 100 GROUP BY 1) h ON h.p = r.patient_id WINDOW w AS (PARTITION BY patient_id))"""


@query(f"""{B}, p AS MATERIALIZED (SELECT * FROM b WHERE {_P9}), {_a6('p', False).replace('m AS', 'm1 AS').replace('FROM m)', 'FROM m1)').replace(' v AS', ' v1 AS')}, {_a6('p', True)},
 vv AS MATERIALIZED (SELECT * FROM p WHERE patient_id IN (SELECT patient_id FROM v1 WHERE reason = '')), ss AS MATERIALIZED (SELECT * FROM p WHERE patient_id IN (SELECT patient_id FROM v WHERE reason = ''))
{_published('full', 'b')} UNION ALL {_published('validated', 'vv')} UNION ALL {_published('strict', 'ss')}""", digits=5)
def x2_publish_datasets(b):
    made = jobs.publish_datasets(b, FEATURES[:4])
    one = lambda n: made[n].agg(F.lit(n).alias("dataset"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("ptt_peak_to_foot_norm") * F.col("ptt_peak_to_foot_norm")), 4).alias("z2"), F.avg("sbp_delta").alias("sbp_delta"))
    return one("full").union(one("validated")).union(one("strict"))


@query(f"""{B}, p AS MATERIALIZED (SELECT * FROM b WHERE {_P9}), {_a6('p', True)}, s AS MATERIALIZED (SELECT * FROM p WHERE patient_id IN (SELECT patient_id FROM v WHERE reason = '')),
 h AS (SELECT patient_id AS pid, median(sbp_reference) AS m FROM (SELECT patient_id, sbp_reference, row_number() OVER (PARTITION BY patient_id ORDER BY timestamp, cycle_index) AS k FROM s) WHERE k <= 100 GROUP BY 1),
 n AS MATERIALIZED (SELECT sbp_reference, dbp_reference, sbp_reference - m AS sbp_delta, {', '.join(f'({c} - avg({c}) OVER w) / (stddev_samp({c}) OVER w + 1e-6) AS {c}_norm' for c in FEATURES[:4])} FROM s JOIN h ON pid = patient_id WINDOW w AS (PARTITION BY patient_id)),
 f AS ({' UNION ALL '.join(f"SELECT '{c}_norm' AS feature, {_r(c + '_norm', 'sbp_reference')} AS r_sbp, {_r(c + '_norm', 'dbp_reference')} AS r_dbp, {_r(c + '_norm', 'sbp_delta')} AS r_sbp_delta FROM n" for c in FEATURES[:4])})
SELECT *, CASE WHEN abs(r_sbp) > 0.3 THEN 'strong' WHEN abs(r_sbp) > 0.1 THEN 'moderate' ELSE 'weak' END AS strength FROM f""")
def x2_published_correlations(b):
    return jobs.publish_datasets(b, FEATURES[:4])["correlations"]


@query(_reports(before=("a3_quality_report",), after=(_of_clean("a3_quality_report"),), changes=("j8_compare_reports",), removed=("p7_cleaning_stats", "rule"), verdict=(_of_clean("a43_validation_verdict"), "warnings", "errors")))
def x3_clean_and_report(b):
    made = jobs.clean_and_report(b)
    return jobs.long_form({n: made[n] for n in ("before", "after", "changes", "removed", "verdict")})


@query(_reports(nulls=(_NULLS, "column", "type"), time=("w7_temporal_integrity", "session_id"), sessions=("a41_session_duration",), **_PROFILE))
def x4_profile_dataset(b):
    made = jobs.profile_dataset(b, _RANGES, ["dx", "sex", "position"])
    return jobs.long_form(made)


@query(_reports(
    percentiles=("a37_target_percentiles", "column"), category_profile=("a34_category_profile", "column"), top_patients=("a11_top_patient_share",), correlations=(_PAIRS, "a", "b"), redundant=(f"SELECT * FROM ({_PAIRS}) WHERE abs(r) > 0.9", "a", "b"),
    related=("a14_feature_bp_correlation", "feature", "strength"), autocorrelation=("w8_autocorrelation",), variance=("a20_variance_decomposition",), issues=("a44_diagnostic_issues", "issues"), **_PROFILE))
def x5_forensic_report(b):
    return jobs.long_form(jobs.forensic_report(b, FEATURES, _RANGES, ["dx", "sex", "position"]))


@query(_reports(
    patients=("a10_samples_per_patient",), autocorrelation=("w8_autocorrelation",), effective=("a24_effective_sample_size",), variance=("a20_variance_decomposition",), within=("a19_global_vs_within_corr", "feature"),
    quarters=("w9_quarter_correlation",), slopes=("a21_slope_summary",), limits=("a23_theoretical_limits",), norm=("a25_norm_check", "feature")))
def x6_dataset_limits(b):
    return jobs.long_form(jobs.dataset_limits(b, FEATURES[:4]))


@query(f"""{B}, {_SPLIT}, t AS (SELECT opname FROM (SELECT coalesce(opname, 'Unknown') AS opname FROM b) GROUP BY opname ORDER BY count(*) DESC, opname LIMIT 50), r AS (SELECT b.patient_id, timestamp, cycle_index, CASE WHEN t.opname IS NULL THEN 'Other' ELSE t.opname END AS opname FROM b LEFT JOIN t ON coalesce(b.opname, 'Unknown') = t.opname),
 d AS (SELECT opname, CAST(dense_rank() OVER (ORDER BY opname) - 1 AS INT) AS code FROM (SELECT DISTINCT opname FROM r)), k AS (SELECT r.patient_id, code, row_number() OVER (PARTITION BY r.patient_id ORDER BY timestamp, cycle_index) AS k, count(*) OVER (PARTITION BY r.patient_id) AS n FROM r JOIN d ON r.opname = d.opname)
SELECT part, count(*) AS n, CAST(sum(code) AS BIGINT) AS codes FROM k JOIN sp ON k.patient_id = sp.patient_id WHERE k >= 30 AND n > 30 GROUP BY part""")
def x7_training_set(b):
    made = jobs.training_set(b, FEATURES[:4], ["age", "bmi"], {"sex": None, "opname": 50})
    return made.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("static_cat")[1]).alias("codes"))


@query(ORACLES["a48_alpha_sweep"], digits=5)
def x8_ema_evaluation(b):
    return jobs.ema_evaluation(b)
