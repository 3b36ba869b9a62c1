"""Correlations, variance, bands and histograms of the beat table. Each job is one aggregation, or a few stages of one."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import masked_corr, percent, ptt_column, safe_corr
from .moments import correlation, merged, pair_correlations, record, shifted, single, variance
from .ordered import BLOCK, SPAN, blocks, in_block, ranked
from .quantiles import quantiles, summarised, wide_quantiles

ORDER = ("timestamp", "cycle_index")
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def samples_per_patient(df: DataFrame, short: int = 30) -> DataFrame:
    n = df.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("n", F.array(*[F.lit(x) for x in QUANTILES]))
    return n.agg(F.count(F.lit(1)).alias("n_patients"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), q.alias("q"), F.count_if(F.col("n") < short).alias("n_short")).select(
        "n_patients", "mean", "std", "least", "most", "n_short", *[F.col("q")[k].alias(f"q{int(100 * x)}") for k, x in enumerate(QUANTILES)])


def top_patient_share(df: DataFrame, k: int = 10) -> DataFrame:
    n = df.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), "patient_id").limit(k).agg(F.sum("n").alias("top_rows"))
    return top.join(F.broadcast(n.agg(F.sum("n").alias("rows"))), F.lit(True)).select("top_rows", "rows", (100.0 * F.col("top_rows") / F.col("rows")).alias("share"))


def top_patients(df: DataFrame, k: int = 10) -> DataFrame:
    return df.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "patient_id").limit(k)


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each pair of columns, over the rows where both are there: one scan."""
    pairs = list(combinations(columns, 2))
    named = F.get(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]), F.col("pair"))
    return pair_correlations(df, pairs).select(named["a"].alias("a"), named["b"].alias("b"), "r")


def complete_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each pair of columns, over the rows where all of them are there."""
    return correlation_pairs(df.select(*columns).na.drop("any"), columns)


#: Where transit times and rates count for the global correlations with the pressure.
VALID = {"ptt_peak_to_peak": (0, 500), "pat_ecg_ppg": (0, 600), "hr_bpm": (30, 200)}


def masked_correlations(df: DataFrame, target: str = "sbp_reference", more_than: int = 100) -> DataFrame:
    """(feature, n, r): correlation with the pressure over the valid rows of each feature; NULL up to `more_than` rows."""
    aggs = []
    for f, (lo, hi) in VALID.items():
        ok = (F.col(f) > lo) & (F.col(f) < hi)
        aggs.append(F.struct(F.lit(f).alias("feature"), F.count_if(ok & F.col(target).isNotNull()).alias("n"), masked_corr(f, target, ok, more_than).alias("r")).alias(f))
    return df.agg(*aggs).select(F.inline(F.array(*VALID)))


def feature_bp_correlation(df: DataFrame, features: list[str], targets: tuple[str, ...] = ("sbp_reference", "dbp_reference")) -> DataFrame:
    """r of each feature with each target (`r_sbp` for sbp_reference, and so on), with a label by the first."""
    short = {t: "r_" + t.removesuffix("_reference") for t in targets}
    pairs = [(f, t) for f in features for t in targets]
    at = lambda k: F.max(F.when(F.col("pair") % len(targets) == k, F.col("r")))
    found = pair_correlations(df, pairs).groupBy(F.floor(F.col("pair") / len(targets)).cast("int").alias("__f")).agg(*[at(k).alias(n) for k, n in enumerate(short.values())])
    one = found.select(F.get(F.array(*[F.lit(f) for f in features]), F.col("__f")).alias("feature"), *short.values())
    strong = F.abs(next(iter(short.values())))
    return one.withColumn("strength", F.when(strong > 0.3, "strong").when(strong > 0.1, "moderate").otherwise("weak"))


def global_vs_within(df: DataFrame, features: list[str], target: str = "sbp_reference", more_than: int = 30) -> DataFrame:
    """Global r, mean and population spread of the patients' r, whether the sign flips, and r and r2 of patient-centred
    values. One aggregation by patient; what spans patients is merged from its records."""
    long = df.select("patient_id", target, *features).unpivot(["patient_id", target], features, "feature", "x")
    one = long.groupBy("feature", "patient_id").agg(F.count(F.lit(1)).alias("rows"), F.avg("x").alias("mx"), F.avg(target).alias("my"), record("x", target).alias("plain"))
    r = F.when(F.col("rows") > more_than, correlation(F.col("plain")))
    each = one.select("feature", "patient_id", "plain", shifted(F.col("plain"), F.col("mx"), F.col("my")).alias("centred"), single(r).alias("r"))
    whole = merged(each, ["feature"], ["plain", "centred", "r"])
    found = whole.select("feature", correlation(F.col("plain")).alias("global_r"), correlation(F.col("centred")).alias("centred_r"), F.when(F.col("r.n") > 0, F.col("r.mx")).alias("within_mean"), F.sqrt(variance(F.col("r"), 0)).alias("within_std"))
    return found.withColumns({"sign_flip": F.signum("global_r") != F.signum("within_mean"), "centred_r2": F.col("centred_r") * F.col("centred_r")})


def variance_decomposition(df: DataFrame, column: str) -> DataFrame:
    """Sample variance in all, between patients' means and, on average, within patients: one pass over the rows."""
    each = df.groupBy("patient_id").agg(record(column, column).alias("all"))
    whole = merged(each.withColumns({"means": single(F.col("all.mx")), "inside": single(variance(F.col("all"), 1))}), [], ["all", "means", "inside"])
    return whole.select(variance(F.col("all"), 1).alias("total"), variance(F.col("means"), 1).alias("between"), F.when(F.col("inside.n") > 0, F.col("inside.mx")).alias("within")).select(
        "total", "between", "within", (100 * F.col("between") / F.col("total")).alias("between_pct"), (100 * F.col("within") / F.col("total")).alias("within_pct"), F.try_divide("between", "within").alias("ratio"))


def patient_slopes(df: DataFrame, x: str, y: str = "sbp_reference", at_least: int = 50) -> DataFrame:
    """Regression of y on each patient's standardised x. One pass: the slope is the plain slope times the scale."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = both.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("plain"), F.regr_r2(y, x).alias("r2"), F.avg(y).alias("intercept"), F.stddev_pop(x).alias("s"))
    return fit.where(F.col("n") >= at_least).select("patient_id", "n", (F.col("plain") * (F.col("s") + 1e-7)).alias("slope"), "intercept", "r2")


def slope_summary(slopes: DataFrame) -> DataFrame:
    return slopes.agg(
        F.count("slope").alias("n_patients"), F.avg("slope").alias("mean"), F.stddev_pop("slope").alias("std"), F.min("slope").alias("least"), F.max("slope").alias("most"),
        F.try_divide(F.stddev_pop("slope"), F.abs(F.avg("slope"))).alias("cv"), F.avg("r2").alias("r2_mean"), F.median("r2").alias("r2_median"))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    valid = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) > 0))
    return valid.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def theoretical_limits(df: DataFrame, column: str = "sbp_reference", wanted: float = 8.0) -> DataFrame:
    """The r2 that the wanted error needs, and the error that a feature of r = 0.24 allows, of patient-centred values."""
    each = df.groupBy("patient_id").agg(record(column, column).alias("m"))  # centred values have the mean 0 in each patient
    n, squares = F.sum("m.n"), F.sum("m.cxx")
    dev = each.agg(F.when(n > 1, F.sqrt(squares / (n - 1))).alias("std_dev"))
    return dev.withColumn("required_r2", 1 - F.pow(F.lit(wanted) / F.col("std_dev"), 2)).withColumn("achievable_std", F.col("std_dev") * F.sqrt(F.lit(1 - min(0.24**2 * 2.5, 0.15))))


def autocorrelation(df: DataFrame, column: str = "sbp_reference", lags: tuple[int, ...] = (1, 5, 10, 20, 50, 100), span: float = SPAN, block: int = BLOCK) -> DataFrame:
    """Mean over patients of the correlation of a column with itself `lag` rows on. Blocks of rows with the rows that the
    longest lag looks back to; their sums are merged by patient."""
    order = in_block("patient_id")
    rows = blocks(ranked(df.select("patient_id", *ORDER, column), "patient_id", ORDER, span), max(lags), max(block, max(lags)))
    wide = rows.select("patient_id", column, "n", "own", *[F.lag(column, k).over(order).alias(f"l{k}") for k in lags]).where("own")
    each = wide.groupBy("patient_id").agg(F.max("n").alias("n"), *[safe_corr(column, f"l{k}").alias(f"r{k}") for k in lags])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("n") > k + 10, F.col(f"r{k}")).alias("r")) for k in lags])
    return each.select(F.inline(rows)).groupBy("lag").agg(F.avg("r").alias("autocorr"), F.count("r").alias("n_patients"))


def effective_sample_size(df: DataFrame, r: float = 0.94, skips: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    each = F.explode(F.array(*[F.lit(s) for s in skips])).alias("skip")
    rows = df.agg(F.count(F.lit(1)).alias("n")).select("n", each).withColumn("r_skip", F.pow(F.lit(r), F.col("skip"))).withColumn("n_skip", F.floor(F.col("n") / F.col("skip")))
    return rows.withColumn("effective", F.col("n_skip") * (1 - F.col("r_skip")) / (1 + F.col("r_skip")))


def quarter_correlation(df: DataFrame, at_least: int = 200, span: float = SPAN) -> DataFrame:
    """r of transit time and pressure in the quarters of each patient's rows."""
    rows = ranked(df.select("patient_id", *ORDER, F.col(ptt_column(df)).alias("x"), "sbp_reference"), "patient_id", ORDER, span).where(F.col("n") >= at_least)
    q = F.when(F.col("k") < F.floor(F.col("n") / 4), 1).when(F.col("k") < F.floor(F.col("n") / 2), 2).when(F.col("k") < F.floor(3 * F.col("n") / 4), 3).otherwise(4)
    r = [safe_corr(F.when(q == i, F.col("x")), "sbp_reference").alias(f"q{i}") for i in range(1, 5)]
    flips = sum((F.when(F.signum(f"q{i}") != F.signum(f"q{i + 1}"), 1).otherwise(0) for i in range(1, 4)), F.lit(0))
    return rows.groupBy("patient_id").agg(*r).select("patient_id", "q1", "q2", "q3", "q4", (F.greatest("q1", "q2", "q3", "q4") - F.least("q1", "q2", "q3", "q4")).alias("range"), flips.alias("sign_changes"))


def rolling_correlation(df: DataFrame, span: float = SPAN) -> DataFrame:
    """r in windows of a quarter of a patient's rows, half a window apart."""
    rows = ranked(df.select("patient_id", *ORDER, F.col(ptt_column(df)).alias("x"), "sbp_reference"), "patient_id", ORDER, span)
    rows = rows.withColumn("size", F.floor(F.col("n") / 4)).withColumn("step", F.floor(F.col("size") / 2)).where("step > 0")
    last, first = F.floor(F.col("k") / F.col("step")), F.greatest(F.lit(0), F.floor((F.col("k") - F.col("size")) / F.col("step")) + 1)
    each = rows.withColumn("w", F.explode(F.sequence(first, last))).where("w * step + size <= n")
    return each.groupBy("patient_id", "w").agg(safe_corr("x", "sbp_reference").alias("r"), F.max(100.0 * F.col("w") * F.col("step") / F.col("n")).alias("position"))


def boundary_clusters(df: DataFrame, column: str, bounds: tuple[float, ...], width: float) -> DataFrame:
    """Rows around each of a few values; the bands may overlap."""
    one = df.agg(F.count(column).alias("n"), *[F.count_if(F.col(column).between(b - width, b + width)).alias(f"c{k}") for k, b in enumerate(bounds)])
    rows = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"c{k}").alias("near"), (100.0 * F.col(f"c{k}") / F.col("n")).alias("share")) for k, b in enumerate(bounds)])
    return one.select(F.inline(rows))


def band(column: str, edges: list[float]) -> Column:
    """The lower edge of the half-open band that a value lies in; NULL outside."""
    out = F.lit(None).cast("double")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        out = F.when((F.col(column) >= lo) & (F.col(column) < hi), F.lit(float(lo))).otherwise(out)
    return out


def range_distribution(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    return df.groupBy(band(column, edges).alias("lower")).agg(F.count(F.lit(1)).alias("n")).where("lower IS NOT NULL")


def corr_by_range(df: DataFrame, column: str, edges: list[float], more_than: int = 50) -> DataFrame:
    return df.groupBy(band(column, edges).alias("lower")).agg(F.count(F.lit(1)).alias("n"), safe_corr(column, "sbp_reference").alias("r")).where((F.col("n") > more_than) & F.col("lower").isNotNull())


def patient_boundary_share(df: DataFrame, at_least: int = 50) -> DataFrame:
    ptt = ptt_column(df)
    near = lambda b: F.avg(F.coalesce(F.col(ptt).between(b - 1, b + 1), F.lit(False)).cast("double"))
    return df.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), near(80).alias("near_80"), near(40).alias("near_40"), safe_corr(ptt, "sbp_reference").alias("r"), F.avg(ptt).alias("mean_ptt")).where(F.col("n") >= at_least)


def patients_by_sign(df: DataFrame, at_least: int = 100, first: int = 10) -> DataFrame:
    """The first patients of those with a positive and of those with a clearly negative relation, least r first."""
    shares = patient_boundary_share(df, at_least)
    sign = F.when(F.col("r") > 0, "positive").when(F.col("r") < -0.1, "negative")
    placed = shares.withColumn("sign", sign).where("sign IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("sign").orderBy("r", "patient_id")))
    return placed.where(F.col("place") <= first).select("sign", "place", "patient_id", "n", "r", "mean_ptt", "near_80")


def common_values(df: DataFrame, column: str, digits: int = 3, k: int = 20) -> DataFrame:
    return df.groupBy(F.bround(column, digits).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value IS NOT NULL").orderBy(F.desc("n"), "value").limit(k)


def column_agreement(df: DataFrame, a: str, b: str, values: tuple[float, ...] = (24.0, 26.0)) -> DataFrame:
    """How far two columns are apart, the spread of the first, and how often it is exactly one of a few values."""
    gap = F.abs(F.col(a) - F.col(b))
    plain = [F.max(gap).alias("largest"), F.count_if(gap > 1).alias("n_apart"), F.avg(a).alias("mean"), F.min(a).alias("least"), F.max(a).alias("most"), *[F.count_if(F.col(a) == v).alias(f"at_{v:g}") for v in values]]
    return wide_quantiles(df, a, {"median": 0.5}, plain)


def fallback_share(df: DataFrame, column: str = "amplitude_ratio_ra", value: float = 0.5) -> DataFrame:
    return df.groupBy("patient_id").agg(F.avg((F.col(column) == value).cast("double")).alias("share"), F.avg(column).alias("mean"), F.count_if(F.col(column) != value).alias("n_other"))


def fallback_rest(df: DataFrame, column: str = "amplitude_ratio_ra", value: float = 0.5) -> DataFrame:
    """Rows that are not at the fallback value against all rows: count, share, mean and median, pressure and rate."""
    rest = F.col(column) != value
    means = [F.avg(F.when(rest, F.col(c))).alias(n) for n, c in (("mean", column), ("sbp_rest", "sbp_reference"), ("hr_rest", "hr_bpm"))]
    plain = [F.count_if(rest).alias("n_rest"), percent(rest).alias("rest_pct"), *means, F.avg("sbp_reference").alias("sbp_all"), F.avg("hr_bpm").alias("hr_all")]
    return wide_quantiles(df.withColumn("__rest", F.when(rest, F.col(column))), "__rest", {"median": 0.5}, plain)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal bins from the least to the largest value; the last one is closed."""
    lim = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    k = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))))
    return df.where(F.col(column).isNotNull()).join(F.broadcast(lim), F.lit(True)).groupBy(k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Texts that stand for a missing category; distinct values from which a column counts as wide.
UNKNOWN, WIDE = ("nan", "unknown", ""), 20


def _categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, pressures and rank of each value of each column; one aggregation for all columns."""
    long = df.select("sbp_reference", "dbp_reference", *columns).unpivot(["sbp_reference", "dbp_reference"], columns, "column", "value")
    return long.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg("sbp_reference").alias("sbp_mean"), F.stddev_samp("sbp_reference").alias("sbp_std"), F.count("sbp_reference").alias("sbp_n"),
        F.avg("dbp_reference").alias("dbp_mean"), F.stddev_samp("dbp_reference").alias("dbp_std"), F.count("dbp_reference").alias("dbp_n"))


def category_stats(df: DataFrame, columns: list[str], k: int = 10, more_than: int = 50) -> DataFrame:
    """The most frequent values of each column; with pressures for those of more than `more_than` rows."""
    top = _categories(df, columns).withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    enough = F.col("n") > more_than
    return top.select("column", "value", "n", "rank", *[F.when(enough, F.col(c)).alias(c) for c in ("sbp_mean", "sbp_std", "sbp_n", "dbp_mean", "dbp_std", "dbp_n")])


def category_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: distinct values, whether these are many, and the share of rows that are missing or unknown."""
    unknown = F.col("value").isNull() | F.lower("value").isin(*UNKNOWN)
    each = _categories(df, columns).groupBy("column").agg(F.count("value").alias("n_values"), F.sum("n").alias("n"), F.sum(F.when(unknown, F.col("n")).otherwise(0)).alias("n_unknown"))
    return each.select("column", "n_values", (F.col("n_values") > WIDE).alias("wide"), "n_unknown", (100.0 * F.col("n_unknown") / F.col("n")).alias("unknown_pct"))


def anova_oneway(df: DataFrame, column: str, target: str = "sbp_reference", more_than: int = 50) -> DataFrame:
    """F of a one-way analysis of variance over the categories with enough rows, its p-value and whether it is below 0.05."""
    each = df.where(F.col(target).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("m"), F.var_samp(target).alias("v")).where((F.col("n") > more_than) & F.col(column).isNotNull())
    sums = each.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("m")).alias("s"))
    ssb = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    f = sums.select("k", "n", F.try_divide(F.try_divide(ssb, F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))).alias("f"))
    # one row: a small helper where there is no built-in function
    return f.withColumn("p", F.pandas_udf(_f_tails, "double")(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"))).withColumn("significant", F.col("p") < 0.05)


def _f_tails(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or not (a > 0 and b > 0) else f_tail(x, a, b) for x, a, b in zip(f, d1, d2)], dtype="float64")


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(X > f) for an F variable: the regularised incomplete beta function at d2 / (d2 + d1 f)."""
    if f <= 0:
        return 1.0
    a, b, x = d2 / 2, d1 / 2, d2 / (d2 + d1 * f)
    if x > (a + 1) / (a + b + 2):  # the fraction settles faster from the other side
        return 1.0 - _beta_share(b, a, 1 - x)
    return _beta_share(a, b, x)


def _beta_share(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction, evaluated from the front (modified Lentz)."""
    if x <= 0:
        return 0.0
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 5000):
        step = 1.0
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            step *= c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return min(1.0, math.exp(front) * h / a)


def box_stats(df: DataFrame, column: str, target: str, top: int = 10, more_than: int = 50) -> DataFrame:
    """Extremes and exact quartiles of a target by category: of those with enough rows, or the `top` ones if these are more."""
    seen = df.where(F.col(column).isNotNull())
    counts = seen.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    first = counts.orderBy(F.desc("__n"), column).limit(top + 1)  # the window below sees no more than these
    ranked = first.withColumn("__rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__n"), column)))
    several = ranked.where((F.col("__rank") == top + 1) & (F.col("__n") > more_than)).agg((F.count(F.lit(1)) > 0).alias("__many"))
    chosen = ranked.where(F.col("__rank") <= top).join(F.broadcast(several), F.lit(True)).where(F.col("__many") | (F.col("__n") > more_than)).select(column)
    rows = seen.join(F.broadcast(chosen), column, "left_semi").where(F.col(target).isNotNull())  # `top` rows at most
    made = summarised(rows, column, target, (0.25, 0.5, 0.75), [F.min(target).alias("least"), F.max(target).alias("most")])
    return made.select(column, "least", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "most")


def target_percentiles(df: DataFrame, columns: tuple[str, ...] = ("sbp_reference", "dbp_reference"), at: tuple[float, ...] = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    return quantiles(df.select(*columns).unpivot([], list(columns), "column", "x"), "column", "x", at)
