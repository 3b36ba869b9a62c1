"""Jobs composed of operators. Each gives its results by name. Before one of them is read or written nothing runs but
what a job writes as a stage, as several of its results read it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ptt_column
from ..operators import cleaning, evaluate, modelprep, normalize, physiology, quality, stats
from ..sources.stages import Stages
from ..waves.recordings import build_beats as build_beats  # the job from recordings to beats


def normalised(beats: DataFrame, columns: list[str], deltas: dict[str, str]) -> DataFrame:
    """Per-patient z-scores, and distances from each patient's first rows."""
    return normalize.baseline_delta(normalize.patient_zscore(beats, columns), deltas)


def publish_datasets(beats: DataFrame, columns: list[str], deltas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The full, validated and strict tables, each normalised on its own rows, the patients' metrics, and correlations of
    the normalised features with the pressures and the change of pressure on the strict table.

    Statistics are taken after filtering: a patient's mean is that of the rows that are published.
    """
    deltas = deltas or {"sbp_reference": "sbp_delta", "dbp_reference": "dbp_delta", ptt_column(beats): "ptt_delta"}
    rows = physiology.boundary_filter(beats)
    valid, metrics = physiology.filter_valid_patients(rows, strict=False, remove_boundary=False)
    strict, _ = physiology.filter_valid_patients(rows, strict=True, remove_boundary=False)
    tables = {name: normalised(df, columns, deltas) for name, df in (("full", beats), ("validated", valid), ("strict", strict))}
    return tables | {"metrics": metrics, "correlations": stats.feature_bp_correlation(tables["strict"], [f"{c}_norm" for c in columns], targets=("sbp_reference", "dbp_reference", "sbp_delta"))}


def clean_and_report(beats: DataFrame, stages: Stages | None = None) -> dict[str, DataFrame]:
    """All reports read one written table: the columns they need, and the rule that a row fails; so `beats` is made once for
    them. A report that others are compared with is made once too."""
    stages = stages or Stages(beats.sparkSession)
    needed = [c for c in beats.columns if c in quality.REPORTED]
    judged = stages.table("judged", lambda: cleaning.first_failed_rule(beats).select(*needed, "first_failed_rule"))
    kept = judged.where("first_failed_rule IS NULL").drop("first_failed_rule")
    before, after = (stages.table(f"report_{name}", lambda df=df: quality.quality_report(df)) for name, df in (("before", judged), ("after", kept)))
    return {"clean": cleaning.clean_samples(beats), "before": before, "after": after, "changes": quality.compare_reports(before, after), "removed": cleaning.removed_by_rule(judged), "verdict": quality.validation_verdict(kept)}


def profile_dataset(beats: DataFrame, ranges: dict[str, tuple[float, float]], categories: list[str], stages: Stages | None = None) -> dict[str, DataFrame]:
    """Missing values are counted on all columns of `beats`; the other reports read one written table of those they need."""
    stages = stages or Stages(beats.sparkSession)
    needed = {"patient_id", "session_id", "timestamp", "cycle_index", *quality.PRESSURE_LIMITS, *ranges, *categories}
    rows = stages.table("profiled", lambda: beats.select(*[c for c in beats.columns if c in needed]))
    return {
        "nulls": quality.null_profile(beats), "time": quality.temporal_integrity(rows), "outliers": quality.sigma_outliers(rows), "ranges": quality.feature_ranges(rows, ranges),
        "categories": stats.category_stats(rows, categories), "patients": stats.samples_per_patient(rows), "sessions": quality.session_duration(rows)}


def forensic_report(beats: DataFrame, features: list[str], ranges: dict[str, tuple[float, float]], categories: list[str]) -> dict[str, DataFrame]:
    """Everything that tells whether a table can teach the pressure: targets, features, categories, patients, relations, issues."""
    pairs = stats.complete_correlations(beats, features)
    return {
        "outliers": quality.sigma_outliers(beats), "percentiles": stats.target_percentiles(beats), "ranges": quality.feature_ranges(beats, ranges),
        "categories": stats.category_stats(beats, categories), "category_profile": stats.category_profile(beats, categories),
        "patients": stats.samples_per_patient(beats), "top_patients": stats.top_patient_share(beats), "correlations": pairs,
        "related": stats.feature_bp_correlation(beats, features), "redundant": pairs.where(F.abs("r") > 0.9),
        "autocorrelation": stats.autocorrelation(beats), "variance": stats.variance_decomposition(beats, "sbp_reference"), "issues": quality.diagnostic_issues(beats, features)}


def dataset_limits(beats: DataFrame, features: list[str]) -> dict[str, DataFrame]:
    """What a table's structure allows a model: rows, dependence of neighbours, variance, relations in and between patients, drift, normalisation."""
    return {
        "patients": stats.samples_per_patient(beats), "autocorrelation": stats.autocorrelation(beats), "effective": stats.effective_sample_size(beats),
        "variance": stats.variance_decomposition(beats, "sbp_reference"), "within": stats.global_vs_within(beats, features), "quarters": stats.quarter_correlation(beats),
        "slopes": stats.slope_summary(stats.patient_slopes(beats, features[0])), "limits": stats.theoretical_limits(beats),
        "norm": normalize.norm_check(normalize.patient_zscore(beats, features), [f"{c}_norm" for c in features])}


def training_set(beats: DataFrame, dynamic: list[str], numbers: list[str] = [], categories: dict[str, int | None] = {}, targets: tuple[str, ...] = ("sbp_reference", "dbp_reference"), size: int = 30, stages: Stages | None = None) -> DataFrame:
    """Sequences of scaled features, with static numbers and category codes, and the part that their patient belongs to.

    Missing static values are filled from all rows, rare categories (beyond the given number of them) become 'Other',
    categories become codes, patients are split, and all numbers are scaled by the training rows.
    """
    stages = stages or Stages(beats.sparkSession)  # dictionaries and the split are written, as the rows are used twice
    rows = modelprep.fill_static(beats, numbers, list(categories)) if numbers or categories else beats
    for c, k in categories.items():
        codes = stages.table(f"codes_{c}", lambda: modelprep.category_codes(beats, c, k)).withColumnsRenamed({"value": f"__{c}", "code": f"{c}_code"})
        rows = rows.join(codes, F.col(c) == F.col(f"__{c}")).drop(f"__{c}")
    split = stages.table("split", lambda: modelprep.patient_split(beats))
    scaled = modelprep.fit_transform_scaler(rows, split, [*dict.fromkeys([*dynamic, *numbers, *targets])])
    made = modelprep.sliding_sequences(scaled, dynamic, list(targets), size, numbers, [f"{c}_code" for c in categories])
    return made.join(split, "patient_id")


def ema_evaluation(beats: DataFrame) -> DataFrame:
    return evaluate.alpha_sweep(beats)


def long_form(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports under each other: report, line (all texts of a row), metric and value."""
    def one(name: str, df: DataFrame) -> DataFrame:
        numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "boolean") or t.startswith("decimal")]
        texts = [c for c in df.columns if c not in numeric]
        line = F.concat_ws("|", *[F.col(c).cast("string") for c in texts]) if texts else F.lit("")
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric]))
        return df.select(F.lit(name).alias("report"), line.alias("line"), each.alias("m")).select("report", "line", "m.metric", "m.value")

    return reduce(DataFrame.union, [one(n, df) for n, df in reports.items()])
