"""Joins of beats, peaks, numerics and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import slot

FS = 500


def suitable_cases(tracks: DataFrame, wanted: tuple[str, ...] = ("ECG_II", "PLETH", "ART")) -> DataFrame:
    """Cases that have all wanted tracks."""
    return tracks.where(F.col("track").isin(*wanted)).groupBy("caseid").agg(F.count_distinct("track").alias("n")).where(F.col("n") == len(wanted)).select("caseid")


def case_duration(cases: DataFrame, least: float = 30) -> DataFrame:
    return cases.withColumn("duration_min", (F.col("caseend") - F.col("casestart")) / 60).where(F.col("duration_min") >= least)


def keep_listed_cases(cases: DataFrame, listed: DataFrame) -> DataFrame:
    """Cases that are in a list of ids."""
    return cases.join(listed.select("caseid"), "caseid", "left_semi")


def first_cases(cases: DataFrame, k: int) -> DataFrame:
    """The first k cases (recordings) in the order of their ids."""
    return cases.select("caseid").distinct().orderBy("caseid").limit(k)


def pending_cases(cases: DataFrame, done: DataFrame) -> DataFrame:
    return cases.join(done.select("caseid"), "caseid", "left_anti")


def rr_intervals(peaks: DataFrame, fs: int = FS) -> DataFrame:
    """Each beat from its peak to the next: length in ms and heart rate; the open last beat has none."""
    order = Window.partitionBy("caseid").orderBy("sample_idx")
    return peaks.withColumn("end_idx", F.lead("sample_idx").over(order)).where("end_idx IS NOT NULL").withColumn("len_ms", (F.col("end_idx") - F.col("sample_idx")) * 1000.0 / fs).withColumn("hr", F.try_divide(F.lit(60000.0), F.col("len_ms")))


# Lengths in ms that a beat can have.
CYCLE_MS = (300, 1500)


def cycle_length_filter(beats: DataFrame, lo: float = CYCLE_MS[0], hi: float = CYCLE_MS[1]) -> DataFrame:
    return beats.where(F.col("len_ms").between(lo, hi))


def rr_stats(beats: DataFrame, least: int = 10) -> DataFrame:
    """Per case: mean and population spread of the intervals, quality, and the mean rate held to 40 to 180."""
    rr = beats.groupBy("caseid").agg(F.count(F.lit(1)).alias("n"), F.avg("len_ms").alias("rr_mean"), F.stddev_pop("len_ms").alias("rr_std"), F.greatest(F.lit(40.0), F.least(F.lit(180.0), F.avg("hr"))).alias("hr"))
    return rr.where(F.col("n") + 1 >= least).withColumn("quality", F.greatest(F.lit(0.0), 1 - F.try_divide("rr_std", "rr_mean")))


def nearest_bp(peaks: DataFrame, numerics: DataFrame, fs: int = FS, every: float = 2.0, how: str = "inner") -> DataFrame:
    """Each peak with the numeric nearest in time: on a regular grid, an equi-join on the half-even grid number."""
    at = peaks.withColumn("bp_idx", F.bround(F.col("sample_idx") / fs / every, 0).cast("int"))
    return at.join(numerics, ["caseid", "bp_idx"], how)


def nearest_bp_irregular(peaks: DataFrame, numerics: DataFrame, width: float = 600.0) -> DataFrame:
    """The same for numerics at any times (caseid, t, sbp): the last one before and the first one after, and the nearer of
    both (the earlier, if they are equally near).

    Both sides are dealt by stretches of time, and ordered inside them only. The last and first value of each stretch
    are carried over to those that have none, on a table of a row for each stretch.
    """
    key = ["caseid", "slot"]
    timed = lambda df: df.withColumn("slot", slot("t", width))
    value = F.when(F.col("sbp").isNotNull(), F.struct("t", "sbp"))
    readings = timed(numerics.select("caseid", "t", "sbp"))
    ends = readings.groupBy(*key).agg(F.min(value).alias("first"), F.max(value).alias("last"))
    along = Window.partitionBy("caseid").orderBy("slot")
    every = ends.unionByName(timed(peaks.select("caseid", "t")).select(*key).distinct(), allowMissingColumns=True).groupBy(*key).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    carried = every.select(*key, F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("later"))

    both = timed(peaks.select("caseid", "t", F.lit(None).cast("double").alias("sbp"), F.lit(1).alias("is_peak"), "peak_no")).unionByName(readings.select(*key, "t", "sbp", F.lit(0).alias("is_peak"), F.lit(None).cast("int").alias("peak_no")))
    reading = F.when((F.col("is_peak") == 0) & F.col("sbp").isNotNull(), F.struct("t", "sbp"))
    back = Window.partitionBy(*key).orderBy("t", "is_peak").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy(*key).orderBy(F.desc("t"), F.desc("is_peak")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("before", F.last(reading, ignorenulls=True).over(back)).withColumn("after", F.last(reading, ignorenulls=True).over(on)).where("is_peak = 1").join(carried, key)
    before, after = F.coalesce("before", "earlier"), F.coalesce("after", "later")
    nearer = F.when(after.isNull() | (F.col("t") - before["t"] <= after["t"] - F.col("t")), before).otherwise(after)
    return found.select("caseid", "peak_no", "t", nearer.alias("b")).select("caseid", "peak_no", "t", F.col("b.t").alias("bp_t"), F.col("b.sbp").alias("sbp"))


#: Samples of a stretch of a recording that is ordered by itself: ten minutes.
STRETCH = 600 * FS


def segment_cycles(samples: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Samples (caseid, sample_idx, v, is_peak) cut at their peaks: a running sum in place of a range join, inside
    stretches of a recording; the peaks of the stretches before are added.

    What lies before the first peak and the open last beat are left out."""
    key = ["caseid", "slot"]
    at = samples.withColumn("slot", slot("sample_idx", stretch))
    held = at.groupBy(*key).agg(F.sum(F.col("is_peak").cast("bigint")).alias("held"))
    along = Window.partitionBy("caseid")
    before = held.select(*key, (F.sum("held").over(along.orderBy("slot")) - F.col("held")).alias("before"), F.sum("held").over(along).alias("last"))
    inside = F.sum(F.col("is_peak").cast("int")).over(Window.partitionBy(*key).orderBy("sample_idx"))
    cut = at.join(before, key).withColumn("beat", F.col("before") + inside).where("beat > 0 AND beat < last")
    return cut.groupBy("caseid", "beat").agg(F.min("sample_idx").alias("start"), F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", "v"))), lambda x: x["v"]).alias("values"))


def metadata_defaults(df: DataFrame, text: tuple[str, ...], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Missing texts are 'unknown', missing numbers NULL; columns that are not there are made."""
    here = set(df.columns)
    made = {c: F.coalesce(F.col(c), F.lit("unknown")) if c in here else F.lit("unknown") for c in text}
    return df.withColumns(made | {c: F.lit(None).cast("double") for c in numbers if c not in here})


def attach_clinical(beats: DataFrame, cases: DataFrame, text: tuple[str, ...] = ("sex", "department", "approach"), numbers: tuple[str, ...] = ()) -> DataFrame:
    """Clinical columns by case; text that is missing is 'unknown'. The catalogue is one row for each case; Spark
    broadcasts it while it is small."""
    return metadata_defaults(beats.join(cases, "caseid", "left"), text, numbers)


def boundary_vs_rest(df: DataFrame, column: str, lo: float = 24, hi: float = 28) -> DataFrame:
    inside = F.coalesce(F.col(column).between(lo, hi), F.lit(False)).alias("inside")
    return df.groupBy(inside).agg(F.count(F.lit(1)).alias("n"), F.avg("sbp_reference").alias("sbp"), F.avg("dbp_reference").alias("dbp"), F.avg("hr_bpm").alias("hr"))


def patients_in_band(df: DataFrame, column: str, lo: float = 24, hi: float = 28) -> DataFrame:
    """Patients with values in a band: how many of their rows, and which share."""
    inside = F.count_if(F.col(column).between(lo, hi))
    return df.groupBy("patient_id").agg(inside.alias("n_inside"), F.count(F.lit(1)).alias("n")).where("n_inside > 0").withColumn("inside_pct", 100.0 * F.col("n_inside") / F.col("n"))


def stratified_sample(cases: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """Up to a third of `total` cases from each age group: (0, 40], (40, 60], (60, 100]."""
    group = F.when((F.col("age") > 0) & (F.col("age") <= 40), 1).when((F.col("age") > 40) & (F.col("age") <= 60), 2).when((F.col("age") > 60) & (F.col("age") <= 100), 3)
    order = Window.partitionBy("age_group").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "caseid")), "caseid")
    return cases.withColumn("age_group", group).where("age_group IS NOT NULL").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= total // 3).drop("__n")
