"""From chunks of recordings to the beat table. Chunks and beats are the rows; a task holds a block of chunks at most.

chunks: caseid, chunk_id, start_sample, ecg, ppg (arrays of doubles, NULL or NaN where a sample is missing).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import first_failed
from ..operators import joins, physiology, quality, select
from ..sources.stages import Stages
from . import beats as beat_kernels
from . import blocks, kernels
from .blocks import DRIFT_HALO, band_filtered, drift_free, without_gaps
from .chunks import Source, arrow_column, detect_r_peaks, sampled, sourced, views, with_halo
from .kernels import FS

#: Points that beats are resampled to before they are compared, and least likeness to their case's median beat.
POINTS, LEAST_LIKENESS = 200, 0.85
#: Longest beat in ms; a beat may reach so far into the next chunk.
LONGEST_MS = 1500
#: Beats of a polarity vote, and how much of a beat votes, in ms.
VOTERS, VOTE_MS = 30, 600


def per_array(kernel: Callable[[np.ndarray], np.ndarray], kind: str = "array<double>") -> Callable[[Column], Column]:
    """A kernel as a function of an array column; NULL arrays stay NULL."""

    def run(column: pa.Array) -> pa.Array:
        return arrow_column([None if x is None else kernel(x) for x in views(column)], kind)

    return F.arrow_udf(run, kind)


def remove_spikes(column: str | Column, limit: float = 5.0) -> Column:
    return per_array(lambda x: kernels.remove_spikes(x, limit))(column)


def bandpass(column: str | Column, fs: int = FS) -> Column:
    return per_array(lambda x: kernels.bandpass(x, fs))(column)


def resample(column: str | Column, points: int = POINTS) -> Column:
    return per_array(lambda x: kernels.resample(x, points))(column)


def welch_power(column: str | Column, fs: int = FS) -> Column:
    """Array of the power from 0.5 to 4 Hz, the power below, and their ratio."""
    return per_array(lambda x: np.array(kernels.welch_power(x, fs)))(column)


def adaptive_peaks(column: str | Column, fs: int = FS) -> Column:
    return per_array(lambda x: kernels.adaptive_peaks(x, fs), "array<bigint>")(column)


def energy_r_peaks(column: str | Column, fs: int = FS) -> Column:
    return per_array(lambda x: kernels.energy_r_peaks(x, fs), "array<bigint>")(column)


def _pairwise(kernel: Callable[[np.ndarray, np.ndarray], float], kind: str) -> Callable[[Column, Column], Column]:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernel(np.asarray(x, dtype=float), np.asarray(y, dtype=float)) for x, y in zip(a, b)])

    return F.pandas_udf(run, kind)


def waveform_correlation(a: str | Column, b: str | Column) -> Column:
    return _pairwise(kernels.likeness, "double")(a, b)


def best_lag(a: str | Column, b: str | Column, most: int) -> Column:
    """Samples by which array b follows array a, within `most`."""
    return _pairwise(lambda x, y: kernels.best_lag(x, y, most), "bigint")(a, b)


def ecg_ppg_lag(chunks: DataFrame, seconds: int = 10, most_ms: int = 500, fs: int = FS) -> DataFrame:
    """caseid and lag_ms: by how much the pulse follows the ECG in the first seconds of each case."""
    first = chunks.where("chunk_id = 0").select("caseid", F.slice("ecg", 1, seconds * fs).alias("ecg"), F.slice("ppg", 1, seconds * fs).alias("ppg"))
    return first.select("caseid", (best_lag("ecg", "ppg", most_ms * fs // 1000) * 1000.0 / fs).alias("lag_ms"))


def _sums(samples: pd.Series) -> pd.DataFrame:
    fine = [x[~np.isnan(x)] for x in (np.zeros(0) if x is None else np.asarray(x, dtype=float) for x in samples)]
    return pd.DataFrame({"total": [float(x.sum()) for x in fine], "n": [len(x) for x in fine]})


def _means(chunks: DataFrame | Source, column: str) -> DataFrame:
    """caseid and the mean of a recording's samples: sums of chunks, added up by case."""
    sums = sampled(chunks).select("caseid", F.pandas_udf(_sums, "total double, n bigint")(column).alias("s"))
    return sums.groupBy("caseid").agg(F.try_divide(F.sum("s.total"), F.sum("s.n")).alias("__mean"))


def filled(chunks: DataFrame, column: str) -> DataFrame:
    """Missing samples of a signal become the mean of their recording."""

    def run(x: pa.Array, mean: pa.Array) -> pa.Array:
        return arrow_column([None if v is None else without_gaps(v, m) for v, m in zip(views(x), mean.to_pylist())], "array<double>")

    own = chunks.drop(f"{column}_left", f"{column}_right")
    return own.join(_means(chunks, column), "caseid").withColumn(column, F.arrow_udf(run, "array<double>")(column, "__mean")).drop("__mean")


def wavelet_filter(chunks: DataFrame | Source, rates: DataFrame, column: str, kind: str, fs: int = FS) -> DataFrame:
    """Chunks with a signal, its gaps filled, reduced to multiples of the case's heart rate (`rates`: caseid, hr); each chunk by
    itself. Means and rates are joined to the rows of a source, so its samples don't move; those of a table move once."""

    def run(x: pa.Array, mean: pa.Array, hr: pa.Array) -> pa.Array:
        return arrow_column([band_filtered(v, m, r, kind, fs) for v, m, r in zip(views(x), mean.to_pylist(), hr.to_pylist())], "array<double>")

    own = chunks if isinstance(chunks, Source) else Source(chunks.drop(f"{column}_left", f"{column}_right"), lambda rows: rows)
    cases = _means(chunks, column).join(rates.select("caseid", "hr"), "caseid")
    joined = own.made(own.rows.join(cases, "caseid")).drop(f"{column}_left", f"{column}_right")
    return joined.withColumn(column, F.arrow_udf(run, "array<double>")(column, "__mean", "hr")).drop("hr", "__mean")


def _cut(own: pa.Array, right: pa.Array, starts: pa.Array, ends: pa.Array, reach: int) -> pa.Array:
    """The samples between each start and end of a chunk, counted from its first sample, NULL where they reach beyond what
    is there. Arrays of arrays."""
    made, counts = [], [0]
    for x, beyond, begun, ended in zip(views(own), views(right), starts.to_pylist(), ends.to_pylist()):
        held = None if x is None or beyond is None else np.concatenate((x, beyond[:reach]))
        made += [None if held is None or b > len(held) else held[a:b] for a, b in zip(begun, ended)]
        counts.append(len(made))
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), arrow_column(made, "array<double>"))


def cut_beats(chunks: DataFrame | Source, spans: DataFrame, column: str, fs: int = FS) -> DataFrame:
    """`spans` (caseid, sample_idx, end_idx) with the samples of a signal between: each beat from the chunk that it starts
    in and the beginning of the next one. Beats that reach beyond are left out. The spans of a chunk come to it as one list.
    """
    reach, names = LONGEST_MS * fs // 1000, [c for c in spans.columns if c != "caseid"]
    source = sourced(chunks, column, reach)
    if source.size and source.deal:
        # both sides are dealt alike, so that the spans move once
        chunk = F.floor(F.col("sample_idx") / source.size).cast("int").alias("chunk_id")
        held = spans.select("caseid", chunk, F.struct(*names).alias("__span")).groupBy("caseid", "chunk_id").agg(F.collect_list("__span").alias("__spans"))
        rows = source.samples(source.deal(source.rows).join(source.deal(held), ["caseid", "chunk_id"]))
    else:
        # the length of a chunk, from its number and where it starts; where there are first chunks only, all beats are theirs
        chunk = source.rows.where("chunk_id > 0").agg(F.max(F.col("start_sample") / F.col("chunk_id")).cast("bigint").alias("__size"))
        start = F.coalesce(F.col("sample_idx") - F.col("sample_idx") % F.col("__size"), F.lit(0))
        sized = spans.join(F.broadcast(chunk), F.lit(True)).select("caseid", start.cast("bigint").alias("start_sample"), F.struct(*names).alias("__span"))
        held = sized.groupBy("caseid", "start_sample").agg(F.collect_list("__span").alias("__spans"))
        rows = source.made(source.rows.join(held, ["caseid", "start_sample"]))
    cut = F.arrow_udf(lambda *c: _cut(*c, reach), "array<array<double>>")
    at = lambda name: F.transform("__spans", lambda s: (s[name] - F.col("start_sample")).cast("bigint"))
    each = rows.select("caseid", "__spans", cut(F.col(column), F.col(f"{column}_right"), at("sample_idx"), at("end_idx")).alias("__cut"))
    beats = each.select("caseid", F.explode(F.arrays_zip("__spans", "__cut")).alias("__beat"))
    return beats.select("caseid", *[F.col(f"__beat.__spans.{c}").alias(c) for c in names], F.col("__beat.__cut").alias(column)).where(F.col(column).isNotNull())


def without_drift(chunks: DataFrame | Source, column: str = "ppg", fs: int = FS, more: tuple[str, ...] = ()) -> DataFrame:
    """caseid, chunk_id, start_sample, the signal high-passed at half a Hertz, each chunk with the context of its neighbours,
    and `more` columns as they are."""

    def flat(left: pa.Array, own: pa.Array, right: pa.Array) -> pa.Array:
        return arrow_column([drift_free(*parts, fs) for parts in zip(views(left), views(own), views(right))], "array<double>")

    halo = with_halo(sampled(chunks), column, DRIFT_HALO)
    return halo.select("caseid", "chunk_id", "start_sample", *more, F.arrow_udf(flat, "array<double>")("left_halo", column, "right_halo").alias(column))


def _votes(steady: Callable[[DataFrame], DataFrame], spans: DataFrame, size: Column, stage: Callable[[DataFrame], DataFrame], kernel: Callable[[np.ndarray], int]) -> DataFrame:
    """caseid and the kernel's vote of each span (caseid, sample_idx, end_idx) of the high-passed signal.

    A span inside a chunk votes where the chunk is made; of one that crosses an edge, each chunk gives its part, and only
    these parts move. Spans that reach beyond what is there don't vote. `steady` makes the signal for rows with their chunk_id
    and `__spans`, which are all that is wanted of it; `stage` writes votes and parts.
    """

    def run(x: pa.Array, starts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
        votes, parts, counts = [], [], [0]
        for own, start, begun, ended in zip(views(x), starts.to_pylist(), begins.to_pylist(), ends.to_pylist()):
            for b, e in zip(begun, ended):
                part = own[max(b - start, 0) : max(e - start, 0)]
                votes.append(kernel(part) if len(part) == e - b else None)
                parts.append(None if len(part) == e - b else part)
            counts.append(len(votes))
        each = pa.StructArray.from_arrays([pa.array(votes, pa.int32()), arrow_column(parts, "array<double>")], ["vote", "part"])
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), each)

    over = F.explode(F.sequence(*[F.floor(x / size).cast("int") for x in (F.col("sample_idx"), F.col("end_idx") - 1)]))
    held = spans.select("caseid", "sample_idx", "end_idx", over.alias("chunk_id")).groupBy("caseid", "chunk_id").agg(F.collect_list(F.struct("sample_idx", "end_idx")).alias("__spans"))
    made = F.arrow_udf(run, "array<struct<vote: int, part: array<double>>>")("ppg", "start_sample", "__spans.sample_idx", "__spans.end_idx")
    each = steady(held).select("caseid", "start_sample", "__spans", made.alias("__made")).select("caseid", "start_sample", F.explode(F.arrays_zip("__spans", "__made")).alias("x"))
    written = stage(each.select("caseid", "start_sample", F.col("x.__spans.sample_idx").alias("sample_idx"), F.col("x.__spans.end_idx").alias("end_idx"), "x.__made.vote", "x.__made.part"))
    parts = written.where("part IS NOT NULL").groupBy("caseid", "sample_idx", "end_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_sample", "part"))), lambda p: p["part"])).alias("ppg"))
    whole = parts.where(F.size("ppg") == F.col("end_idx") - F.col("sample_idx")).select("caseid", per_array(kernel, "int")("ppg").alias("vote"))
    return written.where("part IS NULL").select("caseid", "vote").unionByName(whole)


def _is_voter(n: Column) -> Column:
    """Whether a peak's beat votes, of n peaks of its recording: those from the start, the first quarter, the middle and the
    end, or all where there are few."""
    k = F.least(F.lit(VOTERS), F.floor(n / 4))
    at = lambda start: F.col("peak_no").between(start, start + k - 1)
    return ((n <= 100) & (F.col("peak_no") < n - 1)) | ((n > 100) & (at(F.lit(0)) | at(F.floor(n / 4)) | at(F.floor(n / 2)) | at(n - k - 1)))


def beat_votes(steady: Callable[[DataFrame], DataFrame], peaks: DataFrame, size: Column, stage: Callable[[DataFrame], DataFrame], fs: int = FS) -> DataFrame:
    """caseid, votes and share (of votes for inverted) of the beats that vote."""
    # counted in a window, as a join with the counts would find the peaks twice
    voters = peaks.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("caseid"))).where(_is_voter(F.col("n"))).select("caseid", "sample_idx", (F.col("sample_idx") + int(VOTE_MS / 1000 * fs)).alias("end_idx"))
    votes = _votes(steady, voters, size, stage, lambda x: beat_kernels.polarity_vote(x, fs)).where("vote >= 0")
    return votes.groupBy("caseid").agg(F.count(F.lit(1)).alias("votes"), F.avg("vote").alias("share"))


def _windows(held: DataFrame, fs: int) -> DataFrame:
    """caseid, sample_idx and end_idx of the windows that recordings (caseid, samples) vote by."""
    long = beat_kernels.WINDOW_MS * fs // 1000
    count = F.least(F.lit(beat_kernels.WINDOWS), F.floor((F.col("samples") - 1) / long)).cast("int")
    each = held.where(count > 0).select("caseid", F.explode(F.sequence(F.lit(0), count - 1)).alias("w"))
    return each.select("caseid", (F.col("w") * long).cast("bigint").alias("sample_idx"), ((F.col("w") + 1) * long + 1).cast("bigint").alias("end_idx"))


def window_votes(steady: Callable[[DataFrame], DataFrame], held: DataFrame, size: Column, stage: Callable[[DataFrame], DataFrame], fs: int = FS) -> DataFrame:
    """The same for recordings (caseid, samples) without usable beats: windows of slopes from their start, which may cross
    the edges of chunks."""
    votes = _votes(steady, _windows(held, fs), size, stage, lambda x: int(beat_kernels.falls_first(np.diff(x))))
    return votes.groupBy("caseid").agg(F.count(F.lit(1)).alias("votes"), F.avg("vote").alias("share")).where(F.col("votes") >= beat_kernels.LEAST_WINDOWS)


def detect_polarity(chunks: DataFrame | Source, peaks: DataFrame, fs: int = FS, stages: Stages | None = None) -> DataFrame:
    """caseid and inverted, for each recording: by its beats, or by windows of slopes where no beat says anything; upright
    where these do not either.

    Only votes are kept of the high-passed signal. That of a table of chunks is written once; that of a source is made again
    for the recordings that vote by windows, so no samples are written or moved.
    """
    rows = chunks.rows if isinstance(chunks, Source) else chunks
    stages = stages or Stages(rows.sparkSession)
    if isinstance(chunks, Source) and chunks.size and chunks.deal:
        size, lengths = F.lit(chunks.size), rows.groupBy("caseid").agg(F.count(F.lit(1)) * chunks.size).toDF("caseid", "samples")
        steady = lambda held: without_drift(chunks.samples(chunks.deal(rows).join(chunks.deal(held), ["caseid", "chunk_id"])), "ppg", fs, ("__spans",))
    else:
        flat = stages.table("steady", lambda: without_drift(chunks, "ppg", fs))
        lengths = flat.groupBy("caseid").agg(F.sum(F.size("ppg")).alias("samples"))
        # from the number of a chunk and where it starts; where there are first chunks only, all spans are theirs
        longest = flat.where("chunk_id > 0").agg(F.max(F.col("start_sample") / F.col("chunk_id")).cast("bigint")).first()[0]
        size = F.lit(longest or 1 << 62)
        steady = lambda held: flat.join(held, ["caseid", "chunk_id"])
    part = lambda name: lambda df: stages.table(name, lambda: df)
    by_beats = stages.table("beat_votes", lambda: beat_votes(steady, peaks, size, part("beat_parts"), fs))
    without = lengths.join(by_beats.select("caseid"), "caseid", "left_anti")
    by_windows = window_votes(steady, without, size, part("window_parts"), fs)
    votes = by_beats.unionByName(by_windows).select("caseid", (F.col("share") > beat_kernels.INVERTED_SHARE).alias("inverted"))
    return rows.select("caseid").distinct().join(votes, "caseid", "left").select("caseid", F.coalesce("inverted", F.lit(False)).alias("inverted"))


def extract_features(cycles: DataFrame, fs: int = FS, gate: bool = True, features: tuple[str, ...] = beat_kernels.FEATURES) -> DataFrame:
    """All columns of `cycles` (ppg, inverted, and more) with one column for each of `features`, and `reason`: empty, or why
    there are none. Only what these features need is made."""
    kept = [c for c in cycles.columns if c not in ("ppg", "inverted")]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in cycles.dtypes if c in kept), *(f"{f} double" for f in features), "reason string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ppg, inverted = batch.column(len(kept)), batch.column(len(kept) + 1)
            made, reasons = beat_kernels.extract_all(list(views(ppg)), inverted.to_pylist(), fs, gate, features)
            held = pa.array([why == "" for why in reasons])
            columns = [pc.if_else(held, pa.array(x), pa.scalar(None, pa.float64())) for x in made.T]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns, pa.array(reasons, pa.string())], [*kept, *features, "reason"])

    return cycles.select(*kept, "ppg", "inverted").mapInArrow(run, schema)


def judged_spans(spans: DataFrame, numerics: DataFrame, fs: int = FS) -> DataFrame:
    """All spans between peaks with their time and pressures, and why a span gives no beat: its length, no pressure at its
    time, a missing one, or one that can't be recorded. Empty where it does."""
    timed = spans.withColumn("timestamp", F.col("sample_idx") / F.lit(float(fs)))
    pressed = joins.nearest_bp(timed, numerics.withColumn("__there", F.lit(True)), fs, how="left").withColumnsRenamed({"sbp": "sbp_reference", "dbp": "dbp_reference"})
    either = F.col("sbp_reference").isNull() | F.col("dbp_reference").isNull()
    reason = first_failed([("cycle_length", F.col("len_ms").between(*joins.CYCLE_MS)), ("no_pressure", F.col("__there")), ("missing_pressure", ~either), ("pressure_range", physiology.recordable())])
    return pressed.withColumn("reason", F.coalesce(reason, F.lit(""))).drop("__there")


def synchronised_cycles(chunks: DataFrame | Source, numerics: DataFrame, fs: int = FS, least: float = LEAST_LIKENESS, stages: Stages | None = None, block: int = blocks.BLOCK) -> DataFrame:
    """Beats with their pulse signal, pressures, likeness to their case's median beat, and whether their case is inverted.

    Peaks, heart rates, band filter, beats of a plausible length, the nearest pressure in the recordable range, and beats
    that resemble the median beat. What several steps read is a written stage, so each kernel runs once; but the samples of a
    source are filtered in two passes, in blocks of chunks, as writing and moving them takes more than making them again.
    """
    stages = stages or Stages((chunks.rows if isinstance(chunks, Source) else chunks).sparkSession)
    peaks = stages.table("peaks", lambda: detect_r_peaks(chunks, "ecg", fs=fs))
    spans = joins.rr_intervals(peaks, fs)
    rates = joins.rr_stats(spans)
    if isinstance(chunks, Source) and chunks.size and chunks.deal:
        return _synchronised_blocks(chunks, spans, rates, numerics, fs, least, stages, block)
    filtered = stages.table("filtered", lambda: wavelet_filter(chunks, rates, "ppg", "ppg", fs).select("caseid", "chunk_id", "start_sample", "ppg"))

    judged = stages.table("spans", lambda: judged_spans(spans, numerics, fs))
    cut = lambda: cut_beats(filtered, judged.where("reason = ''").drop("reason"), "ppg", fs=fs).withColumn("shape", resample("ppg"))
    cycles = stages.table("cycles", cut)
    alike = select.template_correlation_filter(cycles, select.median_template(cycles, "shape"), "shape", least).drop("shape")
    return alike.join(detect_polarity(filtered, peaks.join(rates.select("caseid"), "caseid", "left_semi"), fs, stages), "caseid")


def _synchronised_blocks(source: Source, spans: DataFrame, rates: DataFrame, numerics: DataFrame, fs: int, least: float, stages: Stages, block: int) -> DataFrame:
    """The same of a source. The first pass gives templates and votes, the second the beats; what is written of either is
    `first_look`."""
    reach, n = LONGEST_MS * fs // 1000, F.count(F.lit(1)).over(Window.partitionBy("caseid")) + 1
    # the last peak begins no span, so there is one peak more
    voting = spans.withColumn("vote_end", F.when(_is_voter(n), F.col("sample_idx") + int(VOTE_MS / 1000 * fs)))
    judged = stages.table("spans", lambda: judged_spans(voting, numerics, fs))
    cases = stages.table("cases", lambda: _means(source, "ppg").join(rates.select("caseid", F.col("hr").alias("__hr")), "caseid"))
    looked = judged.select("caseid", "peak_no", "sample_idx", "end_idx", (F.col("reason") == "").alias("is_beat"), "vote_end").where("is_beat OR vote_end IS NOT NULL")
    look = stages.table("first_look", lambda: blocks.first_look(source, cases, looked, "ppg", "ppg", lambda x: beat_kernels.polarity_vote(x, fs), POINTS, reach, fs, block))
    stages.table("cycles", lambda: look.select("caseid", F.explode("beats").alias("peak_no")))

    shares = lambda df: df.groupBy("caseid").agg(F.sum("votes").alias("votes"), F.try_divide(F.sum("ones"), F.sum("votes")).alias("share"))
    by_beats = shares(look).where("votes > 0")
    windows = _windows(source.rows.groupBy("caseid").agg((F.count(F.lit(1)) * source.size).alias("samples")).join(cases.select("caseid"), "caseid", "left_semi").join(by_beats.select("caseid"), "caseid", "left_anti"), fs)
    asked = windows.select("caseid", F.lit(0).alias("peak_no"), "sample_idx", "end_idx", F.lit(False).alias("is_beat"), F.col("end_idx").alias("vote_end"))
    by_windows = stages.table("window_look", lambda: blocks.first_look(source, cases, asked, "ppg", "ppg", lambda x: int(beat_kernels.falls_first(np.diff(x))), POINTS, reach, fs, block))
    votes = by_beats.unionByName(shares(by_windows).where(F.col("votes") >= beat_kernels.LEAST_WINDOWS))
    inverted = votes.select("caseid", (F.col("share") > beat_kernels.INVERTED_SHARE).alias("inverted"))
    known = cases.join(blocks.templates(look), "caseid").join(inverted, "caseid", "left").withColumn("inverted", F.coalesce("inverted", F.lit(False)))
    beats = judged.where("reason = ''").select("caseid", "peak_no", "sample_idx", "end_idx", "timestamp", "hr", "sbp_reference", "dbp_reference")
    return blocks.alike_beats(source, known, beats, "ppg", "ppg", least, POINTS, reach, fs, block)


def process_recordings(chunks: DataFrame | Source, numerics: DataFrame, fs: int = FS, least: float = LEAST_LIKENESS, stages: Stages | None = None, block: int = blocks.BLOCK) -> DataFrame:
    """The beat table of recordings, with `reason` where a beat has no features or implausible ones."""
    cycles = synchronised_cycles(chunks, numerics, fs, least, stages, block)
    rows = cycles.select("caseid", F.col("peak_no").cast("int").alias("cycle_index"), "timestamp", "sbp_reference", "dbp_reference", "cycle_correlation", F.col("hr").alias("hr_bpm"), "ppg", "inverted")
    made = extract_features(rows, fs)
    return made.withColumn("reason", F.when((F.col("reason") == "") & ~physiology.valid_beat(), "invalid_features").otherwise(F.col("reason")))


def build_beats(
    chunks: DataFrame | Source, numerics: DataFrame, cases: DataFrame, text: tuple[str, ...] = (), numbers: tuple[str, ...] = (), fs: int = FS, complete: list[str] | None = None,
    stages: Stages | None = None, done: DataFrame | None = None,
) -> DataFrame:
    """Valid beats of all recordings with clinical columns, without incomplete rows (in `complete`, or any column).

    With the beats that are `done` (patient_id), only recordings that are not among them are built; with `stages` in a
    folder of its own, a run that was stopped goes on behind its last whole stage.
    """
    if done is not None:
        left = lambda rows: joins.pending_cases(rows, done.select(F.col("patient_id").alias("caseid")).distinct())
        chunks = replace(chunks, rows=left(chunks.rows)) if isinstance(chunks, Source) else left(chunks)
    stages = stages or Stages((chunks.rows if isinstance(chunks, Source) else chunks).sparkSession)
    beats = stages.table("beats", lambda: process_recordings(chunks, numerics, fs, stages=stages))
    valid = beats.where("reason = ''").drop("reason")
    named = joins.attach_clinical(valid, cases, text, numbers).withColumn("session_id", F.format_string("case_%05d.npz", "caseid")).withColumnRenamed("caseid", "patient_id")
    return select.drop_incomplete(named, complete)


def build_failures(stages: Stages) -> DataFrame:
    """How many spans of a finished build gave beats, and why the others did not: reason, n, attempts and share.

    Reads the build's stages: spans by their own reason, beats that could not be cut or are not like their case's others,
    and beats by the reason of their features.
    """
    spans, cycles, beats = (stages.spark.read.parquet(f"{stages.folder}/{name}") for name in ("spans", "cycles", "beats"))
    key = ["caseid", "peak_no"]
    made = beats.select("caseid", F.col("cycle_index").alias("peak_no"))
    lost = lambda df, found, why: df.join(found.select(*key), key, "left_anti").select(F.lit(why).alias("reason"))
    each = [spans.where("reason <> ''").select("reason"), lost(spans.where("reason = ''"), cycles, "cut_short"), lost(cycles, made, "unlike_median"), beats.select("reason")]
    return quality.extraction_failures(reduce(DataFrame.union, each))
