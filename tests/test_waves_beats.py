"""Waveform kernels against closed forms and plain computations, and the jobs on recordings against whole signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatspark import fixtures as fx
from beatspark.functions import arrays
from beatspark.operators import joins, stats
from beatspark.operators.quantiles import numbered, quantiles
from beatspark.waves import beats, kernels, recordings

SF = "/root/testdata/sf0.001"


def pulse(n=400, peak=130):
    """An upright beat: a steep rise to its peak, and a second wave."""
    at = np.arange(n, dtype=float)
    return 40 * np.exp(-(((at - peak) / 28) ** 2)) + 16 * np.exp(-(((at - peak - 110) / 40) ** 2))


def test_smooth():
    x = np.random.default_rng(0).normal(size=50)
    assert np.allclose(kernels.smooth(np.ones(30), 3), 1) and abs(kernels.smooth(x, 2).mean() - x.mean()) < 0.1
    mirrored = np.concatenate((x[::-1], x, x[::-1]))
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    assert np.allclose(kernels.smooth(x, 2)[10], (mirrored[52:69] * w).sum() / w.sum())


def test_zero_phase_keeps_and_removes():
    t = np.arange(5000) / 500
    slow, fast, drift = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 60 * t), 5 + t
    kept = kernels.bandpass(slow + fast + drift, despike=False)
    assert np.abs(kept - slow)[1000:4000].max() < 0.05
    assert np.abs(kernels.zero_phase(drift, 0.5, None, 2))[1000:4000].max() < 0.05


def test_remove_spikes_leaves_gaps():
    x = np.sin(np.arange(200) / 9.0)
    spiked = x.copy()
    spiked[[20, 90]] = 50, -40
    spiked[50:55] = np.nan
    clean = kernels.remove_spikes(spiked)
    assert np.isnan(clean[50:55]).all() and np.abs(np.delete(clean - x, range(50, 55))).max() < 0.2
    assert (kernels.remove_spikes(np.array([1.0, np.nan, 99.0])) == np.array([1.0, np.nan, 99.0])).sum() == 2


@pytest.mark.parametrize("inverted", [False, True])
def test_landmarks_of_a_pulse(inverted):
    x = pulse()
    found, why = beats.extract(-x if inverted else x, inverted)
    assert why == "" and abs(found["pat_to_peak"] - 260) < 12 and 100 < found["ptt_peak_to_foot"] < 240
    assert found["ptt_peak_to_foot"] < found["pat_to_maxslope"] < found["pat_to_peak"]
    assert 0.05 <= found["amplitude_ratio_ra"] <= 0.95 and found["pulse_width_50"] > 0
    assert abs(found["stat_mean"] - (-x if inverted else x).mean()) < 1e-9


def test_landmarks_move_with_the_wave():
    places = [beats.extract(pulse(peak=p), False)[0] for p in (120, 130, 145)]
    peaks = [round(f["pat_to_peak"] / 2) for f in places]
    assert peaks == [120, 130, 145]
    feet = [f["ptt_peak_to_foot"] for f in places]
    assert feet == sorted(feet) and 0 < feet[2] - feet[0] < 80


def test_unusable_beats_have_a_reason():
    assert beats.extract(np.zeros(300)) == (None, "flat")
    assert beats.extract(np.arange(10.0))[1] == "too_short"
    assert beats.extract(np.random.default_rng(2).normal(size=300) * 10)[1] in ("low_snr", "weak_pulse")
    # a beat without any clear landmark still gets places inside itself
    for shape in (np.linspace(0, 50, 300), np.linspace(50, 0, 300), 20 * np.cos(np.arange(300) / 30.0), pulse(55) + 10):
        found, why = beats.extract(shape, False, gate=False)
        assert why == "" and 0 <= found["ptt_peak_to_foot"] <= len(shape) * 2 and all(np.isfinite(list(found.values())))


def test_beats_with_missing_samples():
    for first in (0, 60, 120, 370):
        x = pulse()
        x[first : first + 30] = np.nan
        found, why = beats.extract(x, False)
        assert why == "" and all(np.isfinite(list(found.values()))) and abs(found["pat_to_peak"] - 260) < 40
    assert beats.extract(np.full(300, np.nan))[1] == "all_null" and beats.extract(np.full(300, np.nan), gate=False) == (None, "flat")


def test_polarity():
    x = pulse(300) - pulse(300).mean()
    assert beats.polarity_vote(x) == 0 and beats.polarity_vote(-x) == 1 and beats.polarity_vote(np.zeros(300)) == -1
    long = np.tile(pulse(), 10)
    assert not beats.polarity_by_slope(long) and beats.polarity_by_slope(-long) and not beats.polarity_by_slope(long[:500])


def test_peak_finders():
    x = np.tile(pulse(), 5)
    assert [p % 400 for p in kernels.adaptive_peaks(x)] == [130] * 5 and len(kernels.adaptive_peaks(np.zeros(100))) == 0
    ecg = np.tile(100 * np.exp(-(((np.arange(400) - 200) / 4.0) ** 2)), 6)
    assert all(abs(p % 400 - 200) <= 2 for p in kernels.energy_r_peaks(ecg)) and len(kernels.energy_r_peaks(ecg)) == 6


def test_gate_is_the_same_in_spark(spark):
    rng = np.random.default_rng(3)
    made = [pulse().tolist(), [1.0] * 100, rng.normal(size=100).tolist(), (rng.normal(size=100) * 9).tolist(), [0.0, 9.0] * 60, [1.0] * 5, [None] * 40, [None] * 90 + list(range(15)), (pulse() + rng.normal(size=400) * 2.5).tolist()]
    frame = spark.createDataFrame([(k, [None if v is None else float(v) for v in x]) for k, x in enumerate(made)], "k int, x array<double>")
    got = {r.k: r.why for r in frame.select("k", arrays.segment_quality(F.col("x")).alias("why")).collect()}
    assert got == {k: kernels.quality_gate(np.array([np.nan if v is None else v for v in x], dtype=float)) for k, x in enumerate(made)}


def test_recordings(spark):
    """Beats of made recordings: one for each period, upright or turned, the peak where it was put."""
    chunks, numerics = fx.view(spark, SF, fx.WAVES_FX), fx.view(spark, SF, fx.WAVE_NUMERICS_FX)
    made = recordings.process_recordings(chunks, numerics).toPandas()
    spans = joins.rr_intervals(recordings.detect_r_peaks(chunks)).toPandas()
    period = {c: 330 + c * 37 % 160 for c in spans["caseid"].unique()}
    # the steepest rise and the steepest fall of an ECG wave are a few samples apart, and noise chooses
    assert (np.abs(spans["len_ms"] - [period[c] * 2.0 for c in spans["caseid"]]) <= 40).mean() > 0.95
    turned = {r.caseid: r.inverted for r in recordings.detect_polarity(chunks, recordings.detect_r_peaks(chunks)).collect()}
    assert turned == {c: c % 4 == 3 for c in turned}
    assert len(made) > 100 and made["cycle_correlation"].min() >= 0.85 and (made["reason"] == "").any()
    ids = made.groupby("caseid")["cycle_index"]
    assert (ids.nunique() == ids.count()).all()


def test_cut_beats_equals_the_whole(spark):
    chunks = fx.view(spark, SF, fx.WAVES_FX).where("caseid = 1")
    whole = np.concatenate([r.ppg for r in chunks.orderBy("chunk_id").collect()])
    spans = spark.createDataFrame([(1, s, s + 700) for s in range(0, 39_000, 977)], "caseid int, sample_idx bigint, end_idx bigint")
    for r in recordings.cut_beats(chunks, spans, "ppg").collect():
        assert np.array_equal(r.ppg, whole[r.sample_idx : r.end_idx])


def test_quantiles_and_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 997), (None, 50)) for v in rng.integers(0, 40, n) / 3]
    found = quantiles(spark.createDataFrame(rows, "key string, x double"), "key", "x", (0, 0.1, 0.5, 0.99, 1), parts=7).collect()
    for r in found:
        assert abs(r.value - np.quantile([x for k, x in rows if k == r.key], r.p)) < 1e-9
    assert len(found) == 20
    words = sorted({"".join(rng.choice(list("abé"), int(rng.integers(0, 7)))) for _ in range(200)}, key=lambda w: w.encode())
    placed = numbered(spark.createDataFrame([(w,) for w in words], "w string"), F.col("w"), (1, 2, 3)).collect()
    assert sorted((r.k, r.w) for r in placed) == list(enumerate(words, 1))


def test_f_tail():
    x = np.linspace(1e-9, 200, 4_000_001)
    for d1, d2, f in ((2, 10, 3.0), (5, 40, 1.2), (3, 7, 0.4)):
        density = x ** (d1 / 2 - 1) * (1 + d1 * x / d2) ** (-(d1 + d2) / 2)
        assert abs(stats.f_tail(f, d1, d2) - np.trapezoid(density[x >= f], x[x >= f]) / np.trapezoid(density, x)) < 2e-3
    assert stats.f_tail(0.0, 3, 9) == 1.0


def test_waves_are_the_rows_of_their_text(spark):
    """Samples made an array at a time are those of the SQL text, with the neighbours' ends; nothing moves them to find peaks."""
    want = {(r.caseid, r.chunk_id): r for r in fx.view(spark, SF, fx.WAVES_FX).where("caseid < 5").collect()}
    made = fx.waves(spark, SF)
    got = made.where("caseid < 5").collect()
    plain = lambda x: np.array([np.nan if v is None else v for v in x])
    assert {(r.caseid, r.chunk_id) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        for c in ("ecg", "ppg"):
            before, after = (want.get((r.caseid, r.chunk_id + k)) for k in (-1, 1))
            for mine, theirs in ((r[c], want[r.caseid, r.chunk_id][c]), (r[f"{c}_left"], before[c][-2000:] if before else []), (r[f"{c}_right"], after[c][:2000] if after else [])):
                assert len(mine) == len(theirs) and np.allclose(plain(mine), plain(theirs), rtol=0, atol=1e-9, equal_nan=True)
    plan = recordings.with_halo(made.select("caseid", "chunk_id", "start_sample", "ecg", "ecg_left", "ecg_right"), "ecg")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("ArrowEvalPython")] and made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_fast_kernels_equal_plain_ones():
    x = np.random.default_rng(5).normal(size=3001).cumsum()
    mean, most = kernels.trailing(x, 1000)
    assert all(most[k] == x[max(0, k - 999) : k + 1].max() for k in range(0, 3001, 37))
    for low, high in ((0.5, 0.9), (0.7, 2.4), (20.0, 238.0)):
        size = 1 << (2 * len(x) - 1).bit_length()
        f, spectrum = np.fft.fftfreq(size, 1 / 500), np.fft.fft(x, size)
        each = [np.fft.ifft(spectrum * np.sqrt(500 / c) * np.exp(-(np.pi**2) * 1.5 * (f / c - 1) ** 2))[: len(x)].real for c in np.linspace(low, high, 32)]
        assert np.allclose(kernels.morlet_band(x, low, high), sum(each), atol=1e-8 * np.abs(sum(each)).max())
