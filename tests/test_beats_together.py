"""Beats of one length are made together, as tables; each is as if it were made alone, by the plain kernels of one signal."""

import numpy as np

from beatspark import fixtures as fx
from beatspark.operators import joins
from beatspark.sources.stages import Stages
from beatspark.waves import beats, kernels, recordings
from beatspark.waves.chunks import detect_r_peaks

SF = "/root/testdata/sf0.001"


def plain_peak(y):
    n = len(y)
    first = min(40, n // 4)
    region = y[first : max(first + 1, min(300, int(0.7 * n)))]
    found = kernels.find_peaks(region, least=0.02)
    return first + int(found[kernels.prominence(region, found).argmax()] if len(found) else region.argmax())


def plain_foot(y, peak):
    last = max(peak - 5, 0)
    first = min(10, last)
    calm = kernels.smooth(kernels.remove_spikes(y, 4.0), 3.0)
    rise = np.gradient(calm)[first : peak + 1] if peak > first else np.zeros(1)
    steepest = first + int(rise.argmax())
    lowest = first + int(calm[first : steepest + 1].argmin())
    if rise.max() <= 0 or calm[steepest] - calm[lowest] < 0.01:
        return first + int(calm[first : last + 1].argmin())
    return int(np.clip(round(steepest - (calm[steepest] - calm[lowest]) / rise.max()), max(first, lowest), last))


def plain_notch(y, peak):
    last, first = peak + min(175, int(0.8 * (len(y) - peak))), peak + 15
    if last - first < 5:
        return -1
    calm = kernels.smooth(y, 4.0)
    valleys = kernels.find_peaks(-calm[first:last], least=0.005)
    if len(valleys):
        return first + int(valleys[0])
    bend = np.gradient(np.gradient(calm))[peak:last]
    inflected = np.flatnonzero((bend[:-1] <= 0) & (bend[1:] > 0))
    return peak + int(inflected[0]) + 1 + int(bend[inflected[0] + 1 :].argmax()) if len(inflected) else -1


def some_beats():
    random, made = np.random.default_rng(5), []
    for n in (20, 60, 300, 401):
        for k in range(40):
            x = np.cumsum(random.normal(size=n)) * 8 if k % 2 else np.exp(-(((np.arange(n) - n / 3) / (n / 12)) ** 2)) * 40 + random.normal(size=n) * (k % 3)
            x = np.round(x) if k % 7 == 0 else x
            x[3:9] = np.nan if k % 11 == 0 else x[3:9]
            made.append(np.full(n, 4.0) if k == 13 else x)
    return made


def test_beats_made_together_are_those_made_alone():
    made = some_beats()
    turned = [(None, True, False)[k % 3] for k in range(len(made))]
    for gate in (True, False):
        found, reasons = beats.extract_all(made, turned, gate=gate)
        for x, down, row, why in zip(made, turned, found, reasons):
            alone, reason = beats.extract(x, down, gate=gate)
            assert why == reason and (np.isnan(row).all() if alone is None else list(alone.values()) == row.tolist())
            assert not gate or why in ("flat", kernels.quality_gate(x))
    few = ("ptt_peak_to_foot", "reflection_index")
    assert np.array_equal(beats.extract_all(made, turned, features=few)[0], beats.extract_all(made, turned)[0][:, [beats.FEATURES.index(f) for f in few]], equal_nan=True)


def test_landmarks_are_those_of_plain_kernels():
    for n in (60, 300, 401):
        y = np.stack([(x - x.min()) / np.ptp(x) for x in map(kernels.bridged, some_beats()) if len(x) == n and np.ptp(x) > 0])
        peak = beats.systolic_peaks(y)
        assert peak.tolist() == [plain_peak(x) for x in y]
        assert beats.pulse_feet(y, peak).tolist() == [plain_foot(x, p) for x, p in zip(y, peak.tolist())]
        assert beats.dicrotic_notches(y, peak).tolist() == [plain_notch(x, p) for x, p in zip(y, peak.tolist())]


def test_spans_move_once_to_their_chunks(spark):
    source = fx.wave_source(spark, SF)
    spans = joins.rr_intervals(detect_r_peaks(source))
    plan = recordings.cut_beats(source, spans, "ppg")._jdf.queryExecution().executedPlan().toString()
    assert "user_id" not in plan, "the events are put in order once, not for each use of the chunks"
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ENSURE_REQUIREMENTS" in line]
    assert moved and not any("chunk_id" in line or "start_sample" in line for line in moved), moved


def test_polarity_of_a_source_is_that_of_a_table_and_its_signal_is_not_written(spark, tmp_path):
    source, table = fx.wave_source(spark, SF), fx.waves(spark, SF)
    peaks = detect_r_peaks(source).where("caseid % 3 > 0").cache()  # the others vote by windows, which cross chunks
    folders = [f"file://{tmp_path}/{name}" for name in ("source", "table")]
    made, want = ({r.caseid: r.inverted for r in recordings.detect_polarity(chunks, peaks, stages=Stages(spark, folder)).collect()} for chunks, folder in zip((source, table), folders))
    assert made == want and {c: c % 4 == 3 for c in made} == made and len(made) > 5
    assert not Stages(spark, folders[0]).done("steady") and Stages(spark, folders[1]).done("steady")
    peaks.unpersist()


def test_band_filter_is_the_sum_of_its_scales_and_its_gain_is_made_once():
    kernels._morlet_gain.cache_clear()
    x, (low, high), fs, size = np.cumsum(np.random.default_rng(4).normal(size=700)), (0.5, 2.0), kernels.FS, 2048
    made = [kernels.morlet_band(x, low, high) for _ in range(4)]
    assert kernels._morlet_gain.cache_info().misses == 1  # the chunks of a recording share their heart rate
    f, spectrum = np.fft.fftfreq(size, 1 / fs), np.fft.fft(x, size)
    each = [np.fft.ifft(spectrum * np.sqrt(fs / c) * np.exp(-(np.pi**2) * 1.5 * (f / c - 1) ** 2)).real for c in np.linspace(low, high, 32)]
    assert np.allclose(made[0], sum(each)[:700], atol=1e-9 * np.abs(sum(each)).max())
