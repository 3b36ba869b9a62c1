"""Landmarks and features of pulse beats, each from its R-peak to the next. Beats of one length are the rows of a table, and
NumPy works on whole tables. All places are samples from the R-peak.

Each landmark has one definition on the signal and one substitute where the signal has no such place:

* systolic peak: the most prominent maximum of the search range, else its highest place;
* foot: where the tangent of the steepest rise before the peak meets the level of the lowest place before it, else that
  lowest place;
* dicrotic notch: the first valley behind the peak, else the strongest upward bend behind the first inflection, else none;
* amplitude ratio: the fall from peak to notch over the rise from foot to peak; without a clear notch, the fall in as long
  a time as the rise took.
"""

from __future__ import annotations

import numpy as np

from .kernels import FS, bridged, quality_gates, welch_powers

# Search ranges in ms from the R-peak (the peak's and the foot's) or from the peak (the notch's), the parts
# of a beat that bound them, and ratios that count as clear, or that a substitute is held to.
PEAK_RANGE_MS, PEAK_PART = (80, 600), 0.7
FOOT_FROM_MS, FOOT_BEFORE_PEAK_MS = 20, 10
NOTCH_RANGE_MS, NOTCH_PART = (30, 350), 0.8
RATIO_LIMITS, RATIO_CLEAR = (0.15, 0.85), (0.05, 0.95)
SYSTOLIC_SHARE, DIASTOLIC_SHARE = 0.35, 0.65
# Fixed values of the polarity: length of a window of slopes, how many are looked at and have to be there, and the share of
# votes that turns a recording round.
WINDOW_MS, WINDOWS, LEAST_WINDOWS, INVERTED_SHARE = 800, 50, 3, 0.6
#: Widths (in samples) that slopes and bends are smoothed with.
SLOPE_WIDTH, BEND_WIDTH = 3.0, 4.0
#: Least height of a maximum above its surroundings, of a valley below them, and of a rise, in parts of the beat's height.
CLEAR_PEAK, CLEAR_VALLEY, CLEAR_RISE = 0.02, 0.005, 0.01

#: Features of a beat, in the order of the output.
FEATURES = (
    "pat_ecg_ppg", "pat_to_peak", "pat_to_maxslope", "ptt_peak_to_peak", "ptt_peak_to_foot", "ptt_peak_to_maxslope", "time_to_maxslope_t1",
    "amplitude_ratio_ra", "systolic_duration_tsd", "diastolic_duration_tfd", "max_upslope", "max_downslope", "slope_ratio", "max_acceleration", "min_acceleration",
    "systolic_area_ratio", "pulse_width_50", "crest_time", "reflection_index", "stat_mean", "stat_std", "stat_skew", "stat_kurtosis", "stat_power_cardiac", "stat_power_low", "stat_power_ratio",
)


def _samples(ms: float, fs: int) -> int:
    return int(ms / 1000 * fs)


def _bounded(x: np.ndarray, first, last, other: float) -> np.ndarray:
    """The rows of a table, with `other` outside the places from each row's `first` up to its `last`."""
    at = np.arange(x.shape[1])
    return np.where((at >= np.reshape(first, (-1, 1))) & (at < np.reshape(last, (-1, 1))), x, other)


def _maxima(x: np.ndarray, first, last) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each maximum (`kernels.local_maxima`) of the rows, taken from each row's `first` up to its `last`."""
    step = np.diff(x, axis=1)
    row, at = np.nonzero(step)
    step = step[row, at]
    top = np.flatnonzero((step[:-1] > 0) & (step[1:] < 0) & (row[:-1] == row[1:]))
    row, rise, fall = row[top], at[top], at[top + 1]
    first, last = np.broadcast_to(first, len(x)), np.broadcast_to(last, len(x))
    held = (rise >= first[row]) & (fall + 1 < last[row])
    return row[held], ((rise + 1 + fall) // 2)[held]


def _prominences(x: np.ndarray, row: np.ndarray, peak: np.ndarray, first, last) -> np.ndarray:
    """`kernels.prominence` of maxima of rows, taken from each row's `first` up to its `last`."""
    out, at = np.zeros(len(row)), np.arange(x.shape[1])
    first, last = np.broadcast_to(first, len(x)), np.broadcast_to(last, len(x))
    for k in range(0, len(row), 2048):
        r, p = row[k : k + 2048], peak[k : k + 2048, None]
        lo, hi = first[r].min(), last[r].max()
        there, place = x[r, lo:hi], at[lo:hi]
        top = np.take_along_axis(there, p - lo, axis=1)
        higher, before = there > top, place < p
        left = np.where(higher & before, place + 1, first[r, None]).max(axis=1, initial=0)
        right = np.where(higher & ~before, place, last[r, None]).min(axis=1, initial=x.shape[1])
        low = np.where(before & (place >= left[:, None]), there, top).min(axis=1)
        high = np.where(~before & (place < right[:, None]), there, top).min(axis=1)
        out[k : k + 2048] = top[:, 0] - np.maximum(low, high)
    return out


def _smooth(y: np.ndarray, sigma: float) -> np.ndarray:
    """`kernels.smooth` of rows: one convolution of all, mirrored at their ends."""
    reach = int(4 * sigma + 0.5)
    wide = np.pad(y, ((0, 0), (reach, reach)), mode="symmetric")
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    made = np.convolve(wide.ravel(), weights / weights.sum(), mode="valid")
    return np.concatenate((made, np.zeros(2 * reach))).reshape(wide.shape)[:, : y.shape[1]]


def _without_spikes(y: np.ndarray, limit: float) -> np.ndarray:
    """`kernels.remove_spikes` of rows without missing values."""
    m, n = y.shape
    if n < 10:
        return y
    away = np.abs(y - np.median(y, axis=1, keepdims=True))
    scale = 1.4826 * np.median(away, axis=1, keepdims=True)
    good = (away <= limit * scale) | (scale < 1.4826e-6)
    mended = np.flatnonzero(~good.all(axis=1) & (good.sum(axis=1) >= 2))
    if not len(mended):
        return y
    good, values, rows = good[mended], y[mended], np.arange(len(mended))
    # a row's ends have the value of its first and last good place, so that one line runs through all rows
    first, last = good.argmax(axis=1), n - 1 - good[:, ::-1].argmax(axis=1)
    values[:, 0], values[:, -1] = values[rows, first], values[rows, last]
    held = good.copy()
    held[:, 0] = held[:, -1] = True
    drawn = np.interp(np.flatnonzero(~good), np.flatnonzero(held), values[held])
    out = y.copy()
    part = out[mended]
    part[~good] = drawn
    out[mended] = part
    return out


def systolic_peaks(y: np.ndarray, fs: int = FS) -> np.ndarray:
    """The systolic peak of each scaled beat (a row of the table)."""
    n = y.shape[1]
    first = min(_samples(PEAK_RANGE_MS[0], fs), n // 4)
    last = max(first + 1, min(_samples(PEAK_RANGE_MS[1], fs), int(PEAK_PART * n)))
    out = first + y[:, first:last].argmax(axis=1)
    row, peak = _maxima(y, first, last)
    clear = _prominences(y, row, peak, first, last)
    row, peak, clear = row[clear >= CLEAR_PEAK], peak[clear >= CLEAR_PEAK], clear[clear >= CLEAR_PEAK]
    # the most prominent one of each row, of equal ones the first
    order = np.lexsort((peak, -clear, row))
    found, at = np.unique(row[order], return_index=True)
    out[found] = peak[order][at]
    return out


def pulse_feet(y: np.ndarray, peak: np.ndarray, fs: int = FS) -> np.ndarray:
    """The foot of each scaled beat with its peak, by intersecting tangents."""
    rows = np.arange(len(y))
    last = np.maximum(peak - _samples(FOOT_BEFORE_PEAK_MS, fs), 0)
    first = np.minimum(_samples(FOOT_FROM_MS, fs), last)
    calm = _smooth(_without_spikes(y, 4.0), SLOPE_WIDTH)
    rise = _bounded(np.gradient(calm, axis=1), first, peak + 1, -np.inf)
    steepest = rise.argmax(axis=1)
    rise = np.where(peak > first, rise[rows, steepest], 0.0)
    lowest = _bounded(calm, first, steepest + 1, np.inf).argmin(axis=1)
    height = calm[rows, steepest] - calm[rows, lowest]
    clear = (rise > 0) & (height >= CLEAR_RISE)
    meets = np.rint(steepest - height / np.where(clear, rise, 1.0))
    tangents = np.clip(meets, np.maximum(first, lowest), last).astype(int)
    return np.where(clear, tangents, _bounded(calm, first, last + 1, np.inf).argmin(axis=1))


def dicrotic_notches(y: np.ndarray, peak: np.ndarray, fs: int = FS) -> np.ndarray:
    """The notch behind the systolic peak of each scaled beat; -1 where the beat is too short or falls without a bend."""
    m, n = y.shape
    last = peak + np.minimum(_samples(NOTCH_RANGE_MS[1], fs), (NOTCH_PART * (n - peak)).astype(int))
    first = peak + _samples(NOTCH_RANGE_MS[0], fs)
    long = last - first >= 5
    calm = _smooth(y, BEND_WIDTH)
    row, valley = _maxima(-calm, first, last)
    row, valley = row[long[row]], valley[long[row]]
    clear = _prominences(-calm, row, valley, first, last) >= CLEAR_VALLEY
    out = np.full(m, -1)
    found, at = np.unique(row[clear], return_index=True)
    out[found] = valley[clear][at]
    rest = np.flatnonzero(long & (out < 0))
    if len(rest):
        bend, start, end = np.gradient(np.gradient(calm[rest], axis=1), axis=1), peak[rest], last[rest]
        inflected = _bounded((bend[:, :-1] <= 0) & (bend[:, 1:] > 0), start, end - 1, False).astype(bool)
        behind = inflected.argmax(axis=1) + 1
        out[rest] = np.where(inflected.any(axis=1), _bounded(bend, behind, end, -np.inf).argmax(axis=1), -1)
    return out


def amplitude_ratio(y: np.ndarray, peak: int, foot: int, notch: int) -> float:
    """How much of its rise a scaled beat falls back by its notch."""
    height = y[peak] - y[foot]
    if notch >= 0 and height > CLEAR_RISE:
        ratio = (y[peak] - y[notch]) / height
        if RATIO_CLEAR[0] <= ratio <= RATIO_CLEAR[1]:
            return float(ratio)
    mirrored = min(2 * peak - foot, len(y) - 1)
    # a beat without a rise is taken by the share of its area that lies behind its peak
    ratio = (y[peak] - y[mirrored]) / height if height > CLEAR_RISE else y[peak:].sum() / max(y.sum(), CLEAR_RISE)
    return float(np.clip(ratio, *RATIO_LIMITS))


def _half_widths(y: np.ndarray, fs: int) -> np.ndarray:
    high = y > 0.5
    rises, falls = ~high[:, :-1] & high[:, 1:], high[:, :-1] & ~high[:, 1:]
    rise, fall = rises.argmax(axis=1), falls.argmax(axis=1)
    return np.where(rises.any(axis=1) & falls.any(axis=1) & (rise < fall), (fall - rise) / fs * 1000, 0.0)


def _reflections(y: np.ndarray, peak: np.ndarray, notch: np.ndarray) -> np.ndarray:
    """Height of the first maximum behind the notch over that of the peak; 0 where there is none."""
    m, n = y.shape
    out, top = np.zeros(m), y[np.arange(m), peak]
    row, later = _maxima(y, np.maximum(notch, 0), n)
    row, at = np.unique(row, return_index=True)
    later = later[at]
    held = (notch[row] >= 0) & (n - notch[row] > 5) & (top[row] > 0)
    row, later = row[held], later[held]
    out[row] = y[row, later] / top[row]
    return out


def _areas(y: np.ndarray, peak: np.ndarray) -> np.ndarray:
    """The share of each beat's area that lies before its peak."""
    steps, out = (y[:, 1:] + y[:, :-1]) / 2.0, np.full(len(y), 0.5)
    for k, p in enumerate(peak.tolist()):
        before = steps[k, : max(p - 1, 0)].sum()
        whole = before + steps[k, p:].sum()
        if whole > 0:
            out[k] = before / whole
    return out


#: Features that are made by the same step.
_NOTCH = {"amplitude_ratio_ra", "systolic_duration_tsd", "diastolic_duration_tfd", "reflection_index"}
_FOOT = {"pat_ecg_ppg", "ptt_peak_to_foot", "time_to_maxslope_t1", "systolic_duration_tsd", "amplitude_ratio_ra"}
_RISE = {"pat_to_maxslope", "ptt_peak_to_maxslope", "time_to_maxslope_t1"}
_SLOPE = {"max_upslope", "max_downslope", "slope_ratio", "max_acceleration", "min_acceleration"}
_SHAPE = {"stat_mean", "stat_std", "stat_skew", "stat_kurtosis"}
_POWER = {"stat_power_cardiac", "stat_power_low", "stat_power_ratio"}


def _features(beat: np.ndarray, y: np.ndarray, fs: int, wanted: set[str]) -> dict[str, np.ndarray]:
    """The wanted features of beats of one length (rows of a table), and of others that are made on the way; `y`: scaled."""
    m, n = y.shape
    ms = lambda samples: np.asarray(samples, dtype=float) / fs * 1000
    peak = systolic_peaks(y, fs)
    out = {name: ms(peak) for name in ("pat_to_peak", "ptt_peak_to_peak", "crest_time")}
    foot = pulse_feet(y, peak, fs) if wanted & _FOOT else None
    notch = dicrotic_notches(y, peak, fs) if wanted & _NOTCH else None
    if foot is not None:
        out |= {"pat_ecg_ppg": ms(foot), "ptt_peak_to_foot": ms(foot)}
    if wanted & _RISE:
        steepest = np.where(peak >= 2, _bounded(np.diff(y, axis=1), 0, np.maximum(peak, 1), -np.inf).argmax(axis=1), 0)
        out |= {"pat_to_maxslope": ms(steepest), "ptt_peak_to_maxslope": ms(steepest)}
        if foot is not None:
            out["time_to_maxslope_t1"] = np.maximum(0.0, ms(steepest - foot))
    if notch is not None:
        none = notch < 0
        out["diastolic_duration_tfd"] = np.where(none, ms(n) * DIASTOLIC_SHARE, ms(n - notch))
        if foot is not None:
            out["systolic_duration_tsd"] = np.where(none, ms(n) * SYSTOLIC_SHARE, np.maximum(0.0, ms(notch - foot)))
        if "amplitude_ratio_ra" in wanted:
            out["amplitude_ratio_ra"] = np.array([amplitude_ratio(*r) for r in zip(y, peak.tolist(), foot.tolist(), notch.tolist())])
        if "reflection_index" in wanted:
            out["reflection_index"] = _reflections(y, peak, notch)
    if wanted & _SLOPE:
        slope = np.diff(y, axis=1) * fs
        bend = np.diff(slope, axis=1) * fs
        up, down = slope.max(axis=1), slope.min(axis=1)
        out |= {"max_upslope": up, "max_downslope": down, "slope_ratio": np.abs(down / (up + 1e-6)), "max_acceleration": bend.max(axis=1), "min_acceleration": bend.min(axis=1)}
    if "systolic_area_ratio" in wanted:
        out["systolic_area_ratio"] = _areas(y, peak)
    if "pulse_width_50" in wanted:
        out["pulse_width_50"] = _half_widths(y, fs)
    if wanted & _SHAPE:
        mean, spread = beat.mean(axis=1), beat.std(axis=1)
        centred = beat - mean[:, None]
        square = centred * centred
        out |= {"stat_mean": mean, "stat_std": spread, "stat_skew": (square * centred).mean(axis=1) / spread**3, "stat_kurtosis": (square * square).mean(axis=1) / spread**4 - 3}
    if wanted & _POWER:
        out |= dict(zip(("stat_power_cardiac", "stat_power_low", "stat_power_ratio"), welch_powers(beat, fs) if n > 10 else np.zeros((3, m))))
    return out


def extract_all(beats: list[np.ndarray], inverted: list[bool | None], fs: int = FS, gate: bool = True, features: tuple[str, ...] = FEATURES) -> tuple[np.ndarray, list[str]]:
    """The features of beats, a row each (NaN where there are none), and why there are none. Beats of one length are made
    together, as tables.

    Without a known polarity, a beat that is higher in its first quarter than in its second counts as inverted. Missing
    samples that the gate lets pass lie on a line between their neighbours.
    """
    made, reasons, wanted = np.full((len(beats), len(features)), np.nan), [""] * len(beats), set(features)
    lengths = np.fromiter(map(len, beats), np.int64, len(beats))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = np.stack([beats[k] for k in at])
        if gate:
            why = quality_gates(rows)
            for k, reason in zip(at, why):
                reasons[k] = reason
            passed = np.array([not reason for reason in why])
            at, rows = at[passed], rows[passed]
        gaps = np.flatnonzero(~np.isfinite(rows).all(axis=1))
        for k in gaps:
            rows[k] = bridged(rows[k])
        if not len(at) or not n:
            continue
        quarters = rows[:, : n // 4], rows[:, n // 4 : n // 2]
        unknown = np.array([inverted[k] is None for k in at])
        down = np.array([bool(inverted[k]) for k in at])
        if unknown.any():
            down[unknown] = quarters[0][unknown].mean(axis=1) > quarters[1][unknown].mean(axis=1)
        y = np.where(down[:, None], -rows, rows)
        least, reach = y.min(axis=1, keepdims=True), np.ptp(y, axis=1)
        for k in at[reach < 1e-6]:
            reasons[k] = "flat"
        fine = reach >= 1e-6
        if fine.any():
            values = _features(rows[fine], (y[fine] - least[fine]) / reach[fine, None], fs, wanted)
            made[at[fine]] = np.stack([values[name] for name in features], axis=1)
    return made, reasons


def extract(beat: np.ndarray, inverted: bool | None = None, fs: int = FS, gate: bool = True) -> tuple[dict[str, float] | None, str]:
    """The features of one beat, or None and why there are none."""
    made, reasons = extract_all([np.asarray(beat, dtype=float)], [inverted], fs, gate)
    return (None, reasons[0]) if reasons[0] else (dict(zip(FEATURES, made[0].tolist())), "")


def polarity_vote(beat: np.ndarray, fs: int = FS) -> int:
    """1 if a (high-passed) beat of 600 ms from its R-peak looks inverted, 0 if upright, -1 if it says nothing. A pulse is a
    short way off a long level, so the side of the longer tail is the side that it points to.
    """
    away = beat - beat.mean()
    spread = away.std()
    if len(beat) < _samples(100, fs) or np.ptp(beat) < 0.01 or spread < 1e-9:
        return -1
    return int((away**3).mean() < 0)


def falls_first(window: np.ndarray) -> bool:
    """Whether a window of (high-passed) slopes has its steepest fall before its steepest rise, as inverted pulses do."""
    return bool(window.argmin() < window.argmax())


def polarity_by_slope(ppg: np.ndarray, fs: int = FS, most: int = WINDOWS) -> bool:
    """Whether a (high-passed) recording without R-peaks looks inverted: most of its first windows fall first."""
    size, slope = _samples(WINDOW_MS, fs), np.diff(ppg)
    votes = [falls_first(slope[k * size : (k + 1) * size]) for k in range(min(len(slope) // size, most))]
    return len(votes) >= LEAST_WINDOWS and sum(votes) > INVERTED_SHARE * len(votes)
