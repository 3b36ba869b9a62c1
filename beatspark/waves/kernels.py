"""Small NumPy kernels on one signal. `fs` is the sampling rate in Hz."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

FS = 500


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places of strict local maxima; a flat top counts at its middle (rounded down), an edge never."""
    change = np.flatnonzero(np.diff(x))
    if len(change) < 2:
        return np.zeros(0, dtype=int)
    step = np.sign(x[change + 1] - x[change])
    top = np.flatnonzero((step[:-1] > 0) & (step[1:] < 0))
    return (change[top] + 1 + change[top + 1]) // 2


def prominence(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """Height over the higher of the two lowest points on the way to higher ground (or the end)."""
    out = np.zeros(len(peaks))
    for k, p in enumerate(peaks):
        higher = np.flatnonzero(x > x[p])
        left, right = higher[higher < p], higher[higher > p]
        lo, hi = (left[-1] + 1 if len(left) else 0), (right[0] if len(right) else len(x))
        out[k] = x[p] - max(x[lo : p + 1].min(), x[p:hi].min())
    return out


def find_peaks(x: np.ndarray, height: float | None = None, distance: int | None = None, least: float | None = None) -> np.ndarray:
    """Local maxima, then by height, by distance (the higher peak stays) and by prominence."""
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and len(peaks) > 1:
        stays = np.ones(len(peaks), dtype=bool)
        first, last = np.searchsorted(peaks, peaks - distance, "right"), np.searchsorted(peaks, peaks + distance, "left")
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if stays[k]:
                stays[first[k] : last[k]] = False
                stays[k] = True
        peaks = peaks[stays]
    if least is not None:
        peaks = peaks[prominence(x, peaks) >= least]
    return peaks


def trailing(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum of the last `size` values, fewer at the start."""
    total = np.concatenate(([0.0], np.cumsum(x)))
    at = np.arange(1, len(x) + 1)
    lo = np.maximum(at - size, 0)
    # a window reaches over the end of one block and the beginning of the next: running maxima of both
    blocks = np.concatenate((np.full(size - 1, -np.inf), x, np.full(-(len(x) + size - 1) % size, -np.inf))).reshape(-1, size)
    begun, left = np.maximum.accumulate(blocks, axis=1).ravel(), np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (total[at] - total[lo]) / (at - lo), np.maximum(left[: len(x)], begun[size - 1 : size - 1 + len(x)])


def bridged(x: np.ndarray) -> np.ndarray:
    """A signal with its missing samples on a line between their neighbours; zeros where there are none."""
    fine = np.isfinite(x)
    if fine.all():
        return x
    return np.interp(np.arange(len(x)), np.flatnonzero(fine), x[fine]) if fine.any() else np.zeros(len(x))


def r_peaks(ecg: np.ndarray, fs: int = FS) -> np.ndarray:
    """Peaks of the absolute slope, a quarter of a second apart, above a threshold of the last two seconds."""
    if len(ecg) < 2:
        return np.zeros(0, dtype=int)
    slope = np.abs(np.diff(ecg, prepend=ecg[0]))
    mean, most = trailing(slope, 2 * fs)
    peaks = find_peaks(slope, distance=fs // 4)
    peaks = peaks[slope[peaks] > (0.4 * mean + 0.15 * most)[peaks]]
    return peaks if len(peaks) > 1 else np.zeros(0, dtype=int)


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """Fourier resampling to n points; the shared highest frequency is halved or doubled."""
    m = len(x)
    spectrum, out = np.fft.rfft(x), np.zeros(n // 2 + 1, dtype=complex)
    k = min(m, n)
    out[: k // 2 + 1] = spectrum[: k // 2 + 1]
    if k % 2 == 0 and m != n:
        out[k // 2] *= 0.5 if n > m else 2
    return np.fft.irfft(out, n) * n / m


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, cut off at four sigma, the signal mirrored at its ends."""
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, reach, mode="symmetric"), weights / weights.sum(), mode="valid")


def remove_spikes(x: np.ndarray, limit: float = 5.0) -> np.ndarray:
    """Values beyond `limit` scaled median deviations are drawn from their neighbours by a line. Missing values stay as
    they are and count for nothing; with fewer than ten others, or no deviation, nothing is changed.
    """
    fine = np.isfinite(x)
    if fine.sum() < 10:
        return x.copy()
    away = np.abs(x - np.median(x[fine]))
    scale = 1.4826 * np.median(away[fine])
    bad = fine & (away > limit * scale) if scale >= 1.4826e-6 else np.zeros(len(x), dtype=bool)
    good = np.flatnonzero(fine & ~bad)
    if not bad.any() or len(good) < 2:
        return x.copy()
    out = x.copy()
    out[bad] = np.interp(np.flatnonzero(bad), good, x[good])
    return out


@lru_cache(maxsize=64)
def _gain(low: float, high: float | None, order: int, fs: int, size: int) -> np.ndarray:
    """Squared gain of a Butterworth filter on the spectrum of `size` samples."""
    # frequencies as the bilinear transform bends them
    bent = np.tan(np.pi * np.fft.rfftfreq(size, 1 / fs)[:-1] / fs)
    edge = np.tan(np.pi * low / fs)
    gain = np.zeros(size // 2 + 1)
    if high is None:
        gain[1:-1], gain[-1] = 1 / (1 + (edge / bent[1:]) ** (2 * order)), 1
    else:
        top = np.tan(np.pi * high / fs)
        gain[1:-1] = 1 / (1 + ((bent[1:] ** 2 - edge * top) / ((top - edge) * bent[1:])) ** (2 * order))
    return gain


def zero_phase(x: np.ndarray, low: float, high: float | None, order: int, fs: int = FS) -> np.ndarray:
    """A Butterworth high-pass (`high` None) or band-pass run forwards and backwards, as the square of its gain on the
    spectrum. The signal is continued at both ends by its point reflection, so that the ends do not ring.
    """
    n = len(x)
    if n < 2:
        return x.copy()
    pad = min(n - 1, 10 * fs)
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    size = 1 << len(wide).bit_length()
    wide = np.concatenate((wide, np.linspace(wide[-1], wide[0], size - len(wide))))
    return np.fft.irfft(np.fft.rfft(wide) * _gain(low, high, order, fs, size), size)[pad : pad + n]


def bandpass(x: np.ndarray, fs: int = FS, despike: bool = True) -> np.ndarray:
    """0.5 to 10 Hz, spikes taken out first; missing values become the mean. Signals under 20 samples stay as they are."""
    if len(x) < 20:
        return x.copy()
    x = np.where(np.isfinite(x), x, np.nanmean(x)) if np.isfinite(x).any() else np.zeros(len(x))
    return zero_phase(remove_spikes(x, 4.0) if despike else x, 0.5, min(10.0, 0.45 * fs), 4, fs)


def energy_r_peaks(ecg: np.ndarray, fs: int = FS) -> np.ndarray:
    """R-peaks by energy from 5 to 15 Hz: half a second apart, above 30 % of its 95th percentile."""
    energy = zero_phase(bridged(ecg), 5, 15, 2, fs) ** 2
    return find_peaks(energy, height=0.3 * np.percentile(energy, 95), distance=fs // 2)


def adaptive_peaks(x: np.ndarray, fs: int = FS) -> np.ndarray:
    """Peaks half a spread above the mean, 0.4 s apart, that stand out by 0.3 of the spread."""
    x = bridged(x)
    if len(x) < 10 or x.std() < 1e-6:
        return np.zeros(0, dtype=int)
    return find_peaks(x, height=x.mean() + 0.5 * x.std(), distance=max(int(0.4 * fs), 1), least=0.3 * x.std())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Absolute correlation of two segments, the longer one resampled to the shorter; 0 where one is flat."""
    n = min(len(a), len(b))
    a, b = (x if len(x) == n else resample(x, n) for x in (a, b))
    if n < 2 or a.std() < 1e-6 or b.std() < 1e-6:
        return 0.0
    return float(abs(((a - a.mean()) * (b - b.mean())).mean() / (a.std() * b.std())))


def welch_powers(x: np.ndarray, fs: int = FS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`welch_power` of each row of a table."""
    n = min(x.shape[1], 256)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = np.stack([x[:, a : a + n] for a in range(0, x.shape[1] - n + 1, max(1, n // 2))], axis=1)
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * window, axis=2)) ** 2 / (fs * (window**2).sum())
    power[:, :, 1 : (-1 if n % 2 == 0 else None)] *= 2
    density, f = power.mean(axis=1), np.fft.rfftfreq(n, 1 / fs)
    cardiac, low = density[:, (f >= 0.5) & (f <= 4)].sum(axis=1), density[:, f < 0.5].sum(axis=1)
    return cardiac, low, cardiac / (low + 1e-9)


def welch_power(x: np.ndarray, fs: int = FS) -> tuple[float, float, float]:
    """Power from 0.5 to 4 Hz, below 0.5 Hz, and their ratio (Hann, half overlap, means taken off)."""
    return tuple(float(power[0]) for power in welch_powers(np.asarray(x)[None], fs))


def morlet_band(x: np.ndarray, low: float, high: float, fs: int = FS, scales: int = 32, bandwidth: float = 1.5) -> np.ndarray:
    """Sum of the real parts of a complex Morlet transform over frequencies from low to high: one transform back, as the sum
    of the spectra has the sum of the gains."""
    size = 1 << (2 * len(x) - 1).bit_length()
    held, last = _morlet_gain(float(low), float(high), fs, scales, bandwidth, size)
    spectrum = np.fft.rfft(x, size)
    spectrum[: len(held)] *= held
    spectrum[len(held) : -1] = 0
    spectrum[-1] *= last
    return np.fft.irfft(spectrum, size)[: len(x)]


@lru_cache(maxsize=256)
def _morlet_gain(low: float, high: float, fs: int, scales: int, bandwidth: float, size: int) -> tuple[np.ndarray, float]:
    """The gain on the lowest frequencies of a spectrum of `size` samples, which is zero behind them, and that on the highest."""
    f = np.fft.rfftfreq(size, 1 / fs)
    # beyond these a gain is less than the smallest double, for each centre
    reach = np.sqrt(745.2 / (np.pi**2 * bandwidth))
    above, below = (min(np.searchsorted(f, high * (reach + k), "right"), len(f) - 1) for k in (1, -1))
    centre = np.linspace(low, high, scales)[:, None]
    gains = lambda at: (np.sqrt(fs / centre) * np.exp(-(np.pi**2) * bandwidth * (at / centre - 1) ** 2)).sum(axis=0)
    # the real part of a signal's transform has the mean of the gains at f and -f
    held = gains(f[:above])
    held[:below] += gains(-f[:below])
    return held / 2, float(gains(-f[-1:])[0])


def quality_gate(x: np.ndarray, snr: float = 5.0) -> str:
    """Why a pulse segment is not usable; empty where it is (the same rules as `functions.arrays.segment_quality`)."""
    fine = x[np.isfinite(x)]
    if len(x) < 20 or len(fine) < 20:
        return "too_short" if len(x) < 20 else "few_valid" if len(fine) else "all_null"
    spread, reach = fine.std(), np.ptp(fine)
    if reach < 1e-6 or spread < 3:
        return "flat" if reach < 1e-6 else "low_amplitude"
    if len(np.unique(fine)) < 5:
        return "saturated"
    noise, floor = np.diff(fine, 2).std() / 2, np.diff(fine).std() / np.sqrt(2)
    if noise > 0.01 and spread < snr * noise:
        return "low_snr"
    return "weak_pulse" if floor > 0.01 and reach < 3 * floor else ""


def quality_gates(x: np.ndarray, snr: float = 5.0) -> list[str]:
    """`quality_gate` of each row of a table. Rows with a missing sample, or few values at their start, are looked at by themselves."""
    if x.shape[1] < 20:
        return [quality_gate(row, snr) for row in x]
    ahead = np.sort(x[:, :16], axis=1)
    plain = np.isfinite(x).all(axis=1) & ((ahead[:, 1:] != ahead[:, :-1]).sum(axis=1) >= 4)
    with np.errstate(invalid="ignore"):
        spread, reach = x.std(axis=1), np.ptp(x, axis=1)
        noise, floor = np.diff(x, 2, axis=1).std(axis=1) / 2, np.diff(x, axis=1).std(axis=1) / np.sqrt(2)
    rules = [reach < 1e-6, spread < 3, (noise > 0.01) & (spread < snr * noise), (floor > 0.01) & (reach < 3 * floor)]
    found = np.select(rules, ["flat", "low_amplitude", "low_snr", "weak_pulse"], "").tolist()
    return [why if alone else quality_gate(row, snr) for why, alone, row in zip(found, plain, x)]


def filter_band(hr: float, kind: str, fs: int = FS) -> tuple[float, float]:
    """Frequencies that the band filter keeps for a heart rate: multiples of it, inside what can be told."""
    # Multiples of the heart rate, and the band where these leave nothing.
    low, high, otherwise = (0.5, 2.0, (0.5, 40.0)) if kind == "ecg" else (0.15, 0.7, (0.5, 10.0))
    low, high = max(0.5, low * hr / 60), min(fs / 2.1, high * hr / 60)
    return (low, high) if low < high else otherwise


def best_lag(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Samples by which b follows a, by cross-correlation of the z-scores, within `most`."""
    n = min(len(a), len(b))
    a, b = (a[:n] - a[:n].mean()) / (a[:n].std() + 1e-9), (b[:n] - b[:n].mean()) / (b[:n].std() + 1e-9)
    size = 1 << (2 * n - 1).bit_length()
    cross = np.fft.irfft(np.fft.rfft(b, size) * np.conj(np.fft.rfft(a, size)), size)
    lags = np.arange(-most, most + 1)
    return int(lags[np.argmax(cross[lags])])
