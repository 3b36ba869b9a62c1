"""Beat waveforms as arrays of doubles: built-in array functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, also where `then` uses it inside an array function."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def minmax_normalise(a: Column) -> Column:
    """Scaled to 0..1; NULL where it is flat."""
    ends = F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi"))
    return let(ends, lambda e: F.when(e["hi"] > e["lo"], F.transform(a, lambda x: (x - e["lo"]) / (e["hi"] - e["lo"]))))


def mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def pop_std(a: Column) -> Column:
    return let(mean(a), lambda m: F.sqrt(_sum(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a)))


def diff(a: Column) -> Column:
    """Differences of neighbours; one shorter."""
    return F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda x, y: x - y)


def derivatives(a: Column, fs: float = 500.0) -> Column:
    """Struct of the extremes of the first and second derivative, and the slope ratio."""
    d = F.transform(diff(a), lambda x: x * fs)
    dd = F.transform(diff(diff(a)), lambda x: x * fs * fs)
    return F.struct(
        F.array_max(d).alias("max_upslope"), F.array_min(d).alias("max_downslope"), F.abs(F.array_min(d) / (F.array_max(d) + 1e-6)).alias("slope_ratio"),
        F.array_max(dd).alias("max_acceleration"), F.array_min(dd).alias("min_acceleration"))


def trapezoid(a: Column) -> Column:
    return _sum(F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda x, y: (x + y) / 2))


def area_ratio(a: Column) -> Column:
    """Area up to the (first) peak over the whole area; 0.5 where the whole is not positive."""
    peak = F.array_position(a, F.array_max(a)).cast("int")
    return F.when(trapezoid(a) > 0, F.when(peak > 1, trapezoid(F.slice(a, 1, peak))).otherwise(0.0) / trapezoid(a)).otherwise(0.5)


def max_slope(a: Column) -> Column:
    """Place (from 0) of the steepest rise up to the peak."""
    peak = F.array_position(a, F.array_max(a)).cast("int")
    d = F.slice(diff(a), 1, F.greatest(peak - 1, F.lit(1)))
    return F.array_position(d, F.array_max(d)) - 1


def template_corr(a: Column, b: Column) -> Column:
    """Mean product of both z-scores."""
    seen = F.struct(mean(a).alias("ma"), mean(b).alias("mb"), (pop_std(a) + 1e-6).alias("sa"), (pop_std(b) + 1e-6).alias("sb"))
    return let(seen, lambda s: _sum(F.zip_with(a, b, lambda x, y: (x - s["ma"]) / s["sa"] * ((y - s["mb"]) / s["sb"]))) / F.size(a))


def trend_label(now: Column, later: Column, limit: float = 5.0) -> Column:
    return F.when(later - now < -limit, 0).when(later - now > limit, 2).when((later - now).isNotNull(), 1)


def pulse_width_50(a: Column, fs: float = 500.0) -> Column:
    """Milliseconds from the first rise through half height to the first fall after it; 0 where one is missing."""
    return let(minmax_normalise(a), lambda n: _half_width(n, fs))


def _half_width(n: Column, fs: float) -> Column:
    steps = F.transform(F.slice(n, 1, F.size(n) - 1), lambda x, i: F.struct((i + 1).alias("k"), (x < 0.5).alias("low"), (F.get(n, i + 1) >= 0.5).alias("high")))
    rises, falls = F.filter(steps, lambda s: s["low"] & s["high"]), F.filter(steps, lambda s: ~s["low"] & ~s["high"])
    rise = F.get(rises, F.lit(0))["k"]
    fall = F.get(falls, F.lit(0))["k"]
    return F.coalesce(F.when(fall > rise, (fall - rise) * 1000.0 / fs), F.lit(0.0))


def skewness(a: Column) -> Column:
    """Third standardised moment (population); NULL for constant arrays."""
    third = let(mean(a), lambda m: _sum(F.transform(a, lambda x: (x - m) * (x - m) * (x - m))) / F.size(a))
    return F.try_divide(third, F.pow(pop_std(a), F.lit(3)))


def excess_kurtosis(a: Column) -> Column:
    """Fourth standardised moment (population), less 3; NULL for constant arrays."""
    fourth = let(mean(a), lambda m: _sum(F.transform(a, lambda x: (x - m) * (x - m) * (x - m) * (x - m))) / F.size(a))
    return F.try_divide(fourth, F.pow(pop_std(a), F.lit(4))) - 3


# Least samples, spread, distinct values and signal-to-noise ratio of a usable segment.
LEAST_SAMPLES, LEAST_STD, LEAST_DISTINCT, LEAST_SNR = 20, 3.0, 5, 5.0


def segment_quality(a: Column, snr: float = LEAST_SNR) -> Column:
    """Why a pulse segment is not usable; empty where it is. Missing samples are left out of all statistics.

    Noise is the spread of second differences, halved, and for the pulse that of first differences, over the root of 2;
    noise up to 0.01 counts as none.
    """
    v = F.filter(a, lambda x: x.isNotNull())
    reach, noise, floor = F.array_max(v) - F.array_min(v), pop_std(diff(diff(v))) / 2, pop_std(diff(v)) / 2**0.5
    return (
        F.when(F.size(a) < LEAST_SAMPLES, "too_short").when(F.size(v) == 0, "all_null").when(F.size(v) < LEAST_SAMPLES, "few_valid").when(reach < 1e-6, "flat")
        .when(pop_std(v) < LEAST_STD, "low_amplitude").when(F.size(F.array_distinct(v)) < LEAST_DISTINCT, "saturated")
        .when((noise > 0.01) & (pop_std(v) < snr * noise), "low_snr").when((floor > 0.01) & (reach < 3 * floor), "weak_pulse").otherwise("")
    )
