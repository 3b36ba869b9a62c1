"""Ordered operators on patients of very unequal size: the same answers whatever the ranges and blocks, and no window over a patient."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatspark.operators import evaluate, modelprep, ordered, quality, quantiles, stats

ORDER = ["timestamp", "cycle_index"]


@pytest.fixture(scope="module")
def beats(spark):
    """Patient 1 has a third of all rows; time stamps with ties, gaps and missing ones."""
    rng = np.random.default_rng(7)
    sizes = {1: 700, **{p: int(n) for p, n in zip(range(2, 30), rng.integers(1, 100, 28))}}
    rows = []
    for p, n in sizes.items():
        t = 0.0
        for k in range(n):
            t += float(rng.choice([0.0, 0.8, 0.9, 60.0], p=[0.05, 0.5, 0.4, 0.05]))
            y = None if rng.random() < 0.1 else float(rng.normal(120, 10))
            rows.append((p, f"s{p}", k, None if p == 2 and k < 5 else t, y, None if y is None else y / 2, float(rng.normal(200, 20)), float(rng.normal(70, 5))))
    return spark.createDataFrame(rows, "patient_id int, session_id string, cycle_index int, timestamp double, sbp_reference double, dbp_reference double, ptt_peak_to_foot double, hr_bpm double").cache()


@pytest.fixture(scope="module")
def plain(beats):
    frame = beats.toPandas().sort_values(["patient_id", *ORDER], na_position="first")
    return {p: g for p, g in frame.groupby("patient_id")}


def close(a, b):
    return (a is None or a != a) == (b is None or b != b) and (a is None or a != a or abs(a - b) < 1e-9)


def corr(x, y):
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    return float(np.corrcoef(x, y)[0, 1]) if len(x) > 1 and x.std() > 0 and y.std() > 0 else None


def test_ranks(beats, plain):
    for span in (3600.0, 30.0, 0.5):
        got = {(r.patient_id, r.cycle_index): (r.k, r.n) for r in ordered.ranked(beats, "patient_id", ORDER, span).collect()}
        assert got == {(p, c): (k, len(g)) for p, g in plain.items() for k, c in enumerate(g["cycle_index"])}


def test_running_averages(beats, plain):
    for span in (3600.0, 20.0, 1.0):
        base = {(r.patient_id, r.cycle_index, r.alpha): r.sbp_pred for r in evaluate.ema_baseline(beats, (0.1, 0.3), span).collect()}
        warm = {(r.patient_id, r.cycle_index): r.sbp_pred for r in evaluate.ema_warmup(beats, 0.2, 25, span).collect()}
        assert len(base) == 2 * sum(map(len, plain.values())) and len(warm) == sum(max(0, len(g) - 25) for g in plain.values())
        for p, g in plain.items():
            y, c = g["sbp_reference"].to_numpy(), g["cycle_index"].to_numpy()
            for a in (0.1, 0.3):
                e = None
                for v, i in zip(y, c):
                    assert close(base[p, i, a], v if e is None else e)
                    e = (None if v != v else v) if e is None else e if v != v else a * v + (1 - a) * e
            head = y[:25][~np.isnan(y[:25])]
            e = head.mean() if len(head) else None
            for v, i in zip(y[25:], c[25:]):
                assert close(warm[p, i], e)
                e = e if v != v or e is None else 0.2 * v + 0.8 * e


def test_correlations_along_patients(beats, plain):
    for span, block in ((3600.0, 4096), (30.0, 20)):
        got = {r.lag: (r.autocorr, r.n_patients) for r in stats.autocorrelation(beats, lags=(1, 5, 20), span=span, block=block).collect()}
        for lag, (mean, n) in got.items():
            each = [corr(g["sbp_reference"].to_numpy()[lag:], g["sbp_reference"].to_numpy()[:-lag]) for g in plain.values() if len(g) > lag + 10]
            each = [r for r in each if r is not None]
            assert n == len(each) and close(mean, float(np.mean(each)))
        quarters = {r.patient_id: (r.q1, r.q4) for r in stats.quarter_correlation(beats, 80, span).collect()}
        assert set(quarters) == {p for p, g in plain.items() if len(g) >= 80}
        rolled = {(r.patient_id, r.w): r.r for r in stats.rolling_correlation(beats, span).collect()}
        for p, g in plain.items():
            x, y, n = g["ptt_peak_to_foot"].to_numpy(), g["sbp_reference"].to_numpy(), len(g)
            if p in quarters:
                assert close(quarters[p][0], corr(x[: n // 4], y[: n // 4])) and close(quarters[p][1], corr(x[3 * n // 4 :], y[3 * n // 4 :]))
            size, step = n // 4, n // 4 // 2
            for w in range((n - size) // step + 1) if step else ():
                assert close(rolled.pop((p, w)), corr(x[w * step : w * step + size], y[w * step : w * step + size]))
        assert not rolled


def test_sequences_and_steps(beats, plain):
    for span, block in ((3600.0, 4096), (25.0, 10)):
        got = {(r.patient_id, r.end_idx): [x[0] for x in r.seq] for r in modelprep.sliding_sequences(beats, ["hr_bpm"], ["sbp_reference"], 10, span=span, block=block).collect()}
        want = {(p, g["cycle_index"].iloc[k]): g["hr_bpm"].to_numpy(dtype=np.float32)[k - 9 : k + 1].tolist() for p, g in plain.items() if len(g) > 10 for k in range(9, len(g))}
        assert got == want
        steps = {r.session_id: (r.n, r.duplicates, r.backward, r.gaps, r.breaks) for r in quality.temporal_integrity(beats, block).collect()}
        for p, g in plain.items():
            t = g.sort_values("cycle_index")["timestamp"].to_numpy()
            d = np.diff(t)
            assert steps[f"s{p}"] == (len(t), len(t) - len(set(t[~np.isnan(t)])), int((d <= 0).sum()), int((d > 5).sum()), 0)


def test_no_window_over_a_patient(beats):
    made = [evaluate.ema_baseline(beats), stats.autocorrelation(beats), stats.quarter_correlation(beats), stats.rolling_correlation(beats), modelprep.sliding_sequences(beats, ["hr_bpm"], ["sbp_reference"])]
    for df in made:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line and "__held" not in line]
        assert all("__slot" in line or "block" in line for line in windows), windows


def test_merged_moments(beats, plain):
    got = stats.global_vs_within(beats, ["ptt_peak_to_foot", "hr_bpm"], more_than=10)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + got._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1  # one scan
    for r in got.collect():
        x = [g[r.feature].to_numpy() for g in plain.values()]
        y = [g["sbp_reference"].to_numpy() for g in plain.values()]
        assert close(r.global_r, corr(np.concatenate(x), np.concatenate(y)))
        assert close(r.centred_r, corr(np.concatenate([v - np.nanmean(v) for v in x]), np.concatenate([v - np.nanmean(v) if not np.isnan(v).all() else v for v in y])))
        each = [e for a, b in zip(x, y) if len(a) > 10 and (e := corr(a, b)) is not None]
        assert close(r.within_mean, float(np.mean(each))) and close(r.within_std, float(np.std(each)))
    v = stats.variance_decomposition(beats, "sbp_reference").first()
    y = [g["sbp_reference"].dropna().to_numpy() for g in plain.values()]
    assert math.isclose(v.total, np.concatenate(y).var(ddof=1), rel_tol=1e-10) and math.isclose(v.between, np.var([a.mean() for a in y if len(a)], ddof=1), rel_tol=1e-10)
    assert math.isclose(v.within, np.mean([a.var(ddof=1) for a in y if len(a) > 1]), rel_tol=1e-10)
    d = np.concatenate([a - a.mean() for a in y if len(a)])
    assert math.isclose(stats.theoretical_limits(beats).first().std_dev, d.std(ddof=1), rel_tol=1e-10)


def test_exact_quantiles(spark):
    """Many equal values, an even spread, few values and none, against NumPy; the second scan keeps few values."""
    rng = np.random.default_rng(3)
    rows = [("even", float(v)) for v in rng.permutation(30_000)] + [("ties", float(v)) for v in rng.integers(0, 4, 30_000)] + [("skewed", float(v)) for v in np.exp(rng.normal(0, 3, 30_000))]
    rows += [("few", 3.0), ("few", 1.0), (None, 5.0), ("none", None), ("even", None)]
    df = spark.createDataFrame(rows, "name string, x double").repartition(5)
    at = (0.5, 0.0, 0.1, 0.999, 1.0, 0.25)
    for sketch in (100, 10_000):
        got = {r.name: r for r in quantiles.summarised(df, "name", "x", at, [F.max("x").alias("most"), F.count("name").alias("rows")], sketch).collect()}
        for name in ("even", "ties", "skewed", "few", None):
            x = [v for k, v in rows if k == name and v is not None]
            assert np.allclose(got[name].q, np.quantile(x, at), rtol=1e-12) and got[name].most == max(x) and got[name].n == len(x)
        assert got["none"].q == [None] * len(at) and got["none"].n == 0 and got["even"].rows == 30_001
    assert quantiles.wide_quantiles(df.limit(0), "x", {"median": 0.5}, [F.count("x").alias("held")]).collect()[0].asDict() == {"held": 0, "median": None}
