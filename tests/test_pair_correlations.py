"""Many correlations in one scan: equal to NumPy's, and no aggregate for each pair."""

import numpy as np

from beatspark.operators import stats


def test_pairs_with_gaps_constants_and_far_means(spark):
    rng = np.random.default_rng(4)
    x, y = 1e6 + rng.normal(size=500), rng.normal(size=500)
    gap = rng.random((500, 3)) < 0.2
    # c is constant where b is there
    rows = [tuple(None if g else float(v) for v, g in zip((x[k], x[k] + y[k], 3.3 if not gap[k, 1] else y[k]), (*gap[k, :2], False))) for k in range(500)]
    frame = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    got = {(r.a, r.b): r.r for r in stats.correlation_pairs(frame, ["a", "b", "c"]).collect()}
    both = ~gap[:, 0] & ~gap[:, 1]
    assert abs(got["a", "b"] - np.corrcoef(x[both], (x + y)[both])[0, 1]) < 1e-9
    assert got["b", "c"] is None and got["a", "c"] is not None
    one = stats.feature_bp_correlation(frame, ["a"], ("b", "c")).first()
    assert one.feature == "a" and one.r_b == got["a", "b"] and one.r_c == got["a", "c"] and one.strength == "strong"
    assert {r.r for r in stats.correlation_pairs(frame.limit(0), ["a", "b", "c"]).collect()} == {None}


def test_no_aggregate_for_each_pair(spark):
    plan = stats.correlation_pairs(spark.range(5).selectExpr("id a", "id * id b", "id % 2 c"), ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "covar_pop" not in plan
