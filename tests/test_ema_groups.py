"""The running averages of all alphas are carried along a patient in one group."""

import re

from beatspark.operators import evaluate


def test_one_group_for_each_patient(spark):
    rows = [(p, float(k * 1800), k, 100.0 + (k * 7 + p) % 13, 60.0 + k % 5) for p in range(3) for k in range(12)]
    frame = spark.createDataFrame(rows, "patient_id int, timestamp double, cycle_index int, sbp_reference double, dbp_reference double")
    made = evaluate.ema_baseline(frame, (0.1, 0.3))
    keys = re.findall(r"FlatMapGroupsInArrow \[([^\]]*)\]", made._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("alpha" in k for k in keys), keys
    for a in (0.1, 0.3):
        got = {(r.patient_id, r.cycle_index): r.sbp_pred for r in made.where(f"alpha = {a}").collect()}
        for p in range(3):
            state = None
            for k, y in [(r[2], r[3]) for r in rows if r[0] == p]:
                state = y if state is None else state
                assert abs(got[p, k] - state) < 1e-9
                state = a * y + (1 - a) * state
