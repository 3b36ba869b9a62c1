"""A source's samples are filtered and cut in blocks of chunks, neither written nor moved; the beats are those of a table of chunks."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatspark import fixtures as fx
from beatspark.functions import arrays
from beatspark.operators import select
from beatspark.sources.stages import Stages
from beatspark.waves import beats, blocks, recordings
from beatspark.waves.chunks import sampled

SF = "/root/testdata/sf0.001"


def some_source(spark):
    """Recordings of which some are so faint that their beats say nothing of their polarity, and one has no samples in a chunk."""
    source = fx.wave_source(spark, SF)
    faint, gone = F.when(F.col("caseid") % 3 == 0, 2e-6).otherwise(1.0), (F.col("caseid") == 1) & (F.col("chunk_id") == 3)

    def samples(df):
        made = source.samples(df)
        return made.withColumns({c: F.transform(c, lambda x: x * faint) for c in ("ppg_left", "ppg_right")} | {"ppg": F.transform("ppg", lambda x: F.when(~gone, x * faint))})

    return replace(source, rows=source.rows.where("caseid < 8"), samples=samples)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    """The beats of the table, by the way of written and moved signals."""
    stages = Stages(spark, f"file://{tmp_path_factory.mktemp('table')}/run")
    table = sampled(some_source(spark)).cache()
    numerics = fx.view(spark, SF, fx.WAVE_NUMERICS_FX)
    rows = recordings.synchronised_cycles(table, numerics, stages=stages).collect()
    stages.table("beats", lambda: recordings.process_recordings(table, numerics, stages=stages))
    failures = {r.reason: r.n for r in recordings.build_failures(stages).collect()}
    windows = {r.caseid for r in spark.read.parquet(f"{stages.folder}/window_parts").where("vote IS NOT NULL").collect()}
    table.unpersist()
    return {(r.caseid, r.peak_no): r for r in rows}, failures, windows


@pytest.mark.parametrize("block", (1, 64))
def test_beats_of_blocks_are_those_of_a_table(spark, tmp_path, plain, block):
    want, failures, windows = plain
    stages, numerics = Stages(spark, f"file://{tmp_path}/run"), fx.view(spark, SF, fx.WAVE_NUMERICS_FX)
    got = {(r.caseid, r.peak_no): r for r in recordings.synchronised_cycles(some_source(spark), numerics, stages=stages, block=block).collect()}
    assert len(want) > 100 and set(got) == set(want) and {r.inverted for r in got.values()} == {True, False}
    for key, r in want.items():
        mine = got[key]
        assert (mine.ppg, mine.inverted, mine.sample_idx, mine.end_idx, mine.timestamp, mine.hr, mine.sbp_reference, mine.dbp_reference) == (r.ppg, r.inverted, r.sample_idx, r.end_idx, r.timestamp, r.hr, r.sbp_reference, r.dbp_reference)
        assert abs(mine.cycle_correlation - r.cycle_correlation) < 1e-12
    asked = spark.read.parquet(f"{stages.folder}/window_look").where("votes > 0")
    assert {r.caseid for r in asked.collect()} == windows and windows
    stages.table("beats", lambda: recordings.process_recordings(some_source(spark), numerics, stages=stages, block=block))
    assert {r.reason: r.n for r in recordings.build_failures(stages).collect()} == failures


def test_a_build_of_a_source_writes_no_samples(spark, tmp_path):
    stages = Stages(spark, f"file://{tmp_path}/run")
    source = fx.wave_source(spark, SF)
    made = recordings.process_recordings(source, fx.view(spark, SF, fx.WAVE_NUMERICS_FX), stages=stages)
    assert made.where("reason = ''").count() > 100
    written = sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(tmp_path) for f in files)
    signal = 8 * fx.WAVE_CHUNK * source.rows.count()
    assert written < signal / 10, (written, signal)
    plan = made._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("ArrowEvalPython")]
    assert above.count("MapInArrow") == 2 and "Exchange" not in above, above


def test_a_build_moves_the_columns_asked_for(spark, tmp_path):
    """Where the catalogue is too large to be broadcast, a join moves beats; what is only checked for missing values stays."""
    names = ["caseid", "cycle_index", "timestamp", "sbp_reference", "dbp_reference", *beats.FEATURES]
    missing = lambda k: None if k % 7 == 3 else float("nan") if k % 7 == 5 else 1.0
    rows = [(k % 3, k, float(k), 120.0, 80.0 + 50 * (k % 5 == 0), *[missing(k) if f == "stat_kurtosis" else 2.0 for f in beats.FEATURES], "late" if k % 11 == 0 else "") for k in range(60)]
    schema = ", ".join(f"{n} {'int' if n in ('caseid', 'cycle_index') else 'double'}" for n in names) + ", reason string"
    stages = Stages(spark, f"file://{tmp_path}/run")
    stages.table("beats", lambda: spark.createDataFrame(rows, schema))
    cases = spark.createDataFrame([(0, "M", 40.0), (1, None, 50.0), (2, "F", None)], "caseid int, sex string, age double")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = recordings.build_beats(fx.wave_source(spark, SF), None, cases, ("sex",), ("age",), stages=stages).select("patient_id", "cycle_index", "sex")
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        found = {(r.patient_id, r.cycle_index, r.sex) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert found == {(k % 3, k, "M" if k % 3 == 0 else "unknown") for k in range(60) if k % 3 < 2 and k % 5 and k % 11 and k % 7 not in (3, 5)}
    join = plan.index("Join")
    assert "stat_kurtosis" not in plan[:join] and "stat_kurtosis" in plan[join:] and [line for line in plan[join:].splitlines() if "Project" in line and "stat_kurtosis" not in line], plan


def test_templates_and_likeness_are_those_of_the_expressions(spark):
    random = np.random.default_rng(7)
    shapes = {case: random.normal(size=(n, 9)).cumsum(axis=1) for case, n in ((1, 1), (2, 6), (3, 7))}
    shapes[2][1, 3] = shapes[3][:, 4] = np.nan
    rows = [(case, [None if np.isnan(v) else float(v) for v in row]) for case, table in shapes.items() for row in table]
    cycles = spark.createDataFrame(rows, "caseid int, ppg array<double>")
    want = {r.caseid: [np.nan if v is None else v for v in r.template] for r in select.median_template(cycles).collect()}
    for case, table in shapes.items():
        assert np.array_equal(blocks.median_shape(table), want[case], equal_nan=True)
    # of several blocks, and of one
    look = spark.createDataFrame([(1, None, [r[1] for r in rows[:1]]), (2, None, [r[1] for r in rows[1:4]]), (2, None, [r[1] for r in rows[4:7]]), (3, [1.5], [])], "caseid int, template array<double>, shapes array<array<double>>")
    made = {r.caseid: [np.nan if v is None else v for v in r.template] for r in blocks.templates(look).collect()}
    assert made[3] == [1.5] and all(np.array_equal(made[c], want[c], equal_nan=True) for c in (1, 2))
    pairs = spark.createDataFrame([(k, row.tolist(), shapes[1][0].tolist()) for k, row in enumerate(shapes[3][:, :4])], "k int, a array<double>, b array<double>")
    alike = [r.x for r in pairs.orderBy("k").select(arrays.template_corr(F.col("a"), F.slice("b", 1, 4)).alias("x")).collect()]
    assert np.allclose(blocks.likeness(shapes[3][:, :4], shapes[1][0][:4]), alike, rtol=0, atol=1e-12)
