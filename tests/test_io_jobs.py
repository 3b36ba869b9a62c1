import io

import numpy as np

from beatspark import fixtures
from beatspark.operators import evaluate, modelprep, normalize, select
from beatspark.plans import jobs
from beatspark.sources import io as sources
from beatspark.streaming import quality_stream

SF = "/root/testdata/sf0.001"


def test_recordings(spark, tmp_path):
    rng = np.random.default_rng(0)
    ecg, ppg = rng.normal(size=25_000), rng.normal(size=24_000)
    buffer = io.BytesIO()
    np.savez(buffer, wave_SNUADC_ECG_II=ecg, wave_SNUADC_PLETH=ppg, metadata='{"caseid": 7, "age": 61.5, "sex": "F"}')
    (tmp_path / "case_00007.npz").write_bytes(buffer.getvalue())
    (tmp_path / "case_00008.npz").write_bytes(b"broken")
    found = sources.parse_metadata(sources.read_recordings(spark, str(tmp_path))).orderBy("caseid", "chunk_id").collect()
    good = [r for r in found if r.caseid == 7]
    assert np.allclose(np.concatenate([r.ppg for r in good]), ppg) and [r.start_sample for r in good] == [0, 10_000, 20_000]
    assert good[0].clinical.age == 61.5 and [r.error for r in found if r.caseid == 8] == ["BadZipFile"] or found[-1].error


def test_beats_round_trip(spark, tmp_path):
    beats = fixtures.beats(spark, SF)
    sources.write_beats(beats, str(tmp_path / "beats"), 4)
    back = sources.read_beats(spark, str(tmp_path / "beats"))
    assert back.drop("patient_bucket").exceptAll(beats.select(*[c for c in back.columns if c != "patient_bucket"])).count() == 0 and back.count() == beats.count()


def test_jobs(spark):
    beats = fixtures.beats(spark, SF).cache()
    out = jobs.publish_datasets(beats, ["hr_bpm"])
    assert out["full"].count() == beats.count() >= out["validated"].count() >= out["strict"].count()
    report = jobs.clean_and_report(beats)
    removed = sum(r.removed for r in report["removed"].where("rule NOT IN ('ptt_peak_zero', 'ptt_foot_zero')").collect())
    assert 0 < removed <= report["changes"].first().samples_removed
    assert {r.part for r in jobs.training_set(beats, ["hr_bpm"]).select("part").distinct().collect()} <= {"train", "val", "test"}


def test_case_catalogue_and_summaries(spark, tmp_path):
    names = [c.split()[0] for c in sources.CASES.split(", ")]
    line = lambda i, age, dx: ",".join({"caseid": str(i), "age": age, "dx": dx, "casestart": "0", "caseend": "3600"}.get(n, "") for n in names)
    (tmp_path / "cases.csv").write_text("\n".join([",".join(names), line(1, "61.5", "Hernia"), line(2, "", "")]))
    cases = sources.read_cases(spark, str(tmp_path / "cases.csv"))
    assert [(r.caseid, r.age, r.dx, r.caseend) for r in cases.orderBy("caseid").collect()] == [(1, 61.5, "Hernia", 3600), (2, None, None, 3600)]
    states = spark.createDataFrame([("ok",), ("ok",), ("failed",), (None,)], "status string")
    assert tuple(sources.run_summary(states).first()) == (4, 2, 1)


def test_beats_from_csv_and_reports(spark, tmp_path):
    (tmp_path / "beats.csv").write_text("patient_id,hr_bpm\n1,NaN\n2,61.5\n3,70\n")
    rows = sources.read_beats(spark, str(tmp_path / "beats.csv"), "patient_id int, hr_bpm double").collect()
    assert [r.patient_id for r in rows] == [1, 2, 3] and rows[1].hr_bpm == 61.5
    assert sources.read_beats(spark, str(tmp_path / "beats.csv"), "patient_id int, hr_bpm double", rows=2).count() == 2
    metrics = spark.createDataFrame([(1, 0.5), (2, -0.5)], "patient_id int, r double")
    sources.write_patient_metrics(metrics, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2
    sources.write_report_json(metrics.limit(1), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("part-*.json"))) == 1 and spark.read.json(str(tmp_path / "report")).first().patient_id == 1


def test_missing_keys_keep_their_rows(spark):
    """Rows without a patient, a recording or a category stay."""
    rows = [(None, 1.0, 0, 0.0, None), (None, 3.0, 1, 0.8, "x"), (1, 5.0, 0, 0.0, "y"), (1, None, 1, 0.8, "x")]
    df = spark.createDataFrame(rows, "patient_id int, hr_bpm double, cycle_index int, timestamp double, dx string")
    assert normalize.patient_zscore(df, ["hr_bpm"]).count() == normalize.baseline_delta(df, {"hr_bpm": "d"}).count() == 4
    assert {r.hr_bpm for r in select.impute_mean(df, "hr_bpm", "patient_id").where("patient_id = 1").collect()} == {5.0}
    assert sorted((r.dx or "", r.dx_code) for r in modelprep.label_encode(df, "dx").collect()) == [("", None), ("x", 0), ("x", 0), ("y", 1)]


def test_averages_do_not_hang_on_the_blocks(spark):
    """The running average is the same whatever the blocks, and a plain loop's."""
    rng = np.random.default_rng(1)
    y = [None if v < -1.2 else 100 + 9 * float(v) for v in rng.normal(size=60)]
    y[0] = None
    df = spark.createDataFrame([(1, k, float(k), v, v) for k, v in enumerate(y)], "patient_id int, cycle_index int, timestamp double, sbp_reference double, dbp_reference double")
    want, e = [], None
    for v in y:
        want.append(v if e is None else e)
        e = v if e is None else e if v is None else 0.3 * v + 0.7 * e
    for block in (4096, 7, 1):
        got = [r.sbp_pred for r in evaluate.ema_baseline(df, (0.3,), block).orderBy("cycle_index").collect()]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want)), block


def test_stream_of_beats(spark, tmp_path):
    beats = fixtures.beats(spark, SF).select("patient_id", "cycle_index", "sbp_reference", "dbp_reference", "hr_bpm", "pat_ecg_ppg", "ptt_peak_to_foot", "ptt_peak_to_peak", "amplitude_ratio_ra", "cycle_correlation")
    beats.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = quality_stream.valid_beats(spark.readStream.schema(beats.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == quality_stream.valid_beats(beats).count() > 0
