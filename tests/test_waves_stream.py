import numpy as np
import pandas as pd

from beatspark import fixtures
from beatspark.streaming.ema import ema_stream, late_rows
from beatspark.waves import chunks, kernels

SF = "/root/testdata/sf0.001"


def test_find_peaks():
    x = np.array([0, 2, 1, 3, 3, 0, 5, 0, 1, 0.0])
    assert list(kernels.find_peaks(x)) == [1, 3, 6, 8]
    assert list(kernels.find_peaks(x, distance=3)) == [3, 6]
    assert list(kernels.find_peaks(x, least=2)) == [3, 6]


def test_resample_keeps_a_sine():
    for m, n in ((300, 200), (64, 200), (201, 200)):
        f = lambda k: np.sin(2 * np.pi * 3 * np.arange(k) / k)
        assert np.allclose(kernels.resample(f(m), n), f(n))


def test_spikes_power_lag_band():
    x = np.sin(np.arange(1000) / 20)
    y = x.copy()
    y[500] = 90
    assert abs(kernels.remove_spikes(y)[500] - x[500]) < 0.01
    t = np.arange(2000) / 500
    assert kernels.best_lag(np.exp(-((t - 1) ** 2) * 90), np.exp(-((t - 1.2) ** 2) * 90), 250) == 100
    slow, fast = kernels.morlet_band(np.sin(2 * np.pi * 1.5 * t), 1, 2), kernels.morlet_band(np.sin(2 * np.pi * 20 * t), 1, 2)
    assert slow.std() > 50 * fast.std()
    assert kernels.quality_gate(np.zeros(100)) == "flat" and kernels.quality_gate(40 * np.sin(t)) == ""


def test_chunks_equal_the_whole(spark):
    rows, whole = [], {}
    for c in range(3):
        phase = np.arange(60_000) % (350 + 40 * c)
        ecg = 100 * np.exp(-(((phase - 20) / 4) ** 2))
        whole[c] = list(kernels.r_peaks(ecg))
        rows += [(c, k, k * 10_000, ecg[k * 10_000 : (k + 1) * 10_000].tolist()) for k in range(6)]
    found = chunks.detect_r_peaks(spark.createDataFrame(rows, "caseid int, chunk_id int, start_sample bigint, ecg array<double>")).toPandas()
    for c, p in found.sort_values("sample_idx").groupby("caseid"):
        assert list(p["sample_idx"]) == whole[c]


def test_ema_stream_equals_batch(spark, tmp_path):
    readings = fixtures.view(spark, SF, fixtures.STREAM_BP_FX).where("patient_id < 20")
    readings.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(readings.schema).parquet(str(tmp_path / "in"))
    q = ema_stream(stream).writeStream.format("memory").queryName("ema_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from ema_out").toPandas().set_index("event_id")["sbp_pred"]
    want = {}
    for _, p in readings.toPandas().sort_values(["ts", "event_id"]).groupby("patient_id"):
        ema = None
        for r in p.itertuples():
            v = None if pd.isna(r.sbp) else r.sbp
            again = ema is None or (r.event_kind == "calibrate" and v is not None)
            want[r.event_id] = v if again else ema
            ema = v if again else ema if v is None else 0.1 * v + 0.9 * ema
    assert len(got) == len(want)
    for k, v in want.items():
        assert (v is None and pd.isna(got[k])) or abs(got[k] - v) < 1e-9


def test_idle_patients_are_calibrated_anew_and_late_rows_counted(spark, tmp_path):
    """Batches of files, one after the other: an idle patient starts anew, late rows are dropped and counted, idle state goes."""
    day = pd.Timestamp("2024-01-01")
    at = lambda hours: (day + pd.Timedelta(hours=hours)).to_pydatetime()
    batches = [
        [(1, at(0), 1, "measure", 100.0, 60.0), (2, at(0), 2, "measure", 110.0, None)],
        [(1, at(1), 3, "measure", 120.0, None), (1, at(0.99), 4, "measure", None, 70.0)],
        [(2, at(40), 5, "measure", 150.0, 80.0)],
        [(1, at(2), 6, "measure", 999.0, 99.0)],  # behind the watermark
        [(1, at(60), 7, "measure", 130.0, 90.0), (1, at(60.5), 8, "measure", 140.0, 90.0)],
    ]
    schema = "patient_id int, ts timestamp, event_id bigint, event_kind string, sbp double, dbp double"
    (tmp_path / "in").mkdir()
    stream = ema_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 0.5, idle="1 day")
    late = 0
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        next((tmp_path / f"b{k}").glob("part-*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        late += late_rows(q)
    got = {r.event_id: (r.sbp_pred, r.dbp_pred) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (100.0, 60.0), 2: (110.0, None), 4: (100.0, 60.0), 3: (100.0, 65.0), 5: (150.0, 80.0), 7: (130.0, 90.0), 8: (130.0, 90.0)} and late == 1


def test_peaks_over_missing_samples(spark):
    """A gap between two R-peaks changes nothing; a recording without samples has no peaks."""
    at = np.arange(12_000) % 400
    ecg = 100 * np.exp(-(((at - 20) / 4) ** 2))
    gap = [None if 4100 <= i < 4300 else float(v) for i, v in enumerate(ecg)]
    rows = [(c, k, k * 6000, list(x[k * 6000 : (k + 1) * 6000])) for c, x in ((1, ecg.tolist()), (2, gap), (3, [None] * 12_000)) for k in range(2)]
    found = {}
    for r in chunks.detect_r_peaks(spark.createDataFrame(rows, "caseid int, chunk_id int, start_sample bigint, ecg array<double>")).collect():
        found.setdefault(r.caseid, []).append(r.sample_idx)
    assert sorted(found[1]) == sorted(found[2]) and len(found[1]) >= 29 and 3 not in found
