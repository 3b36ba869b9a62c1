"""Archives by ranges, beats in ranges with a manifest, written stages that a stopped run goes on from, and as-of joins by stretches."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatspark import fixtures as fx
from beatspark.operators import joins
from beatspark.sources import archives
from beatspark.sources import io as sources
from beatspark.sources.stages import Stages
from beatspark.waves import beats as kernels
from beatspark.waves import recordings
from beatspark.waves.chunks import detect_r_peaks

SF = "/root/testdata/sf0.001"


def store(path, packed=False, **arrays):
    buffer = io.BytesIO()
    (np.savez_compressed if packed else np.savez)(buffer, **arrays)
    path.write_bytes(buffer.getvalue())


def test_archives_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    signals = {c: rng.normal(size=(2, 47_000)).astype(np.float32 if c == 2 else float) for c in (1, 2, 3)}
    sbp = np.array([100.0, np.nan, 120.0])
    for c, (ecg, ppg) in signals.items():
        store(tmp_path / f"case_0000{c}.npz", c == 3, **{archives.WAVES["ecg"]: ecg, archives.WAVES["ppg"]: ppg[:45_500], archives.NUMERICS["sbp"]: sbp, archives.NUMERICS["dbp"]: sbp / 2, "metadata": f'{{"caseid": {c}, "age": 50.5}}'})
    store(tmp_path / "case_00004.npz", **{archives.WAVES["ecg"]: rng.normal(size=10)})
    (tmp_path / "case_00005.npz").write_bytes(b"broken")
    df = sources.read_recordings(spark, str(tmp_path), 2 * archives.CHUNK)
    parts = archives.WaveReader(f"file://{tmp_path}", None, 2 * archives.CHUNK).partitions()
    assert len(parts) == 3 * 3 + 2 and df.rdd.getNumPartitions() == len(parts) and max(p.count for p in parts) == 20_000
    rows = df.collect()
    for c, (ecg, ppg) in signals.items():
        mine = sorted((r for r in rows if r.caseid == c), key=lambda r: r.chunk_id)
        assert [r.start_sample for r in mine] == [0, 10_000, 20_000, 30_000, 40_000]
        assert np.allclose(np.concatenate([r.ecg for r in mine]), ecg[:45_500]) and np.allclose(np.concatenate([r.ppg for r in mine]), ppg[:45_500])
    assert {r.caseid: bool(r.error) for r in rows if r.chunk_id < 0} == {4: True, 5: True}
    assert sources.parse_metadata(df).where("caseid = 2").first().clinical.age == 50.5
    numbers = sources.read_numerics(spark, f"file://{tmp_path}").where("error IS NULL").orderBy("caseid", "bp_idx").collect()
    assert [(r.caseid, r.bp_idx, r.sbp, r.dbp) for r in numbers] == [(c, k, v, v and v / 2) for c in (1, 2, 3) for k, v in enumerate((100.0, None, 120.0))]


def test_beats_in_ranges(spark, tmp_path):
    beats = spark.range(6000).select((F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 40)).cast("int").alias("patient_id"), F.col("id").cast("double").alias("timestamp"), F.col("id").cast("int").alias("cycle_index"))
    path = str(tmp_path / "beats")
    sources.write_beats(beats, path, rows=500)
    manifest = spark.read.parquet(f"{path}/_manifest").collect()
    assert max(r.rows for r in manifest) <= 500 and sum(r.rows for r in manifest) == 6000
    assert sum(r.first <= 7 <= r.last for r in manifest) >= 4  # a patient of a third of all rows spans files
    found = sources.read_patients(spark, path, [30, 31])
    assert len(found.inputFiles()) < len(manifest) / 2 and found.exceptAll(beats.where("patient_id in (30, 31)")).isEmpty() and found.count() == 200
    assert sources.read_patients(spark, path, [999]).count() == 0 and sources.read_beats(spark, path).count() == 6000


def test_concatenated_batches(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "patient_id int, hr double"), spark.createDataFrame([("x", 3)], "dx string, patient_id int")
    assert sorted(map(tuple, sources.concat_beats([a, b, a]).collect()), key=str) == sorted([(1, 2.0, None), (3, None, "x"), (1, 2.0, None)], key=str)


def test_nearest_pressure_by_stretches(spark):
    rng = np.random.default_rng(2)
    numerics = [(c, float(t), None if rng.random() < 0.1 else float(v)) for c in (1, 2) for t, v in zip(np.unique(np.round(rng.uniform(0, 3000, 60), 1)), rng.normal(120, 9, 60))]
    peaks = [(c, k, float(t)) for c in (1, 2, 3) for k, t in enumerate(np.sort(np.round(rng.uniform(-200, 3500, 80), 1)))] + [(1, 900, numerics[5][1])]
    p, n = spark.createDataFrame(peaks, "caseid int, peak_no int, t double"), spark.createDataFrame(numerics, "caseid int, t double, sbp double")
    for width in (10.0, 100.0, 1e6):
        for r in joins.nearest_bp_irregular(p, n, width).collect():
            near = sorted((round(abs(t - r.t), 6), t, v) for c, t, v in numerics if c == r.caseid and v is not None)
            assert (r.bp_t, r.sbp) == (near[0][1:] if near else (None, None))
    samples = spark.createDataFrame([(c, k, float(k), k % 37 == 5) for c in (1, 2) for k in range(400)], "caseid int, sample_idx int, v double, is_peak boolean")
    wide, narrow = ({(r.caseid, r.beat): (r.start, r["values"]) for r in joins.segment_cycles(samples, s).collect()} for s in (10_000, 16))
    assert wide == narrow and len(wide) == 2 * 10 and wide[1, 1] == (5, [float(v) for v in range(5, 42)])


def test_a_stopped_build_goes_on(spark, tmp_path, monkeypatch):
    chunks, numerics = fx.view(spark, SF, fx.WAVES_FX).where("caseid <= 3"), fx.view(spark, SF, fx.WAVE_NUMERICS_FX)
    calls = []
    for name in ("detect_r_peaks", "wavelet_filter", "without_drift", "judged_spans"):
        real = getattr(recordings, name)
        monkeypatch.setattr(recordings, name, lambda *a, _n=name, _f=real, **k: (calls.append(_n), _f(*a, **k))[1])
    real = recordings.beat_votes
    monkeypatch.setattr(recordings, "beat_votes", lambda *a, **k: 1 / 0)
    folder = f"file://{tmp_path}/run"
    with pytest.raises(ZeroDivisionError):
        recordings.process_recordings(chunks, numerics, stages=Stages(spark, folder))
    monkeypatch.setattr(recordings, "beat_votes", real)
    stages = Stages(spark, folder)
    beats = stages.table("beats", lambda: recordings.process_recordings(chunks, numerics, stages=stages))
    assert sorted(calls) == sorted(["detect_r_peaks", "wavelet_filter", "without_drift", "judged_spans"])  # each once in both runs
    fresh = recordings.process_recordings(chunks, numerics)
    assert beats.select("caseid", "cycle_index", "reason").exceptAll(fresh.select("caseid", "cycle_index", "reason")).isEmpty()
    failures = {r.reason: r.n for r in recordings.build_failures(stages).collect()}
    spans = stages.table("spans", lambda: None)
    assert sum(failures.values()) == spans.count() and failures["valid"] == beats.where("reason = ''").count() > 0
    assert failures.get("missing_pressure", 0) == spans.where("reason = 'missing_pressure'").count()
    done = spark.createDataFrame([(1,), (2,)], "patient_id int")
    built = recordings.build_beats(chunks, numerics, fx.view(spark, SF, fx.CASES_FX), done=done)
    assert {r.patient_id for r in built.select("patient_id").distinct().collect()} == {3}
    stages.discard()
    assert not stages.done("peaks")


def test_polarity_without_beats(spark):
    """Recordings whose beats say nothing, over chunks that windows cross, against a plain loop; and one too short."""
    rng = np.random.default_rng(3)
    chunks, whole = [], {}
    for case, (n, side) in enumerate(((9000, 1.0), (9000, -1.0), (2300, -1.0), (700, -1.0), (25_000, -1.0))):
        at = np.arange(n) % 400
        ppg = side * (40 * np.exp(-(((at - 130) / 28.0) ** 2)) + 16 * np.exp(-(((at - 240) / 40.0) ** 2))) + rng.normal(size=n) * 0.01
        chunks += [(case, k, k * 1700, ppg[k * 1700 : (k + 1) * 1700].tolist()) for k in range(-(-n // 1700))]
    df = spark.createDataFrame(chunks, "caseid int, chunk_id int, start_sample bigint, ppg array<double>")
    for r in recordings.without_drift(df).orderBy("caseid", "chunk_id").collect():
        whole.setdefault(r.caseid, []).extend(r.ppg)
    want = {c: kernels.polarity_by_slope(np.array(x)) for c, x in whole.items()}
    assert want == {0: False, 1: True, 2: True, 3: False, 4: True}
    none = spark.createDataFrame([], "caseid int, peak_no int, sample_idx bigint")
    assert {r.caseid: r.inverted for r in recordings.detect_polarity(df, none).collect()} == want
    # one that has beats goes by these
    peaks = spark.createDataFrame([(1, k, 400 * k) for k in range(12)], "caseid int, peak_no int, sample_idx bigint")
    assert {r.caseid: r.inverted for r in recordings.detect_polarity(df, peaks).collect()} == want
