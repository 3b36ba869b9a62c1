"""Samples that are read where they are needed: no exchange moves them, and the beats are those of a table of chunks."""

import re

from beatspark import fixtures as fx
from beatspark.operators import joins
from beatspark.waves import recordings

SF = "/root/testdata/sf0.001"


def test_beats_of_a_source_are_those_of_a_table_and_its_samples_stay(spark):
    source, table = fx.wave_source(spark, SF), fx.waves(spark, SF)
    spans = joins.rr_intervals(recordings.detect_r_peaks(source))
    made, want = (recordings.cut_beats(chunks, spans, "ppg") for chunks in (source, table))
    key = lambda df: {(r.caseid, r.sample_idx): r.ppg for r in df.collect()}
    assert len(key(made)) > 100 and key(made) == key(want)
    plan = made._jdf.queryExecution().executedPlan().toString()
    above = plan.split("ArrowEvalPython")[:2]  # above the cut, and between it and the samples
    assert len(above) == 2 and not any("Exchange" in part for part in above), above
    dealt = re.search(r"Exchange hashpartitioning\(caseid[^,]*, chunk_id[^,]*, \d+\), REPARTITION_BY_NUM", plan)
    assert dealt, "the small rows are dealt by a fixed number of partitions, which Spark does not make fewer"


def test_filtered_chunks_of_a_source_are_those_of_a_table(spark):
    source, table = fx.wave_source(spark, SF), fx.waves(spark, SF)
    rates = joins.rr_stats(joins.rr_intervals(recordings.detect_r_peaks(source)))
    made, want = ({(r.caseid, r.chunk_id): r.ppg for r in recordings.wavelet_filter(c, rates, "ppg", "ppg").select("caseid", "chunk_id", "ppg").collect()} for c in (source, table))
    assert made and made == want
