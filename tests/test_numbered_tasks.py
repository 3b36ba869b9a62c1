"""Numbered rows are dealt over as many tasks as their number asks for."""

import re

from pyspark.sql import functions as F

from beatspark.operators import quantiles


def test_numbered_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "TASK_ROWS", 50, raising=False)
    frame = spark.range(1000).select(F.format_string("p%03d|%05d", F.col("id") % 100, "id").alias("w"))
    placed = quantiles.numbered(frame, F.col("w"), (2, 4))
    assert re.search(r"hashpartitioning\(__at#\d+, 20\)", placed._jdf.queryExecution().executedPlan().toString())
    assert [r.k for r in placed.orderBy("w").collect()] == list(range(1, 1001))
