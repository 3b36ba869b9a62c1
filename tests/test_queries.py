"""Each query against its SQL twin in DuckDB, on the smallest tables."""

import duckdb
import pytest

from beatspark import fixtures, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in fixtures.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: None if v is None or v != v else bool(v) if isinstance(v, (bool,)) else round(float(v), 4) + 0.0 if isinstance(v, (int, float)) else str(v)
    return list(frame.columns), sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = rows(queries.QUERIES[name](spark, SF).toPandas()), rows(duck.sql(queries.ORACLES[name]).df())
    assert got == want


def test_alpha_sweep(spark):
    out = queries.QUERIES["a48_alpha_sweep"](spark, SF).toPandas().sort_values("alpha")
    assert list(out["alpha"]) == [0.05, 0.1, 0.2, 0.3] and (out["n_patients"] > 0).all()


def test_baseline_delta_keeps_every_beat(spark):
    """A row for each beat, in the query and in its SQL."""
    beats = fixtures.beats(spark, SF).select("patient_id", "cycle_index")
    made = queries.QUERIES["w2_baseline_delta"](spark, SF)
    assert {"cycle_index", "sbp_delta", "ptt_delta"} <= set(made.columns) and "GROUP BY b.patient_id" not in queries.ORACLES["w2_baseline_delta"]
    assert made.count() == beats.count() and made.select("patient_id", "cycle_index").exceptAll(beats).count() == 0
