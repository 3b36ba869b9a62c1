"""Hard negatives against brute force: ties, hot vectors, blocks, large entries, odd rows, and the query's SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from beatspark.llm import hard_negatives as hn
from beatspark.llm import queries

SCHEMA = "vec_id bigint, embedding array<double>, label int, key string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "clash", 1) for i, v, c in rows], SCHEMA)


def brute(rows, step, positives=5, negatives=10):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) == len(rows[0][1]) and all(c is not None and math.isfinite(c) and abs(c) < 65536 for c in r[1])]
    ok = sorted({(i, c, tuple(math.floor(256 * e) for e in v)) for i, v, c in ok})
    out = set()
    for i, c, q in ok:
        if i % step:
            continue
        near = sorted((-sum(a * b for a, b in zip(q, v)), j, d) for j, d, v in ok)
        for p, j, _ in [n for n in near if n[1] != i and n[2] == c][:positives]:
            fits = [n for n in near if n[2] != c and 30 * -p <= 100 * -n[0] <= 90 * -p][:negatives]
            out |= {(i, j, rank, n[1], -p, -n[0]) for rank, n in enumerate(fits, 1)}
    return out


def mined(spark, rows, step, **more):
    found = [tuple(r) for r in hn.mine(frame(spark, rows), F.col("vec_id") % step == 0, **more).collect()]
    assert len(found) == len(set(found))
    return set(found)


def some(n, size, seed, labels=4, scale=1.0, digits=9):
    random = np.random.default_rng(seed)
    return [(k, [float(round(c, digits)) for c in scale * random.standard_normal(size)], int(random.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("settings", [{"small": 40}, {"small": 1000}, {"small": 60, "block": 16}])
def test_matches_brute_force(spark, settings):
    rows = some(400, 6, 1)
    got = mined(spark, rows, 20, **settings)
    assert got == brute(rows, 20) and got


def test_ties_hot_vectors_and_odd_rows(spark):
    rows = some(120, 3, 2, labels=3, digits=0)  # few different vectors
    rows += [(1000 + k, [1.0, 1.0, 0.0], k % 3) for k in range(90)]  # one that a third shares
    rows += [(0, rows[0][1], rows[0][2]), (7, rows[7][1], None), (None, [1.0, 2.0, 3.0], 1), (500, None, 1), (501, [], 1), (502, [1.0], 1), (505, [math.nan, 1.0, 1.0], 1), (510, [math.inf] * 3, 0), (515, [None, 1.0, 1.0], 0), (520, [1e9, 0.0, 0.0], 0), (525, [0.0] * 3, 1)]
    assert mined(spark, rows, 5, small=30) == brute(rows, 5)


def test_entries_beyond_exact_doubles(spark):
    rows = some(90, 4, 3, labels=2, scale=15_000.0)
    rows += [(200 + k, [65535.0 - k, 60000.0, 1.0, 2.0], k % 2) for k in range(10)]
    assert mined(spark, rows, 10, small=20) == brute(rows, 10)


def test_without_partners(spark):
    assert mined(spark, [(0, [1.0, 2.0], 1)], 1) == set()
    assert mined(spark, [(k, [1.0, 2.0], 1) for k in range(5)], 1) == set()
    assert hn.mine(frame(spark, []), F.lit(True)).count() == 0
    assert mined(spark, [(k, [1.0, 2.0], k) for k in range(5)], 1) == set()


def test_boxes_bound_scores_and_prune():
    random = np.random.default_rng(4)
    x = np.repeat(random.integers(-200, 200, (40, 2)), 200, axis=0) + random.integers(0, 5, (8000, 2))
    labels, ids = np.repeat(np.arange(40) % 4, 200), np.arange(8000)
    tree = hn.Tree(x.astype(float), ids, labels)
    q = np.array([3.0, -2.0])
    least, most = hn.bounds(tree.low, tree.high, q)
    for leaf, rows in enumerate(tree.leaves):
        assert least[leaf] <= (x[rows] @ q).min() and (x[rows] @ q).max() <= most[leaf]
    touched = []
    tree.leaves = type("Seen", (list,), {"__getitem__": lambda self, k: touched.append(k) or list.__getitem__(self, k)})(tree.leaves)
    ids_, scores = tree.search(q, 1, False, [(100, 300, -(1 << 62))], 10)[0]
    want = sorted((-s, i) for s, i, c in zip(x @ q, ids, labels) if c != 1 and 100 <= s <= 300)[:10]
    assert list(zip(-scores, ids_)) == want and len(touched) < len(tree.leaves) / 2


def test_query_matches_sql(spark):
    for sf in ("sf0.001", "sf0.1"):
        c = duckdb.connect()
        c.sql(f"create view embeddings as select * from '/root/testdata/{sf}/embeddings.parquet'")
        want = c.sql(queries.ORACLES["op13_hard_negatives"]).fetchall()
        got = [tuple(r) for r in queries.QUERIES["op13_hard_negatives"](spark, f"/root/testdata/{sf}").collect()]
        assert sorted(got) == sorted(want) and want
