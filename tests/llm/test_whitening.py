"""Whitening against NumPy's dense eigenvectors and plain integer arithmetic."""

import math

import numpy as np
import pytest

from beatspark.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, place int, n int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1, 2) for i, v in rows], SCHEMA)


def plain(rows, k=16):
    """{(id, number of the row): (n, deviation, |whitened|)}, explained."""
    size = len(rows[0][1])
    taken = [(i, v) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in taken]
    listed = sorted({tuple(x) for x in xs})
    n, sums = len(listed), [sum(c) for c in zip(*listed)]
    c = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in listed])
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    every = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in xs])
    w = every @ axes / np.sqrt(e)
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs]
    return [i for i, _ in taken], n, deviations, w, e / np.trace(c.T @ c / n)


def compare(spark, rows, got, tolerance=1e-8):
    ids, n, deviations, w, share = plain(rows)
    assert len(got) == w.size and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert {k for k in by} == set(zip(ids, deviations))
    sign = {}
    for k, (i, dev) in enumerate(zip(ids, deviations)):
        for c in range(w.shape[1]):
            for value in by[(i, dev)][c + 1]:
                assert abs(abs(value) - abs(w[k, c])) < tolerance
                if abs(value) > 1e-3:
                    assert sign.setdefault(c, np.sign(value * w[k, c])) == np.sign(value * w[k, c])


def test_odd_rows(spark):
    random = np.random.default_rng(1)
    rows = [(i, [float(c) for c in random.standard_normal(20) * np.arange(1, 21)]) for i in range(300)]
    rows += [(300, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (301, [0.0] * 20), (302, None), (303, []), (304, [1.0] * 3), (305, [NAN] + [0.0] * 19), (306, [INF] + [1.0] * 19), (307, [None] + [1.0] * 19), (308, [1e30] * 20)]
    vectors = frame(spark, rows)
    made = whitening.fit(vectors)
    compare(spark, [r for r in rows if r[0] != 308], whitening.components(vectors, made).collect())
    assert len({(lo, hi) for lo, hi in made.certified}) == 16


def test_empty_single_and_flat(spark):
    assert whitening.fit(frame(spark, [(1, None)])) is None
    one = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.components(one, whitening.fit(one)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    made = whitening.fit(frame(spark, flat))
    assert len(made.values) == 1 and abs(made.values[0] / made.trace - 1) < 1e-12 and made.identity_error < 1e-12


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(1 << 33) * (i % 3), float(i)]) for i in range(30)]
    got = whitening.components(frame(spark, rows), whitening.fit(frame(spark, rows))).where("component = 1").collect()
    want = {i: d if d < 1 << 63 else None for i, d in zip(*[plain(rows)[k] for k in (0, 2)])}
    assert {r.id: r.deviation for r in got} == want and None in want.values()


@pytest.mark.parametrize("values", [[9.0, 4.0, 4.0, 4.0, 1.0], [1.0] * 6, [1.0, 1.0 - 1e-13, 0.5, 0.5 - 1e-9, 0.0], list(np.linspace(2, 1, 40))])
def test_slicing_counts_and_clusters(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values), len(values))))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    for s in (-1.0, 0.3, 0.75, 1.5, 3.0, 10.0):
        assert whitening.above(v, s) == sum(x > s for x in values)
    found, axes, certified = whitening.leading(v, 16)
    want = sorted((x for x in values if x > 1e-12), reverse=True)[:16]
    assert np.allclose(found, want, atol=1e-12) and np.allclose(axes.T @ axes, np.eye(len(want)), atol=1e-10)
    assert np.abs(v @ axes - axes * found).max() < 1e-11
    for k, (lo, hi) in enumerate(certified):
        assert whitening.above(v, lo) >= k + 1 > whitening.above(v, hi)


def test_inertia_of_indefinite_matrices():
    random = np.random.default_rng(5)
    for size in (1, 2, 3, 8, 33):
        for _ in range(20):
            a = random.standard_normal((size, size))
            a = a + a.T
            a[np.diag_indices(size)] *= random.integers(0, 2, size)  # zero pivots
            assert whitening.above(a, 0.0) == (np.linalg.eigvalsh(a) > 0).sum()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(spark, rows, queries.QUERIES["op12_embedding_whitening"](spark, sf).withColumnRenamed("vec_id", "id").collect())
