"""Whitening of embeddings by spectrum slicing.

Entries become integers, x = floor(scale * c) + shift, and the mean and the covariance are taken over the distinct x-vectors
(the fit list), centred before multiplying. `leading` finds the leading eigenvalues of the covariance V one by one:

* the inertia of V - s I, read off a pivoted LDL' factorisation (Bunch and Kaufman), counts the eigenvalues above s;
  bisection by these counts isolates the k-th one in an interval that holds no other;
* Rayleigh quotient iteration from inside the interval converges cubically; what it finds counts only if it lies in the
  interval, else the interval is cut further;
* so the counts at the two ends of an interval certify the number of its eigenvalue. Eigenvalues that no double can part
  share an interval; their vectors are an orthonormal basis, and the counts certify the numbers of all of them together.

`whiten` projects every row, not only the fit list. The driver holds sums of one number for each dimension or pair of
dimensions, never rows; tasks hold one Arrow batch.

Defined results: vectors that are null, empty, of another length than most (ties: the shorter), hold null or non-finite
entries, or entries whose x would pass 2^40 take no part; a zero vector does; repeated rows are all whitened and fitted
once; rows with a null id are kept; where the fit list has rank r, there are r components (one distinct vector: none, so no
rows); a deviation that no long holds is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, materialise

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Largest x that takes part: sums over an Arrow batch stay inside a long.
LARGEST = 1 << 40
_EPS = float(np.finfo(float).eps)
_PIVOT = (1 + 17**0.5) / 8


def above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric `v` above `shift`: the positive inertia of v - shift I, by LDL' with 1 x 1 and 2 x 2 pivots."""
    a = v - shift * np.eye(len(v))
    positive = 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = 1 + int(column.argmax()) if len(column) else 0
        most = float(column[r - 1]) if len(column) else 0.0
        size, swap = 1, None
        if abs(a[0, 0]) < _PIVOT * most:
            other = np.abs(a[r])
            other[r] = 0.0
            beside = float(other.max())
            if abs(a[0, 0]) * beside < _PIVOT * most * most:
                size, swap = (1, (0, r)) if abs(a[r, r]) >= _PIVOT * beside else (2, (1, r))
        if swap and swap[0] != swap[1]:
            order = np.arange(len(a))
            order[[swap[0], swap[1]]] = order[[swap[1], swap[0]]]
            a = a[np.ix_(order, order)]
        if size == 1:
            pivot, c = a[0, 0], a[1:, 0]
            positive += pivot > 0
            a = a[1:, 1:] - np.outer(c, c / pivot) if pivot else a[1:, 1:]
        else:  # one eigenvalue on each side
            positive += 1
            c = a[2:, :2]
            a = a[2:, 2:] - c @ np.linalg.solve(a[:2, :2], c.T)
    return int(positive)


def rayleigh(v: np.ndarray, shift: float, found: np.ndarray, seed: int, rounds: int = 30) -> tuple[float, np.ndarray]:
    """An eigenvalue near `shift` and its unit vector, orthogonal to the columns of `found`."""
    size, scale = len(v), np.abs(v).sum(axis=0).max()
    x = np.random.default_rng(seed).standard_normal(size)

    def tidy(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - found @ (found.T @ x)
            x = x / np.linalg.norm(x)
        return x

    x, least, best = tidy(x), np.inf, None
    for step in range(rounds):
        s = shift if step < 2 else float(x @ v @ x)
        try:
            y = np.linalg.solve(v - s * np.eye(size), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(v - (s + 4 * _EPS * scale) * np.eye(size), x)
        x = tidy(y)
        value = float(x @ v @ x)
        left = float(np.linalg.norm(v @ x - value * x))
        if left < least:
            least, best = left, (value, x)
        elif step > 3 and least <= 100 * size * _EPS * scale:
            break  # it gets no better
    return best


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """The `k` largest eigenvalues of a covariance, falling, their unit vectors as columns, and for each the interval whose
    counts certify its number; fewer than `k` where the rest is zero to rounding."""
    size = len(v)
    top = float(np.abs(v).sum(axis=0).max()) if size else 0.0
    if not top:
        return np.zeros(0), np.zeros((size, 0)), []
    finest, floor = 4 * size * _EPS * top, 16 * size * _EPS * top
    counts = {floor: above(v, floor), 2 * top: 0}
    values, vectors, certified = [], np.zeros((size, 0)), []
    k = min(k, counts[floor])
    while len(values) < k:
        number = len(values) + 1
        lo = max(s for s, n in counts.items() if n >= number)
        hi = min(s for s, n in counts.items() if n < number)
        alone = counts[lo] == number and counts[hi] == number - 1
        if alone or hi - lo <= finest:
            value, x = rayleigh(v, (lo + hi) / 2, vectors, number)
            slack = 0.0 if alone else finest
            if lo - slack < value <= hi + slack or hi - lo <= finest:
                values.append(value)
                vectors = np.column_stack([vectors, x if x[np.abs(x).argmax()] > 0 else -x])
                certified.append((lo, hi))
                continue
        middle = (lo + hi) / 2
        counts[middle] = above(v, middle)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order], certified


def entries(v: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """x = floor(scale * c) + shift of each entry."""
    return F.transform(v.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("bigint") + F.lit(shift).cast("bigint"))


def usable(v: Column, scale: int = SCALE) -> Column:
    """True for vectors that take part, whatever their length."""
    bad = F.exists(v.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST / scale))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of each dimension
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    certified: list[tuple[float, float]]
    scale: int
    shift: int
    identity_error: float = 0.0

    def __post_init__(self) -> None:
        self.middle = np.array([round(s / self.n) if abs(s) < 1 << 52 else s // self.n for s in self.sums], dtype=np.int64)
        self.rest = [self.n * int(m) - s for m, s in zip(self.middle, self.sums)]  # n * x - S = n * (x - middle) + rest
        self.axes = self.vectors / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the integer part is taken off exactly, the fraction in double precision."""
        return (x - self.middle) + np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x-S)^2, exact; None where it is no long."""
        y = x - self.middle
        most = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * y + np.array(self.rest)) ** 2).sum(axis=1).tolist()
        exact = (sum((self.n * v + r) ** 2 for v, r in zip(row, self.rest)) for row in y.tolist())
        return [e if e < 1 << 63 else None for e in exact]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _totals(rows: DataFrame, of, cast: str) -> list:
    """Sums over all batches of the numbers that `of` makes of a batch's matrix, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = of(_matrix(batch.column(0))).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made), dtype=np.int32)), pa.array(made)], ["place", "part"])

    kind = "bigint" if cast.startswith("decimal") else "double"
    summed = rows.select("x").mapInArrow(run, f"place int, part {kind}").groupBy("place").agg(F.sum(F.col("part").cast(cast)).alias("total"))
    return [r.total for r in sorted(summed.collect(), key=lambda r: r.place)]  # a number for each (pair of) dimensions


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """Mean, covariance and leading components of the distinct x-vectors; None where no vector takes part."""
    check_columns(vectors, vector_col)
    v = F.col(vector_col)
    taken = vectors.where(usable(v, scale))
    size = taken.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return None
    listed = materialise(taken.where(F.size(v) == size.d).select(entries(v, scale, shift).alias("x")).distinct(), "whitening_fit")
    head = [int(t) for t in _totals(listed, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "decimal(38,0)")]
    plain = Whitening(head[0], head[1:], np.ones(0), np.zeros((size.d, 0)), 0.0, [], scale, shift)
    upper = np.triu_indices(size.d)

    def products(x: np.ndarray) -> np.ndarray:
        c = plain.centred(x)
        return (c.T @ c)[upper]

    v = np.zeros((size.d, size.d))
    v[upper] = np.array(_totals(listed, products, "double")) / plain.n
    v = v + np.triu(v, 1).T
    values, axes, certified = leading(v, components)
    made = Whitening(plain.n, plain.sums, values, axes, float(np.trace(v)), certified, scale, shift)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = made.centred(x) @ made.axes
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    if k:
        sums = np.array(_totals(listed, moments, "double")) / made.n
        made.identity_error = float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())
    return made


def whiten(vectors: DataFrame, made: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, deviation and whitened (an array, a number for each component) of each vector that takes part."""
    check_columns(vectors, id_col, vector_col)
    v = F.col(vector_col)
    rows = vectors.where(usable(v, made.scale) & (F.size(v) == len(made.sums))).select(F.col(id_col).cast("bigint").alias("id"), entries(v, made.scale, made.shift).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                w = made.centred(x) @ made.axes
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.deviations(x), pa.int64()), flat], ["id", "deviation", "whitened"])

    return rows.mapInArrow(run, "id bigint, deviation bigint, whitened array<double>")


def components(vectors: DataFrame, made: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`whiten` with a row for each component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    share = F.array(*[F.lit(float(e / made.trace)) for e in made.values]) if len(made.values) else F.array().cast("array<double>")
    return whiten(vectors, made, id_col, vector_col).select("id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "id", (F.col("place") + 1).alias("component"), F.lit(made.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(share, F.col("place")).alias("explained"), F.lit(made.identity_error).alias("identity_error"),
    )
