"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text, each a bounded sample of documents, fit a logistic model that minimises
the non-negative unbiased risk pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)). The class prior pi is estimated from the
same two samples: whatever part of the scores one looks at, the unlabelled sample holds at least pi times the
positives' share there, so the least ratio of the two shares over the top parts of a first model's scores bounds it.
Features are counted per document from the whole text, in vectorised tasks; the model is a few dozen numbers.

`SAMPLE` is the documented bound of each training sample; scoring and the samples' candidates cover all rows.

Defined results: null and empty texts have all-zero counts and get a score like any other; repeated rows are scored
one by one; with no positives or no unlabelled text the model scores all rows by the prior 0.5; an empty table gives
no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns

#: Rows of each of the two training samples at most.
SAMPLE = 10_000
_SYMBOLS, _PIPE = b"#*$%&|<>{}[]\\^~_=+@", b"|"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _MARKS = bytes(range(48, 58)), b".,;:"
_EXCLAIM = b"!?"
FEATURES = (
    "log_words", "word_length", "symbols", "pipes", "upper", "other_letters", "digits", "marks", "exclaims",
    "distinct_words", "distinct_pairs", "same_as_before", "line_words", "distinct_lines", "capitalised",
)


def features(text: str | None) -> list[float]:
    """The features of a whole text, each about 0 to 1 or a small logarithm."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    having = lambda signs: (len(data) - len(data.translate(None, signs))) / size
    upper, lower = having(_UPPER), having(_LOWER)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:]))
    return [
        np.log1p(len(words)), min(sum(map(len, words)) / n, 40) / 10, having(_SYMBOLS), having(_PIPE), upper / max(upper + lower, 1e-9),
        1 - upper - lower, having(_DIGITS), having(_MARKS), having(_EXCLAIM), len(set(words)) / n, len(set(pairs)) / max(1, len(pairs)),
        sum(a == b for a, b in pairs) / max(1, len(pairs)), np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        sum(w[:1].isupper() for w in words) / n,
    ]


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    check_columns(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["id", "x"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, x array<double>")


def sample(docs: DataFrame, ids: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Features of at most `limit` documents among `ids`, chosen by a hash of the id."""
    chosen = ids.select(F.col(id_col).alias("chosen")).where("chosen IS NOT NULL").distinct().orderBy(F.xxhash64("chosen", F.lit(5)), "chosen").limit(limit)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = feature_rows(texts.join(F.broadcast(chosen), F.col("id") == F.col("chosen"), "left_semi"), "id", "text").orderBy(F.xxhash64("id", F.lit(6)), "id").limit(2 * limit)
    found = [r.x for r in rows.collect()]
    return np.array(found, dtype=float).reshape(-1, len(FEATURES))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0), np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -40, 40)))


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.75) -> float:
    """Least ratio of the samples' shares above a threshold, over thresholds that keep `least` of the positives.

    Each ratio is raised by two standard errors, as the least of many noisy ratios would lie below the prior.
    """
    ratios = []
    for cut in np.quantile(positive, np.linspace(0, 1 - least, 26)):
        a, b = max(np.mean(positive >= cut), 1e-9), np.mean(unlabelled >= cut)
        error = np.sqrt(a * (1 - a) / len(positive) * (b / a) ** 2 + b * (1 - b) / len(unlabelled)) / a
        ratios.append(b / a + 2 * error)
    return float(np.clip(min(ratios), 0.05, 0.98))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased logistic risk: of positives as positives, and of negatives, estimated from the rest."""
    loss = lambda z: float(np.mean(np.logaddexp(0, z)))
    return prior * loss(-(p @ w)), loss(u @ w) - prior * loss(p @ w)


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, decay: float) -> np.ndarray:
    """Of both parts and the weights' decay; where the negatives' part is below zero, it alone is pushed back up."""
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    negative = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
    below = risk(w, p, u, prior)[1] < 0
    return (-negative if below else prior * (p.T @ (sp - 1)) / len(p) + negative) + decay * w


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1500, rate: float = 0.03, decay: float = 1e-3) -> Model:
    """The model of least non-negative risk. Deterministic: full batches, no random start."""
    if not len(positive) or not len(unlabelled):
        k = len(FEATURES)
        return Model(np.zeros(k), np.ones(k), np.zeros(3 * k + 1), 0.5)
    model = Model(unlabelled.mean(0), unlabelled.std(0) + 1e-6, np.zeros(0), 0.5)
    p, u = model.inputs(positive), model.inputs(unlabelled)

    def plain(w: np.ndarray) -> np.ndarray:
        return (p.T @ (_sigmoid(p @ w) - 1)) / len(p) + (u.T @ _sigmoid(u @ w)) / len(u) + decay * w

    first = _descend(plain, p.shape[1], 400, rate)
    prior = model.prior = estimate_prior(p @ first, u @ first)

    model.weights = _descend(lambda w: risk_gradient(w, p, u, prior, decay), p.shape[1], steps, rate)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row."""
    check_columns(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, score double")


def train(docs: DataFrame, positives: DataFrame, unlabelled: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id") -> Model:
    """`positives` and `unlabelled` hold ids of rows of `docs`."""
    return fit(sample(docs, positives, limit, id_col), sample(docs, unlabelled, limit, id_col))


def fold(id_: Column, folds: int = 4) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % folds
