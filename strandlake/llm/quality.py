"""Document quality by a regularised quadratic discriminant.

Each text is described by transformed statistics.  For either class a mean and a
covariance, shrunk towards its diagonal, are estimated; a text's discriminant is the
difference of the two log densities, taken from Mahalanobis distances with Cholesky factors
kept in the model.  A two-parameter logistic curve turns it into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm import _fit
from strandlake.llm._text import SPACE, Words, column_bytes, scan, segment_sums, shingles

#: Most labelled rows the discriminant is fitted on.
MAX_TRAINING_ROWS = 50_000


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log((part + 1/2) / (rest + 1/2)), damped for short texts by the constants."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _distinct_per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n).astype(np.float64)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; an empty or null text has finite ones too."""
    buf, off = column_bytes(texts)
    w: Words = scan(texts)
    n = len(texts)
    size = np.diff(off).astype(np.float64)

    def chars(mask: np.ndarray) -> np.ndarray:
        return segment_sums(mask[buf].astype(np.int64), off).astype(np.float64)

    table = np.zeros((6, 256), bool)
    table[0, 65:91] = True
    table[1, 48:58] = True
    table[2, [33, 35, 36, 37, 38, 42, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]] = True
    table[3, [44, 46]] = True
    table[4, 10] = True
    table[5, 97:123] = True
    upper, digits, symbols, stops, lines, lower = (chars(t) for t in table)
    spaces = chars(SPACE)
    count = w.counts.astype(np.float64)
    row = w.row
    length = (w.end - w.start).astype(np.float64)
    last = w.buf[w.end - 1] if len(w.h) else np.zeros(0, np.uint8)
    begin = w.buf[w.start] if len(w.h) else last

    def words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=n).astype(np.float64)

    marked = words(table[2][last])
    capital = words(table[0][begin])
    again = np.zeros(len(w.h), bool)
    again[1:] = (w.h[1:] == w.h[:-1]) & (row[1:] == row[:-1])
    distinct = _distinct_per_row(w.h, row, n)
    threes, at = shingles(w, 3)
    n_threes = np.bincount(at, minlength=n).astype(np.float64)
    d_threes = _distinct_per_row(threes, at, n)
    mean = np.bincount(row, length, n) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, length * length, n) / np.maximum(count, 1) - mean * mean, 0))
    return np.column_stack(
        [
            np.log1p(count),
            np.log1p(mean),
            np.log1p(spread),
            _share(upper, upper + lower),
            _share(digits, size),
            _share(symbols, size),
            _share(stops, size),
            _share(spaces, size),
            np.log1p(lines) - np.log1p(count),
            _share(marked, count),
            _share(capital, count),
            _share(words(again), count),
            _share(count - distinct, count),
            _share(n_threes - d_threes, n_threes),
        ]
    )


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of both classes, and the logistic curve."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    curve: tuple[float, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        half = [0.5 * (((z - m) @ f.T) ** 2).sum(1) + d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        gap = half[0] - half[1]
        return np.sign(gap) * np.log1p(np.abs(gap))

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -700, 700)))


@dataclass
class Constant:
    """Where a class has fewer than two training rows."""

    p: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def fit_discriminant(x: np.ndarray, y: np.ndarray, shrinkage: float = 0.1, ridge: float = 1e-2) -> Discriminant | Constant:
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Constant((y.sum() + 0.5) / (len(y) + 1))
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - centre) / scale
    means, factors, dets = [], [], []
    for c in (0, 1):
        part = z[y == c]
        cov = np.cov(part.T)
        alpha = min(1.0, shrinkage + x.shape[1] / len(part))
        cov = (1 - alpha) * cov + alpha * np.diag(np.diag(cov)) + ridge * np.eye(len(cov))
        chol = np.linalg.cholesky(cov)
        means.append(part.mean(0))
        factors.append(np.linalg.inv(chol))
        dets.append(np.log(np.diag(chol)).sum() - np.log(len(part)))
    model = Discriminant(centre, scale, np.array(means), np.array(factors), np.array(dets), (1.0, 0.0))
    model.curve = _logistic(model.raw(x), y)
    return model


def _logistic(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for a slope and an intercept, with a light prior on the slope."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g = np.array([((p - y) * s).sum() + 0.1 * (a - 1), (p - y).sum() + 0.01 * b])
        v = p * (1 - p)
        hess = np.array([[(v * s * s).sum() + 0.1, (v * s).sum()], [(v * s).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAINING_ROWS) -> Discriminant | Constant:
    """Fits on at most ``most`` labelled documents outside the held-out fold."""
    rows = _fit.training_rows(docs, labels, label, most)
    vectors, y = _fit.collect_vectors(_fit.vectors_of(rows, lambda texts: [v.tobytes() for v in statistics(texts)]))
    return fit_discriminant(np.array([np.frombuffer(v) for v in vectors] or np.zeros((0, 1))), y)


def quality_scores(docs: DataFrame, model: Discriminant | Constant, keep: list[str] | None = None, passing: float | None = None) -> DataFrame:
    """docs with quality_score, the probability of good quality, 0 to 1.

    Null and empty texts are scored by the same statistics, all zero counts; repeated rows
    score alike; an empty table gives no rows; without two labelled rows of either class
    the score is the same for all.  Other columns stay, unless ``keep`` names fewer.
    """
    return _fit.add_scores(docs, lambda texts: model.score(statistics(texts)), "quality_score", keep, passing)
