"""Toxicity by a factorization machine over hashed terms.

Terms (words of [0-9A-Za-z] and non-ASCII, A-Z lower-cased, and the beginnings of longer
words) are hashed to 2**18 indices, present or not.  Indices whose share of toxic documents differs clearly from the rest's in the
training rows are kept; over these a second-order factorization machine is fitted, whose
factors give every pair of terms a weight, so that terms harmless alone count together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import _fit
from strandlake.llm._spark import stash
from strandlake.llm._text import NON_ALNUM, hash_ranges, mix, scan

#: Most labelled rows the machine is fitted on.
MAX_TRAINING_ROWS = 20_000
BITS = 18
#: Besides words, their first so many bytes are terms, so that inflected forms share one.
PREFIXES = (4, 5, 6)
#: Indices kept: at most so many, in at least so many training documents, and by so many
#: standard deviations more or less frequent among the toxic.
MAX_TERMS, LEAST_DOCUMENTS, DEVIATIONS = 512, 4, 4.0


def term_ids(texts: pa.Array, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of every text, flat, with their rows; with ``slot``, the slots
    of those terms that have one."""
    w = scan(texts, NON_ALNUM)
    row = w.row.astype(np.int64)
    flat, rows = [], []
    for size in (0, *PREFIXES):
        longer = np.flatnonzero(w.end - w.start > size) if size else np.arange(len(w.h))
        h = hash_ranges(w.buf, w.start[longer], w.start[longer] + size) if size else w.h
        ids = (mix(h, 3 + size) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        at = row[longer]
        if slot is not None:
            ids = slot[ids].astype(np.int64)
            at, ids = at[ids >= 0], ids[ids >= 0]
        flat.append(ids)
        rows.append(at)
    both = np.unique((np.concatenate(rows) << BITS) | np.concatenate(flat))
    return both & ((1 << BITS) - 1), both >> BITS


@dataclass
class Machine:
    """bias + w.x + sum over pairs of <v_i, v_j> x_i x_j over the kept indices."""

    slot: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        ids, rows = term_ids(texts, self.slot)
        n = len(texts)
        z = self.bias + np.bincount(rows, self.w[ids], n)
        for f in range(self.v.shape[1]):
            part = self.v[ids, f]
            z += 0.5 * (np.bincount(rows, part, n) ** 2 - np.bincount(rows, part * part, n))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def choose_terms(seen: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """The kept indices, by the size of their deviation, from the documents and the toxic
    documents that have each, and the share of toxic ones of all."""
    deviation = (toxic - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    keep = np.flatnonzero((seen >= LEAST_DOCUMENTS) & (np.abs(deviation) >= DEVIATIONS))
    return keep[np.argsort(-np.abs(deviation[keep]), kind="stable")][:MAX_TERMS]


def count_terms(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each index, the rows and the toxic rows that have it."""
    size = 1 << BITS
    none = [np.zeros(0, np.int64)]
    return tuple(np.bincount(np.concatenate([*part, *none]).astype(np.int64), minlength=size) for part in (rows, [r for r, t in zip(rows, y, strict=True) if t]))


def fit_machine(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray | None = None, factors: int = 8, steps: int = 200, rate: float = 0.05, penalty: float = 2e-4) -> Machine:
    """Fits by Adam on the whole sample, logistic loss with a quadratic penalty, over ``terms`` or
    those that choose_terms keeps of the rows."""
    if terms is None:
        terms = choose_terms(*count_terms(rows, y), y.mean() if len(y) else 0.0)
    slot = np.full(1 << BITS, -1, np.int32)
    slot[terms] = np.arange(len(terms))
    x = np.zeros((len(rows), len(terms)), np.float32)
    for i, r in enumerate(rows):
        at = slot[r]
        x[i, at[at >= 0]] = 1
    prior = (y.sum() + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(11)
    params = [np.array([np.log(prior / (1 - prior))]), np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), factors))]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    if len(terms) and 0 < y.sum() < len(y):
        for t in range(1, steps + 1):
            bias, w, v = params
            sums = x @ np.column_stack([w, (v * v).sum(1), v]).astype(np.float32)  # x is 0 or 1
            xv = sums[:, 2:]
            z = bias + sums[:, 0] + 0.5 * ((xv * xv).sum(1) - sums[:, 1])
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
            back = x.T @ np.column_stack([e, e[:, None] * xv]).astype(np.float32)
            grads = [np.array([e.sum()]), back[:, 0] + penalty * w, back[:, 1:] - back[:, :1] * v + penalty * v]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Machine(slot, float(params[0][0]), params[1], params[2])


def _vectors(texts: pa.Array) -> list[bytes]:
    ids, rows = term_ids(texts)
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [ids[bounds[i] : bounds[i + 1]].astype(np.int32).tobytes() for i in range(len(texts))]


COUNTS = "term int, seen long, toxic long"


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAINING_ROWS) -> Machine:
    """Fits on at most ``most`` labelled documents outside the held-out fold.  Terms are counted
    where the rows are; only counts, at most one a hashed index, and the rows' kept terms, at
    most MAX_TERMS each, reach the driver."""
    vectors = stash(_fit.vectors_of(_fit.training_rows(docs, labels, label, most), _vectors))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            part = count_terms([np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(0)], batch.column(1).to_numpy())
            seen += np.stack(part)
        met = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(seen[0][met]), pa.array(seen[1][met])], ["term", "seen", "toxic"])

    counts = vectors.select("x", "label").mapInArrow(counted, COUNTS).groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, 1 << BITS), np.int64)
    seen[:, counts["term"].to_numpy()] = counts["seen"].to_numpy(), counts["toxic"].to_numpy()
    share = vectors.agg(F.avg("label")).first()[0] or 0.0
    terms = choose_terms(seen[0], seen[1], share)
    kept = np.zeros(1 << BITS, bool)
    kept[terms] = True

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[kept[r]].tobytes() for r in rows], pa.binary()), batch.column(2)], ["doc_id", "x", "label"])

    rows, y = _fit.collect_vectors(vectors.mapInArrow(reduced, "doc_id long, x binary, label int"))
    return fit_machine([np.frombuffer(v, np.int32) for v in rows], y, terms)


def toxicity_scores(docs: DataFrame, model: Machine, keep: list[str] | None = None, passing: float | None = None) -> DataFrame:
    """docs with toxicity_score, the probability of toxicity, 0 to 1.

    Null and empty texts have no terms and score the bias; repeated rows score alike; an
    empty table gives no rows; without labelled rows of both classes the score is the same
    for all.  Other columns stay, unless ``keep`` names fewer.
    """
    return _fit.add_scores(docs, model.score, "toxicity_score", keep, passing)
