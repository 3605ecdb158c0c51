"""Algorithms on single sequences: alignment, hidden Markov models, suffix arrays."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "score int, te int, qe int, score2 int, te2 int, tb int, qb int"


def _local_ends(q: np.ndarray, t: np.ndarray, match: int, mismatch: int, gap_open: int, gap_extend: int) -> tuple[np.ndarray, np.ndarray]:
    """Per target position: the best score of a local alignment that ends there, and its
    query position.  Rows run over the query; the gap along the target, whose best cost is
    a running maximum, is one cumulative maximum."""
    m = len(t)
    h, f = np.zeros(m + 1, np.int64), np.full(m + 1, -(10**9), np.int64)
    best, at = np.zeros(m, np.int64), np.full(m, -1, np.int64)
    ramp = np.arange(m + 1) * gap_extend
    for i, c in enumerate(q):
        f = np.maximum(f, h - gap_open) - gap_extend
        new = np.zeros(m + 1, np.int64)
        new[1:] = np.maximum(0, np.maximum(h[:-1] + np.where(t == c, match, -mismatch), f[1:]))
        reach = np.maximum.accumulate(new + ramp)
        new[1:] = np.maximum(new[1:], reach[:-1] - gap_open - ramp[1:])
        h = new
        better = h[1:] > best
        best[better], at[better] = h[1:][better], i
    return best, at


def align_local(query: str, target: str, match: int = 2, mismatch: int = 3, gap_open: int = 5, gap_extend: int = 2) -> tuple[int, ...]:
    """(score, te, qe, score2, te2, tb, qb): the best local alignment with affine gaps, its
    ends and begins, and the best score that ends elsewhere on the target.

    Ends elsewhere are those farther than the score over the match from te; -1 for none."""
    q, t = (np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in (query, target))
    if not len(q) or not len(t):
        return 0, -1, -1, -1, -1, -1, -1
    best, at = _local_ends(q, t, match, mismatch, gap_open, gap_extend)
    te = int(best.argmax())
    score, qe = int(best[te]), int(at[te])
    if score == 0:
        return 0, -1, -1, -1, -1, -1, -1
    back, place = _local_ends(q[qe::-1], t[te::-1], match, mismatch, gap_open, gap_extend)
    first = int(np.flatnonzero(back == score)[0])
    apart = np.abs(np.arange(len(t)) - te) > max(score // match, 1)
    far = np.where(apart, best, -1)
    te2 = int(far.argmax())
    score2 = int(far[te2])
    return score, te, qe, score2, te2 if score2 > 0 else -1, te - first, qe - int(place[first])


def align_global(query: str, target: str, match: int = 2, mismatch: int = 3, gap_open: int = 5, gap_extend: int = 2) -> tuple[int, str]:
    """(score, CIGAR) of a whole alignment with affine gaps: I of the query, D of the target."""
    n, m, low = len(query), len(target), -(10**9)
    best = [[low] * (m + 1) for _ in range(n + 1)]  # ends in a match, a deletion or an insertion
    dele = [[low] * (m + 1) for _ in range(n + 1)]
    ins = [[low] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if j:
                dele[i][j] = max(best[i][j - 1] - gap_open, dele[i][j - 1]) - gap_extend
            if i:
                ins[i][j] = max(best[i - 1][j] - gap_open, ins[i - 1][j]) - gap_extend
            here = best[i - 1][j - 1] + (match if query[i - 1] == target[j - 1] else -mismatch) if i and j else best[i][j]
            best[i][j] = max(here, dele[i][j], ins[i][j])
    i, j, ops, state = n, m, [], "M"
    while i or j:
        if state == "M":
            if i and j and best[i][j] == best[i - 1][j - 1] + (match if query[i - 1] == target[j - 1] else -mismatch):
                ops.append("M")
                i, j = i - 1, j - 1
            else:
                state = "D" if best[i][j] == dele[i][j] else "I"
            continue
        ops.append(state)
        if state == "D":
            opened = dele[i][j] == best[i][j - 1] - gap_open - gap_extend
            j -= 1
        else:
            opened = ins[i][j] == best[i - 1][j] - gap_open - gap_extend
            i -= 1
        state = "M" if opened else state
    out, k = "", 0
    ops.reverse()
    while k < len(ops):
        run = next((x for x in range(k, len(ops)) if ops[x] != ops[k]), len(ops)) - k
        out += f"{run}{ops[k]}"
        k += run
    return best[n][m], out


def extend(query: str, target: str, seed: int = 0, match: int = 2, mismatch: int = 3, gap_open: int = 5, gap_extend: int = 2) -> tuple[int, int, int]:
    """(score, query bases, target bases) of the best extension from the begin of both."""
    q, t = (np.frombuffer(s.encode("latin-1", "replace"), np.uint8) for s in (query, target))
    low = -(10**9)
    ramp = np.arange(len(t) + 1) * gap_extend
    h = np.concatenate([[seed], seed - gap_open - ramp[1:]]).astype(np.int64)
    f = np.full(len(t) + 1, low, np.int64)
    best = (seed, 0, 0)
    for i, c in enumerate(q, 1):
        f = np.maximum(f, h - gap_open) - gap_extend
        new = f.copy()
        new[1:] = np.maximum(new[1:], h[:-1] + np.where(t == c, match, -mismatch))
        reach = np.maximum.accumulate(new + ramp)
        new[1:] = np.maximum(new[1:], reach[:-1] - gap_open - ramp[1:])
        h = new
        if h.max() > best[0]:
            best = (int(h.max()), i, int(h.argmax()))
    return best


def local_alignment(query: Column, target: Column, **scores: int) -> Column:
    """struct<score, te, qe, score2, te2, tb, qb> of two string columns."""

    @F.pandas_udf(LOCAL)
    def run(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = [align_local(a, b, **scores) if a is not None and b is not None else (None,) * 7 for a, b in zip(q, t, strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LOCAL.split(", ")]).astype("Int32")

    return run(query, target)


GLOBAL = "score int, cigar string"
EXTENDED = "score int, query_bases int, target_bases int"


def _struct_of(f: Callable, kind: str, integers: list[str], query: Column, target: Column) -> Column:
    names = [c.split()[0] for c in kind.split(", ")]

    @F.pandas_udf(kind)
    def run(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = [f(a, b) if a is not None and b is not None else (None,) * len(names) for a, b in zip(q, t, strict=True)]
        return pd.DataFrame(rows, columns=names).astype(dict.fromkeys(integers, "Int32"))

    return run(query, target)


def global_alignment(query: Column, target: Column, **scores: int) -> Column:
    """struct<score, cigar> of two string columns; null where one is."""
    return _struct_of(lambda a, b: align_global(a, b, **scores), GLOBAL, ["score"], query, target)


def extension(query: Column, target: Column, seed: int = 0, **scores: int) -> Column:
    """struct<score, query_bases, target_bases> of two string columns; null where one is."""
    return _struct_of(lambda a, b: extend(a, b, seed, **scores), EXTENDED, ["score", "query_bases", "target_bases"], query, target)


class HiddenMarkov:
    """start[k], step[k, l] and emit[k, symbol] of a hidden Markov model."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = (np.asarray(x, float) for x in (start, step, emit))

    def best_path(self, seen: np.ndarray) -> tuple[np.ndarray, float]:
        """The likeliest states and their log probability."""
        with np.errstate(divide="ignore"):
            a, b, p = np.log(self.step), np.log(self.emit), np.log(self.start)
        v = p + b[:, seen[0]]
        back = []
        for s in seen[1:]:
            through = v[:, None] + a
            back.append(through.argmax(0))
            v = through.max(0) + b[:, s]
        path = [int(v.argmax())]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        return np.array(path[::-1]), float(v.max())

    def forward(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward values and the scales, whose logs add up to the log likelihood."""
        f, scale = np.empty((len(seen), len(self.start))), np.empty(len(seen))
        for i, s in enumerate(seen):
            f[i] = (self.start if i == 0 else f[i - 1] @ self.step) * self.emit[:, s]
            scale[i] = f[i].sum()
            f[i] /= scale[i] or 1
        return f, scale

    def backward(self, seen: np.ndarray, scale: np.ndarray) -> np.ndarray:
        b = np.ones((len(seen), len(self.start)))
        for i in range(len(seen) - 2, -1, -1):
            b[i] = self.step @ (self.emit[:, seen[i + 1]] * b[i + 1]) / (scale[i + 1] or 1)
        return b

    def posterior(self, seen: np.ndarray) -> np.ndarray:
        f, scale = self.forward(seen)
        p = f * self.backward(seen, scale)
        return p / p.sum(1, keepdims=True)

    def expect(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, steps and emissions: sums over sequences make an EM step."""
        f, scale = self.forward(seen)
        b = self.backward(seen, scale)
        p = f * b
        steps = sum((f[i][:, None] * self.step * (self.emit[:, seen[i + 1]] * b[i + 1])[None] / scale[i + 1] for i in range(len(seen) - 1)), np.zeros_like(self.step))
        emit = np.zeros_like(self.emit)
        np.add.at(emit.T, seen, p)
        return p[0], steps, emit

    def updated(self, start: np.ndarray, steps: np.ndarray, emit: np.ndarray) -> HiddenMarkov:
        share = lambda x: x / np.maximum(x.sum(-1, keepdims=True), 1e-300)
        return HiddenMarkov(share(start), share(steps), share(emit))

    def simulate(self, n: int, seed: int = 0) -> tuple[list[int], list[int]]:
        """(states, symbols) of a random sequence."""
        rng = random.Random(seed)
        pick = lambda p: rng.choices(range(len(p)), p)[0]
        states, symbols = [], []
        for i in range(n):
            states.append(pick(self.start if i == 0 else self.step[states[-1]]))
            symbols.append(pick(self.emit[states[-1]]))
        return states, symbols


def suffix_array(text: str | bytes) -> np.ndarray:
    """Places of the suffixes in order, by doubling prefixes."""
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8).astype(np.int64)
    n, step = len(raw), 1
    rank = raw + 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        second = np.zeros(n, np.int64)
        second[: max(n - step, 0)] = rank[step:]
        order = np.lexsort((second, rank))
        new = np.concatenate([[1], 1 + np.cumsum((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            break
        step *= 2
    return order


def burrows_wheeler(text: str) -> tuple[str, int]:
    """The transform of a text with an end mark that sorts first and is left out, and the
    row of that mark."""
    order = [len(text), *suffix_array(text).tolist()] if text.isascii() else sorted(range(len(text) + 1), key=lambda i: text[i:])
    return "".join(text[i - 1] for i in order if i), order.index(0)


def suffixes(text: Column) -> Column:
    """array<int>: places of the suffixes of a text in bytewise order; null for null."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else suffix_array(t).astype(np.int32) for t in texts], dtype=object)

    return run(text)


def transformed(text: Column) -> Column:
    """struct<text, row>: the Burrows-Wheeler transform, its end mark left out, and that mark's row."""

    @F.pandas_udf("text string, row int")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else burrows_wheeler(t) for t in texts], columns=["text", "row"]).astype({"row": "Int32"})

    return run(text)


def _symbols(text: str, alphabet: str) -> np.ndarray:
    return np.array([alphabet.index(c) for c in text], np.int64)


def state_paths(model: HiddenMarkov, text: Column, alphabet: str) -> Column:
    """struct<path, logp>: the likeliest states of a text's symbols, a digit each (so at most
    ten states), and their log probability; null for a null or empty text."""

    @F.pandas_udf("path string, logp double")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            path, logp = model.best_path(_symbols(t, alphabet)) if t else (None, None)
            rows.append((None if path is None else "".join(map(str, path)), logp))
        return pd.DataFrame(rows, columns=["path", "logp"]).astype({"logp": "float64"})

    return run(text)


def likelihoods(model: HiddenMarkov, text: Column, alphabet: str) -> Column:
    """The log likelihood of a text under the model; null for a null or empty text."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([float(np.log(model.forward(_symbols(t, alphabet))[1]).sum()) if t else None for t in texts], dtype="float64")

    return run(text)


def fit_hidden_markov(texts: DataFrame, column: str, alphabet: str, model: HiddenMarkov, rounds: int = 5) -> HiddenMarkov:
    """Rounds of expectation and maximisation over all texts: each task sums its expected
    counts, and only these sums, whose size is the model's, reach the driver."""
    shapes = [model.start.shape, model.step.shape, model.emit.shape]
    sizes = [int(np.prod(s)) for s in shapes]
    for _ in range(rounds):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now: HiddenMarkov = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(sizes))
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    if t:
                        total += np.concatenate([np.ravel(x) for x in now.expect(_symbols(t, alphabet))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

        sums = texts.select(column).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")["v"].to_numpy()
        parts = np.split(sums, np.cumsum(sizes)[:-1])
        model = model.updated(*(x.reshape(s) for x, s in zip(parts, shapes, strict=True)))
    return model
