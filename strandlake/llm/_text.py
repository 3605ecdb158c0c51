"""Vectorised word scanning over Arrow string columns, shared by the operators of this subpackage.

Words are found and hashed on the raw UTF-8 bytes with numpy, so a text costs a few
array passes and no Python object per word.  Separators are ASCII, hence a byte test
is exact.  A word's 64-bit hash is the sum of one random value for each pair of a byte and
its place in the word (A-Z share the values of a-z), taken from prefix sums and passed
through a finaliser together with the length; unlike a polynomial modulo 2**64 it has no
algebraic structure that makes chosen words collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of text hashed at a time; a longer word is hashed by itself.
CHUNK = 1 << 18
#: Bytes of text handed on at a time by ``slices``.
SLICE = 8 << 20

_rng = np.random.default_rng(20240607)
#: Values of bytes at the places modulo PLACES of a word, a place's 256 together.
PLACES = 32
_VALUES = _rng.integers(0, 1 << 64, (PLACES, 256), dtype=np.uint64)
_VALUES[:, 65:91] = _VALUES[:, 97:123]
_VALUES = _VALUES.ravel()

#: Bytes that end a word: ASCII white space, or everything ASCII but 0-9, A-Z and a-z.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = False
NON_ALNUM[128:] = False

def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; other salts give independent hashes of the same value."""
    h = h + U((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


@dataclass
class Words:
    """Words of a column: byte ranges and hashes; row i has words first[i]:first[i+1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int) -> str:
        return self.buf[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string (UTF-8) or binary column; a null row is empty."""
    binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
    texts = texts.cast(pa.large_binary() if binary else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if binary else "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def scan(texts: pa.Array, separators: np.ndarray = SPACE) -> Words:
    """Finds and hashes the words of every row."""
    buf, off = column_bytes(texts)
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(buf, z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    inside = ~separators[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = off[:-1][off[:-1] < n]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    return Words(buf, start, end, hash_ranges(buf, start, end), first)


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending, non-overlapping byte ranges; A-Z count as a-z."""
    out = np.empty(len(start), np.uint64)
    sums = np.zeros(CHUNK + 1, np.uint64)
    i = 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + CHUNK, "right")), i)
        if j == i:  # one word longer than a chunk
            word = buf[start[i] : end[i]].copy()
            upper = (word >= 65) & (word <= 90)
            word[upper] += 32
            out[i] = xxhash.xxh3_64_intdigest(word.tobytes())
            i += 1
            continue
        a, n = start[i], int(end[j - 1] - start[i])
        s, e = start[i:j] - a, end[i:j] - a
        place = np.arange(n, dtype=np.int32) - np.repeat(s.astype(np.int32), np.diff(s, append=n))
        values = _VALUES[((place & (PLACES - 1)) << 8) | buf[a : a + n]]
        if int((e - s).max()) > PLACES:
            far = np.flatnonzero(place >= PLACES)
            values[far] = mix(values[far] + (place[far] // PLACES).astype(np.uint64) * U(0x9E3779B97F4A7C15), 11)
        np.cumsum(values, out=sums[1 : n + 1])
        out[i:j] = sums[e] - sums[s]
        i = j
    return mix(out + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about ``limit`` bytes of text; one long text is a run of its own."""
    for batch in batches:
        _, off = column_bytes(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


_COEF = [int(x) | 1 for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64)]


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and their rows, repeats included, rows ascending.

    A row of fewer words, but not none, has its whole sequence as the one shingle.
    """
    row = w.row
    n = len(w.h)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if n >= k:
        full = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            full += w.h[j : n - k + 1 + j] * U(_COEF[j])
        whole = row[: n - k + 1] == row[k - 1 :]
        full, at = mix(full[whole]), row[: n - k + 1][whole]
    counts = w.counts
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        extra = np.empty(len(few), np.uint64)
        for x, r in enumerate(few):
            part = w.h[w.first[r] : w.first[r + 1]]
            extra[x : x + 1] = np.sum(part * np.array(_COEF[: len(part)], np.uint64), keepdims=True) + U(_COEF[32 + len(part)])
        full, at = np.concatenate([full, mix(extra)]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        full, at = full[order], at[order]
    return full, at


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, end to end, and row offsets."""
    values, at = shingles(w, k)
    rows = len(w.first) - 1
    bounds = np.searchsorted(at, np.arange(rows + 1))
    parts = [np.unique(values[bounds[i] : bounds[i + 1]]) for i in range(rows)]
    sizes = np.fromiter(map(len, parts), np.int64, rows)
    return (np.concatenate(parts) if parts else values), np.concatenate([[0], np.cumsum(sizes)])


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over offsets[i]:offsets[i+1], empty ranges included; unsigned sums wrap."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
