"""Harmonic packing of token sequences.

A length L belongs to the reciprocal-capacity class k = capacity // L: k such pieces share
one sequence.  Since texts may be cut, every document is cut so that its pieces lie at the
top of their class: whole sequences first, then greedily the longest capacity // k that
still fits, down to a short tail, which is its own class.  All pieces of a class are then
equally long, a bin is full after exactly k of them and wastes less than one length of at
most ``tail`` tokens or less than k tokens.  Every task fills its own bins, so packing
needs no shuffle and no coordination.  Bins still open at the end of a task (less than one
per class) are emptied end to end into full sequences, and the rest into sequences whose
sizes are powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandlake.llm._spark import dealt
from strandlake.llm._subword import subwords
from strandlake.llm._text import scan, slices

END_ID = 2
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
_TASK = 1 << 36


@lru_cache(maxsize=8)
def cut_lengths(capacity: int, tail: int) -> tuple[tuple[int, ...], ...]:
    """For every rest below capacity, the piece lengths it is cut into."""
    cuts = []
    for rest in range(capacity):
        parts = []
        while rest > tail:
            length = capacity // -(-capacity // rest)
            parts.append(length)
            rest -= length
        cuts.append((*parts, rest) if rest else tuple(parts))
    return tuple(cuts)


class Bins:
    """The open bins of one task. ``add`` and ``flush`` append rows to ``out``."""

    def __init__(self, capacity: int, tail: int, first_id: int):
        self.capacity, self.next_id, self.out = capacity, first_id, []
        self._cuts = cut_lengths(capacity, tail)
        self._open: dict[int, list] = {}

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), total, self.next_id, at, ids.tobytes()))
            at += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        full, rest = divmod(len(ids), self.capacity)
        at = 0
        for length in (self.capacity,) * full + self._cuts[rest]:
            bin_ = self._open.setdefault(length, [])
            bin_.append((doc, at, ids[at : at + length], len(ids)))
            at += length
            if len(bin_) == self.capacity // length:
                self._emit(self._open.pop(length))

    def flush(self) -> None:
        """Empties the open bins: cut freely into full sequences, then powers of two."""
        left = [p for length in sorted(self._open, reverse=True) for p in self._open[length]]
        self._open = {}
        tokens = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (tokens // self.capacity)
        rest = tokens % self.capacity
        sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        at, k = 0, 0
        for size in sizes:
            pieces = []
            while size:
                doc, start, ids, total = left[k]
                part = ids[at : at + size]
                pieces.append((doc, start + at, part, total))
                size -= len(part)
                at += len(part)
                if at == len(ids):
                    at, k = 0, k + 1
            self._emit(pieces)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, tail: int = 64, end_id: int = END_ID) -> DataFrame:
    """Packs the texts of docs (doc_id, text) into sequences of at most ``capacity`` ids.

    Returns one row per piece: doc_id, start (ids of its document before it), length,
    doc_tokens, sequence_id, offset in the sequence, and the ids as little-endian
    unsigned 32-bit numbers.  Every id of a document, the end id included, lies in exactly
    one piece.  A null or empty text is its end id alone; repeated rows are packed as
    often as they occur; a null doc_id stays null; other columns are ignored; an empty
    table gives an empty result.  Memory is bounded by the open bins and one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        bins = Bins(capacity, tail, (context.partitionId() if context else 0) * _TASK)
        encoder = subwords(tokenizer_path)

        def rows(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in slices(batches):
            w = scan(batch.column(1))
            flat, at = encoder.encode(w)
            bounds = at[w.first]
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                bins.add(doc, ids)
            if bins.out:
                yield rows(bins.out)
                bins.out = []
        bins.flush()
        if bins.out:
            yield rows(bins.out)

    return dealt(docs.select("doc_id", "text")).mapInArrow(run, SCHEMA)
