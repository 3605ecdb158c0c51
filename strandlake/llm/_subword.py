"""Subword ids of scanned words, encoded once per distinct word and expanded by array lookups."""

from __future__ import annotations

import os

import numpy as np
import xxhash

from strandlake.llm._text import Words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


#: A control character that stands between words encoded as one text, and words of such a text.
MARK, JOINED = "\x01", 128


class Subwords:
    """Ids of words under a public tokenizer whose pre-tokenizer never crosses ASCII white
    space and which lower-cases, so that a text's ids are those of its words end to end.

    ``limit`` bounds the words remembered; beyond it the memory is emptied.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._limit = limit
        alone = self._tok.encode(MARK, add_special_tokens=False).ids
        self._mark = alone[0] if len(alone) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self._known = np.zeros(0, np.uint64)
        self._at = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.uint32)

    def _ids(self, words: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words end to end, how many each has).  Many words are one text, between
        marks that no word holds; a word that holds a mark is encoded by itself."""
        encode = getattr(self._tok, "encode_batch_fast", self._tok.encode_batch)
        between = b" " + MARK.encode() + b" "
        joined = [between.join([*words[i : i + JOINED], b""]) for i in range(0, len(words), JOINED)]
        if self._mark is None or sum(x.count(MARK.encode()) for x in joined) > len(words):
            ids = [e.ids for e in encode([bytes(x).decode("utf-8", "replace") for x in words], add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((x for part in ids for x in part), np.uint32, int(size.sum())), size
        flat = np.concatenate([np.array(encode([x.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32) for x in joined])
        ends = np.flatnonzero(flat == self._mark)
        size = np.diff(ends, prepend=-1) - 1
        return np.delete(flat, ends), size

    def _learn(self, hashes: np.ndarray, words: list[memoryview]) -> None:
        flat, size = self._ids(words)
        at = len(self._pool) + np.cumsum(size) - size
        self._pool = np.concatenate([self._pool, flat])
        spot = np.searchsorted(self._known, hashes)  # both ascend
        self._known = np.insert(self._known, spot, hashes)
        self._at = np.insert(self._at, spot, at)
        self._size = np.insert(self._size, spot, size)

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words in order, and the offsets of each word's ids."""
        h = w.h
        marks = np.flatnonzero((w.buf[:-1] == 60) & (w.buf[1:] == 124)) if len(w.buf) > 1 else []
        if len(marks):  # "<|" may begin a control string, whose case matters
            h = h.copy()
            for i in np.unique(np.searchsorted(w.start, marks, "right") - 1):
                h[i] = xxhash.xxh3_64_intdigest(w.buf[w.start[i] : w.end[i]].tobytes(), seed=7)
        distinct, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self._known) > self._limit:
            self._clear()
        spot = np.searchsorted(self._known, distinct)
        new = np.ones(len(distinct), bool)
        inside = spot < len(self._known)
        new[inside] = self._known[spot[inside]] != distinct[inside]
        if new.any():
            mine, text = sample[new], memoryview(np.ascontiguousarray(w.buf))
            self._learn(distinct[new], [text[a:b] for a, b in zip(w.start[mine].tolist(), w.end[mine].tolist(), strict=True)])
            spot = np.searchsorted(self._known, distinct)
        spot = spot[inverse]
        size = self._size[spot]
        offsets = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(offsets[-1]) + np.repeat(self._at[spot] - offsets[:-1], size)
        return self._pool[take], offsets


_loaded: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """The encoder of a tokenizer file, kept while the Python worker lives."""
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]
