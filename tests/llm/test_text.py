import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from strandlake.llm import _text

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbé \t\n.<|\x1c "), max_size=20)), max_size=6)


@given(texts)
def test_words(rows):
    for separators, pattern in ((_text.SPACE, r"[^\x20\x09-\x0D]+"), (_text.NON_ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        w = _text.scan(pa.array(rows, pa.string()), separators)
        want = [re.findall(pattern, r or "") for r in rows]
        assert w.counts.tolist() == list(map(len, want))
        flat = [x for r in want for x in r]
        assert [w.text(i) for i in range(len(w.h))] == flat
        hashes = {}
        for word, h in zip(flat, w.h.tolist(), strict=True):
            assert hashes.setdefault(word.translate(FOLD), h) == h
        assert len(set(hashes.values())) == len(hashes)


def test_long_words_and_chunks(monkeypatch):
    monkeypatch.setattr(_text, "CHUNK", 16)
    rows = ["aaa bb " * 9, "X" * 40 + " b", "x" * 40]
    w = _text.scan(pa.array(rows))
    small = _text.scan(pa.array(["aaa bb b"]))
    assert w.h[0] == small.h[0] == w.h[16] and w.h[1] == small.h[1]
    assert w.h[18] == w.h[20]


def test_shingle_sets():
    values, at = _text.shingle_sets(_text.scan(pa.array(["a b c d", "A b C", "a b", "A B", "", None, "a b c a b c"])), 3)
    sets = [set(values[i:j].tolist()) for i, j in zip(at[:-1], at[1:], strict=True)]
    assert list(map(len, sets)) == [2, 1, 1, 1, 0, 0, 3]
    assert sets[1] < sets[0] and sets[2] == sets[3] and not sets[2] & sets[0]


def test_slices_keep_rows():
    b = pa.record_batch({"text": ["x" * n for n in (5, 50, 0, 5)]})
    parts = list(_text.slices([b], limit=10))
    assert pa.Table.from_batches(parts).to_pydict() == b.to_pydict() and len(parts) > 1
    assert np.array_equal(_text.segment_sums(np.array([1, 2, 3]), np.array([0, 0, 2, 3])), [0, 3, 3])


def test_words_whose_polynomials_collide_modulo_two_to_the_64():
    one, two = ("".join("ab"[(i.bit_count() + x) % 2] for i in range(1024)) for x in (0, 1))
    h = _text.scan(pa.array([one, two, one[:700] + two[700:], one.upper()])).h
    assert len(set(h[:3].tolist())) == 3 and h[3] == h[0]


def test_places_beyond_the_table():
    words = ["a" * 31 + "b", "a" * 32 + "b", "a" * 63 + "b", "a" * 64 + "b", "b" + "a" * 31, "a" * 32 + "b" + "a" * 31, "b" + "a" * 63, "a" * 64, "a" * 32]
    assert len(set(_text.scan(pa.array(words)).h.tolist())) == len(words)
