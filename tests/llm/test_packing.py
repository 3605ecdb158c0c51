import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandlake.llm import packing
from strandlake.llm.queries import op1_packing, tokenizer_path

PATH = tokenizer_path()


def check(pieces, texts, capacity):
    """Every id in one piece, sequences gapless, padding small."""
    tok = Tokenizer.from_file(PATH)
    ids = [(d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for d, t in texts]
    parts, sequences = {}, {}
    for p in pieces:
        parts.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert set(parts) == {d for d, _ in ids}
    for doc, want in ids:
        mine = sorted(parts[doc], key=lambda p: p["start"])
        assert all(p["doc_tokens"] == len(want) for p in mine)
        assert b"".join(bytes(p["ids"]) for p in mine) == want.tobytes()
        assert [p["start"] for p in mine] == np.cumsum([0, *(p["length"] for p in mine)])[:-1].tolist()
    padding = total = 0
    for rows in sequences.values():
        rows.sort(key=lambda p: p["offset"])
        sizes = [p["length"] for p in rows]
        assert [p["offset"] for p in rows] == np.cumsum([0, *sizes])[:-1].tolist() and min(sizes) > 0
        n = sum(sizes)
        assert n <= capacity
        total += n
        padding += 0 if n & (n - 1) == 0 else capacity - n
    return padding / max(total, 1)


def test_whole_table(spark, sf_dir, documents):
    rows = [r.asDict() for r in packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH).collect()]
    assert check(rows, documents.items(), 4096) < 0.02
    digest = {(r.sequence_id, r.offset): r.ids_crc32 for r in op1_packing(spark, sf_dir).collect()}
    assert digest == {(r["sequence_id"], r["offset"]): zlib.crc32(bytes(r["ids"])) for r in rows}


@pytest.mark.parametrize("capacity", [16, 64, 100])
def test_edges(docs, capacity):
    texts = ["", None, "a", "One two THREE, don't!", "word " * 300, "<|endoftext|> x<|EndOfText|>y <|startoftext|>", "é́ İ ß  z q\x1cr", " \t\n "]
    rows = [r.asDict() for r in packing.pack(docs(*texts).coalesce(1), PATH, capacity, tail=4).collect()]
    check(rows, enumerate(texts), capacity)


def test_repeated_rows_and_null_ids(docs):
    rows = packing.pack(docs((1, "a b"), (1, "a b"), (None, "c")), PATH).collect()
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == ["1", "1", "None"]
    assert packing.pack(docs((1, "a")).limit(0), PATH).count() == 0


def test_cuts():
    for rest, cut in enumerate(packing.cut_lengths(4096, 64)):
        assert sum(cut) == rest and len(cut) <= 6
        assert all(4096 - 4096 // n * n < 64 for n in cut)
