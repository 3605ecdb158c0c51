"""Compact codes of sequences and qualities, as Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-bit codes of bases and the symbols of the quality code.
BASES = "TCAG"
SYMBOLS = "#/7<BF"

_CODE = np.zeros(256, np.uint8)
for _base, _value in (("T", 0), ("U", 0), ("C", 1), ("A", 2), ("G", 3)):
    _CODE[ord(_base)] = _CODE[ord(_base.lower())] = _value
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_SYMBOL = {c: i for i, c in enumerate(SYMBOLS.encode())}


def pack(seq: str) -> bytes:
    """Four bases a byte, the first in the high bits, filled up with T."""
    codes = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    codes = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
    return (codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]).astype(np.uint8).tobytes()


def unpack(packed: bytes, start: int, end: int) -> str:
    """Bases [start, end) of a packed sequence."""
    raw = np.frombuffer(packed, np.uint8)[start // 4 : -(-end // 4)]
    codes = np.column_stack([raw >> 6, raw >> 4 & 3, raw >> 2 & 3, raw & 3]).ravel()
    return _LETTERS[codes[start % 4 : start % 4 + max(end - start, 0)]].tobytes().decode()


def pack3(seq: str) -> str:
    """Three bases a printable character, code plus 33, filled up with T."""
    codes = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    codes = np.concatenate([codes, np.zeros(-len(codes) % 3, np.uint8)]).reshape(-1, 3)
    return (33 + (codes[:, 0] << 4 | codes[:, 1] << 2 | codes[:, 2])).astype(np.uint8).tobytes().decode()


def unpack3(packed: str, start: int, end: int) -> str:
    raw = np.frombuffer(packed.encode(), np.uint8) - 33
    return _LETTERS[np.column_stack([raw >> 4, raw >> 2 & 3, raw & 3]).ravel()[start:end]].tobytes().decode()


def _runs(raw: bytes) -> list[tuple[int, int]]:
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return []
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return list(zip(a[starts].tolist(), np.diff(starts, append=len(a)).tolist(), strict=True))


def encode_quality(qual: str) -> bytes:
    """A mask byte of the symbols that gain by run lengths, then runs: of a masked symbol
    the symbol and its length less one (255 standing for 255 more), of others the copies.

    Characters outside SYMBOLS are an error: the code has no place for them.
    """
    raw = qual.encode()
    gain = [0] * 8
    runs = _runs(raw)
    for c, n in runs:
        if c not in _SYMBOL:
            raise ValueError(f"no quality symbol: {chr(c)!r}")
        gain[_SYMBOL[c]] += n - 2 - (n - 1) // 255
    mask = sum(1 << j for j in range(8) if gain[j] > 0)
    out = bytearray([mask])
    for c, n in runs:
        if mask >> _SYMBOL[c] & 1:
            out += bytes([c]) + b"\xff" * ((n - 1) // 255) + bytes([(n - 1) % 255])
        else:
            out += bytes([c]) * n
    return bytes(out)


def decode_quality(code: bytes, length: int) -> str:
    """The first ``length`` characters of an encoded quality."""
    mask, at, out = code[0] if code else 0, 1, bytearray()
    while at < len(code) and len(out) < length:
        c = code[at]
        at += 1
        if not mask >> _SYMBOL[c] & 1:
            out.append(c)
            continue
        n = 1
        while code[at] == 255:
            n += 255
            at += 1
        out += bytes([c]) * (n + code[at])
        at += 1
    return out[:length].decode()


def _each(f, kind: str):
    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run


def _flat(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets); a null one is empty."""
    raw = [t.encode("latin-1", "replace") if t is not None else b"" for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])


def _filled(texts: pd.Series, per: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all texts, each filled up to whole groups of ``per``, offsets of groups)."""
    flat, at = _flat(texts)
    groups = np.concatenate([[0], np.cumsum(-(-np.diff(at) // per))])
    codes = np.zeros(groups[-1] * per, np.uint8)
    codes[np.arange(len(flat)) + np.repeat(groups[:-1] * per - at[:-1], np.diff(at))] = _CODE[flat]
    return codes.reshape(-1, per), groups


def _cut(data: bytes, at: np.ndarray, texts: pd.Series) -> list[bytes | None]:
    return [data[i:j] if t is not None else None for i, j, t in zip(at[:-1].tolist(), at[1:].tolist(), texts, strict=True)]


def pack_2bit(seq: Column) -> Column:
    @F.pandas_udf("binary")
    def run(seq: pd.Series) -> pd.Series:
        c, at = _filled(seq, 4)
        return pd.Series(_cut((c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).astype(np.uint8).tobytes(), at, seq), dtype=object)

    return run(seq)


def _opened(data: np.ndarray, at: np.ndarray, shifts: tuple[int, ...], start: pd.Series, end: pd.Series) -> list[str]:
    """Bases [start, end) of each row of packed bytes, all rows in one pass."""
    per = len(shifts)
    letters = _LETTERS[np.column_stack([data >> s & 3 for s in shifts]).ravel()]
    have = np.diff(at) * per
    begin = np.clip(start.to_numpy(np.int64), 0, have)
    size = np.clip(end.to_numpy(np.int64), begin, have) - begin
    to = np.concatenate([[0], np.cumsum(size)])
    text = letters[np.arange(to[-1]) + np.repeat(at[:-1] * per + begin - to[:-1], size)].tobytes().decode()
    return [text[i:j] for i, j in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def _unpacked(packed: Column, start: Column, end: Column, shifts: tuple[int, ...], less: int) -> Column:
    @F.pandas_udf("string")
    def run(packed: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        there = packed.notna() & start.notna() & end.notna()
        mine = [x.encode() if isinstance(x, str) else bytes(x) for x in packed[there]]
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, mine), np.int64, len(mine)))])
        out = pd.Series([None] * len(packed), dtype=object)
        out[there.to_numpy()] = _opened(np.frombuffer(b"".join(mine), np.uint8) - np.uint8(less), at, shifts, start[there], end[there])
        return out

    return run(packed, start, end)


def unpack_2bit(packed: Column, start: Column, end: Column) -> Column:
    return _unpacked(packed, start, end, (6, 4, 2, 0), 0)


def pack_3(seq: Column) -> Column:
    @F.pandas_udf("string")
    def run(seq: pd.Series) -> pd.Series:
        c, at = _filled(seq, 3)
        made = _cut((33 + (c[:, 0] << 4 | c[:, 1] << 2 | c[:, 2])).astype(np.uint8).tobytes(), at, seq)
        return pd.Series([None if x is None else x.decode() for x in made], dtype=object)

    return run(seq)


def unpack_3(packed: Column, start: Column, end: Column) -> Column:
    return _unpacked(packed, start, end, (4, 2, 0), 33)


def encode_quality_rle(qual: Column) -> Column:
    return _each(encode_quality, "binary")(qual)


def decode_quality_rle(code: Column, length: Column) -> Column:
    return _each(lambda c, n: decode_quality(c, int(n)), "string")(code, length)


def fixed_decimals(x: Column, places: int) -> Column:
    """A number as text with C's rounding of its exact binary value."""
    return _each(lambda v: f"{v:.{places}f}", "string")(x.cast("double"))
