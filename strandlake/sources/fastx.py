"""FASTQ and FASTA as a Python data source, ``spark.read.format("fastx")``.

Options: ``path`` (paths, globs, folders, by comma), ``layout`` ("fastq" for four-line
records with whole headers, "fastx" for multi-line FASTA or FASTQ with headers split at the
first white space), ``split`` ("true" cuts plain FASTQ files into ranges of ``chunk``
bytes; ordinals are then byte offsets, which keep the order but leave gaps).
Otherwise a file is a partition and ordinals count its records from 0.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.schemas import READS
from strandlake.sources.files import expand, open_input, open_raw

#: Records of a batch; bytes read at a time.
BATCH, READ = 8192, 4 << 20
_ARROW = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), *((c, pa.string()) for c in ("name", "comment", "seq", "qual"))])
Record = tuple[int, str, str | None, str, str | None]


class Range(InputPartition):
    def __init__(self, file: str, begin: int = 0, end: int | None = None):
        self.file, self.begin, self.end = file, begin, end


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self):
        return READS

    def reader(self, schema):
        return FastxReader(self.options)


class FastxReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.layout = options.get("layout", "fastq")
        self.split = options.get("split", "false").lower() == "true"
        self.chunk = int(options.get("chunk", 128 << 20))

    def partitions(self):
        out: list[Range] = []
        for file in expand(self.path):
            if not self.split or self.layout != "fastq" or is_gzip(file):
                out.append(Range(file))
                continue
            with open_raw(file) as f:
                size = f.seek(0, io.SEEK_END)
            out += [Range(file, a, min(a + self.chunk, size)) for a in range(0, max(size, 1), self.chunk)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.layout == "fastq":
            yield from fastq_batches(partition)
            return
        rows: list[Record] = []
        for record in fastx_records(open_input(partition.file)):
            rows.append(record)
            if len(rows) == BATCH:
                yield batch(partition.file, rows)
                rows = []
        if rows:
            yield batch(partition.file, rows)


def batch(file: str, rows: list[Record]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)


def is_gzip(file: str) -> bool:
    with open_raw(file) as f:
        return f.read(2) == b"\x1f\x8b"


def _text(line: bytes) -> str:
    return line.rstrip(b"\r\n").decode("utf-8", "replace")


def _lines(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Lines of bytes as strings; bytes that are no UTF-8 are replaced."""
    at = np.concatenate([[0], np.cumsum(end - begin)])
    flat = buf[np.arange(at[-1]) + np.repeat(begin - at[:-1], end - begin)]
    if (flat > 127).any():
        raw = flat.tobytes()
        return pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)], pa.string())
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())


def fastq_batches(part: Range) -> Iterator[pa.RecordBatch]:
    """Four-line records, found by the line ends of READ bytes at a time; the header is kept
    whole.  A cut-off record is an error, blank lines at the end of the file are not.  Of a
    part with an end, those records that begin before it; ordinals are then byte places."""
    cut = part.end is not None
    with open_raw(part.file) if cut else open_input(part.file) as f:
        place = _first(f, part.begin) if cut else 0
        if cut:
            f.seek(place)
        ordinal, held = 0, b""
        while not cut or place < part.end:
            more = f.read(READ)
            data = held + more
            if not more and data and not data.endswith(b"\n"):
                data += b"\n"
            buf = np.frombuffer(data, np.uint8)
            ends = np.flatnonzero(buf == 10)
            if not more:  # blank lines at the end
                while len(ends) % 4 and not data[ends[-2] + 1 if len(ends) > 1 else 0 : ends[-1]].strip():
                    ends = ends[:-1]
                if len(ends) % 4 == 3 and not data[ends[-3] + 1 : ends[-2]].strip():  # an empty sequence needs no last line
                    data += b"\n"
                    buf, ends = np.frombuffer(data, np.uint8), np.append(ends, len(data) - 1)
                if len(ends) % 4:
                    raise ValueError(f"record {ordinal + len(ends) // 4} of {part.file} is cut off")
            n = len(ends) // 4
            begins = np.concatenate([[0], ends[:-1] + 1])[: 4 * n].reshape(n, 4)
            stops = ends[: 4 * n].reshape(n, 4)
            used = int(stops[-1, 3]) + 1 if n else 0
            if n:
                empty = np.flatnonzero(stops[:, 0] - begins[:, 0] - (buf[np.maximum(stops[:, 0] - 1, 0)] == 13) <= 0)
                if len(empty):  # only blank lines may follow
                    if data[begins[empty[0], 0] :].strip():
                        raise ValueError(f"record {ordinal + empty[0]} of {part.file} is not FASTQ")
                    n, used = int(empty[0]), int(begins[empty[0], 0])
                    begins, stops = begins[:n], stops[:n]
            if cut:
                keep = int(np.searchsorted(place + begins[:, 0], part.end)) if n else 0
                begins, stops, n = begins[:keep], stops[:keep], keep
            if n:
                stops = stops - ((stops > begins) & (buf[np.maximum(stops - 1, 0)] == 13))
                wrong = np.flatnonzero((buf[begins[:, 0]] != 64) | (buf[begins[:, 2]] != 43))
                if len(wrong):
                    raise ValueError(f"record {ordinal + wrong[0]} of {part.file} is not FASTQ")
                size = stops - begins
                wrong = np.flatnonzero(size[:, 1] != size[:, 3])
                if len(wrong):
                    name = data[begins[wrong[0], 0] : stops[wrong[0], 0]].decode("utf-8", "replace")
                    raise ValueError(f"record {ordinal + wrong[0]}: {name} has a sequence and a quality of different lengths")
                for i in range(0, n, BATCH):
                    a, z = begins[i : i + BATCH], stops[i : i + BATCH]
                    number = place + a[:, 0] if cut else ordinal + i + np.arange(len(a))
                    columns = [pa.array([part.file] * len(a)), pa.array(number, pa.int64()), _lines(buf, a[:, 0], z[:, 0]), pa.nulls(len(a), pa.string()), _lines(buf, a[:, 1], z[:, 1]), _lines(buf, a[:, 3], z[:, 3])]
                    yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)
            ordinal += n
            place += used
            held = data[used:]
            if not more:
                return


def fastx_records(f) -> Iterator[Record]:
    """Multi-line FASTA or FASTQ; name and comment are parted at the first white space."""
    ordinal, line = 0, f.readline()
    while line:
        if line[:1] not in b">@" or not line.strip():
            line = f.readline()
            continue
        name, _, comment = _text(line)[1:].replace("\t", " ").partition(" ")
        parts: list[str] = []
        line = f.readline()
        while line and line[:1] not in (b">", b"@", b"+"):
            parts.append(_text(line).strip())
            line = f.readline()
        seq, qual = "".join(parts), None
        if line[:1] == b"+":
            qual = ""
            while len(qual) < len(seq) and (line := f.readline()):
                qual += _text(line).strip()
            if len(qual) != len(seq):
                raise ValueError(f"{name}: a sequence and a quality of different lengths")
            line = f.readline()
        yield ordinal, name, comment or None, seq, qual
        ordinal += 1


def _first(f, begin: int) -> int:
    """Where the first record at or after a byte begins: a line with @ whose next but one line
    begins with + while the line after it is no quality of an earlier one."""
    if not begin:
        return 0
    f.seek(begin - 1)
    reader = io.BufferedReader(f, 1 << 16) if not isinstance(f, io.BufferedReader) else f
    at = begin - 1 + len(reader.readline())
    return _align(reader, at)


def _align(f, at: int) -> int:
    f.seek(at)
    lines, places = [], []
    for _ in range(8):
        places.append(at)
        lines.append(f.readline())
        at += len(lines[-1])
    for i in range(4):
        if lines[i][:1] == b"@" and lines[i + 2][:1] == b"+" and (lines[i + 4][:1] in (b"@", b"")) and len(lines[i + 1].strip()) == len(lines[i + 3].strip()):
            return places[i]
    return at


def read_fastx(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").options(path=path, **options).load()
