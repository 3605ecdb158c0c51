"""Sources that seek: files of packed records, ``spark.read.format("twobit")`` and
``format("qualitycodes")``, and ranges of FASTA sequences by an index beside the file."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from strandlake.functions.codecs import decode_quality, unpack
from strandlake.sources.fastx import Range, is_gzip
from strandlake.sources.files import exists, expand, open_raw, write_whole

BATCH = 8192


class TwoBitSource(DataSource):
    """Options: ``path`` and ``chunk``, the records of a partition."""

    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self):
        return "file string, ordinal long, seq string"

    def reader(self, schema):
        return TwoBitReader(self.options)


class TwoBitReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options.get("chunk", 1 << 22))

    def partitions(self):
        """Ranges of records, which are all equally long."""
        out = []
        for file in expand(self.path):
            with open_raw(file) as f:
                size = f.seek(0, io.SEEK_END)
                f.seek(0)
                head = f.read(2)
            if len(head) < 2 or not head[1]:
                continue
            if (size - 2) % head[1]:
                raise ValueError(f"{file} is cut off")
            n = (size - 2) // head[1]
            out += [Range(file, a, min(a + self.chunk, n)) for a in range(0, n, self.chunk)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no records
            return
        with open_raw(partition.file) as f:
            bases, size = struct.unpack("BB", f.read(2))
            f.seek(2 + partition.begin * size)
            for a in range(partition.begin, partition.end, BATCH):
                n = min(BATCH, partition.end - a)
                data = f.read(n * size)
                seqs = [unpack(data[i * size : (i + 1) * size], 0, bases) for i in range(n)]
                yield pa.RecordBatch.from_pydict({"file": [partition.file] * n, "ordinal": pa.array(range(a, a + n), pa.int64()), "seq": seqs})


class QualityCodes(DataSource):
    """Options: ``path`` and ``length``, the qualities of a read.  A file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "qualitycodes"

    def schema(self):
        return "file string, ordinal long, qual string"

    def reader(self, schema):
        return QualityReader(self.options)


class QualityReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.length = options["path"], int(options["length"])

    def partitions(self):
        return [Range(f) for f in expand(self.path)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with open_raw(partition.file) as raw:
            f, ordinal, rows = io.BufferedReader(raw, 1 << 20), 0, []
            while head := f.read(1):
                code = f.read(head[0])
                if len(code) != head[0]:
                    raise ValueError(f"{partition.file} is cut off")
                rows.append((partition.file, ordinal, decode_quality(code, self.length)))
                ordinal += 1
                if len(rows) == BATCH:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(("file", "ordinal", "qual"), (pa.array(c) for c in zip(*rows, strict=True)), strict=True)))


def read_two_bit(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(TwoBitSource)
    return spark.read.format("twobit").options(path=path, **options).load()


def read_quality_codes(spark: SparkSession, path: str, length: int) -> DataFrame:
    spark.dataSource.register(QualityCodes)
    return spark.read.format("qualitycodes").options(path=path, length=str(length)).load()


# ---- FASTA by ranges ---------------------------------------------------------------------

#: Of a sequence: bases, the place of the first, and bases and bytes of a line.
Entry = tuple[int, int, int, int]


def make_index(f) -> dict[str, Entry]:
    """The index of a plain FASTA file, read as a stream; lines of a sequence must be equally
    long but for the last."""
    out: dict[str, Entry] = {}
    name, place, short = None, 0, False
    for line in f:
        bases = len(line.rstrip(b"\r\n"))
        if line.startswith(b">"):
            name, short = line[1:].split()[0].decode() if line[1:].split() else "", False
            out[name] = (0, place + len(line), 0, 0)
        elif name is not None and bases:
            n, first, per, width = out[name]
            if short or per and bases > per:
                raise ValueError(f"lines of {name} are not equally long")
            short = bool(per) and bases < per
            out[name] = (n + bases, first, per or bases, width or len(line))
        place += len(line)
    return out


def index_fasta(path: str) -> dict[str, Entry]:
    """The index of a file: that beside it (``.fai``), or a new one, which is written there."""
    if exists(f"{path}.fai"):
        with open_raw(f"{path}.fai") as f:
            rows = [x.split("\t") for x in f.read().decode().splitlines()]
        return {r[0]: tuple(int(x) for x in r[1:5]) for r in rows}
    with open_raw(path) as raw:
        index = make_index(io.BufferedReader(raw, 1 << 20))
    write_whole(f"{path}.fai", "".join(f"{n}\t{a}\t{b}\t{c}\t{d}\n" for n, (a, b, c, d) in index.items()).encode())
    return index


def fetch(f, entry: Entry, begin: int, end: int) -> str:
    """Bases [begin, end) of a sequence, of which only those bytes are read."""
    n, first, per, width = entry
    begin, end = max(begin, 0), min(end, n)
    if begin >= end:
        return ""
    place = lambda i: first + i // per * width + i % per
    f.seek(place(begin))
    return f.read(place(end - 1) + 1 - place(begin)).replace(b"\r", b"").replace(b"\n", b"").decode()


def fasta_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """ranges (name, begin, end) with seq, the bases [begin, end) of a plain FASTA file; null for
    an unknown name.  The index goes to all tasks: a row a sequence of the file."""
    if is_gzip(path):
        raise ValueError("ranges need a plain file")
    index = index_fasta(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_raw(path) as f:
            for batch in batches:
                rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
                seq = [fetch(f, index[n], a, b) if n in index and a is not None and b is not None else None for n, a, b in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq, pa.string())], ["name", "begin", "end", "seq"])

    return ranges.select("name", "begin", "end").selectExpr("name", "cast(begin as bigint) begin", "cast(end as bigint) end").mapInArrow(run, "name string, begin long, end long, seq string")
