"""BAM as a Python data source, ``spark.read.format("bam")``, its index, and its encoding.

Options: ``path`` as for fastx; ``region`` (chr, chr:b or chr:b-e) keeps overlapping
alignments only; ``chunk``, the compressed bytes of a partition.  A file with an index beside
it (``.bai``) is cut at the index's places, which are beginnings of records, and of a region
only what the index points to is read; any other file is a partition.  Blocks are inflated
one at a time, and records are decoded by the batch.  Ordinals count a file's records; in a
cut file they are places in it, which keep the order but leave gaps.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from strandlake.schemas import ALIGNMENTS, CONTIGS
from strandlake.sources.files import exists, expand, open_input, open_raw

#: Inflated bytes decoded at a time; compressed bytes of a partition of an indexed file.
BATCH_BYTES, CHUNK = 4 << 20, 64 << 20
#: Bytes of a written block before it is compressed.
BLOCK = 65280
# Fixed values of the format: base codes, CIGAR letters, and the block that ends a file.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
# Fixed values of the index: bits of a window of its linear part, and of bins with each level's first.
WINDOW_BITS = 14
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
_BASES = np.frombuffer(BASES.encode(), np.uint8)
_CODE = {c: i for i, c in enumerate(BASES)}
_CODES = np.array([_CODE.get(chr(i), 15) for i in range(256)], np.uint8)
_ON_REFERENCE = np.isin(np.arange(16), (0, 2, 3, 7, 8))
_HEAD = np.dtype([("tid", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("mate", "<i4", 3)])
_ARROW = pa.schema(
    [("file", pa.string()), ("ordinal", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("tid", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()),
     ("cigar", pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())]))), ("l_qseq", pa.int32()), ("seq", pa.string()), ("qual", pa.string())]
)
Contigs = list[tuple[str, int]]
Region = tuple[str, int, int | None]


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return ALIGNMENTS

    def reader(self, schema):
        # Spark refuses a reader that takes filters while its setting is off
        return (PushingReader if self.options.get("pushdown") == "true" else BamReader)(self.options)


class Part(InputPartition):
    """Records of a file from one virtual place to another; the whole file without places."""

    def __init__(self, file: str, begin: int | None = None, end: int | None = None):
        self.file, self.begin, self.end = file, begin, end


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.region = options.get("region")

    def _region(self) -> Region | None:
        from strandlake.operators.coverage import parse_region

        return parse_region(self.region) if self.region else None

    def partitions(self):
        out: list[Part] = []
        for file in expand(self.path):
            out += indexed_parts(file, self._region(), self.chunk) if exists(f"{file}.bai") else [Part(file)]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        region = self._region()
        with open_input(partition.file) as f:
            contigs = read_header(f)[1]
            if partition.begin is None:
                yield from _decoded(f, partition.file, contigs, region, 0)
                return
        with open_raw(partition.file) as raw:
            yield from _decoded(Blocks(raw, partition.begin, partition.end), partition.file, contigs, region, partition.begin)


class PushingReader(BamReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A contig asked for by equality is a region; Spark still applies all filters."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",) and self.region is None:
                self.region = f.value
            yield f


class Blocks:
    """The inflated bytes of a file of blocks from a virtual place, block << 16 | byte, on."""

    def __init__(self, raw, begin: int = 0, end: int | None = None):
        self.raw, self.end, self.held, self.at = raw, end, b"", begin & 0xFFFF
        self.block = self.next = begin >> 16

    def tell(self) -> int:
        return (self.next << 16) if self.at >= len(self.held) else self.block << 16 | self.at

    def _more(self) -> bool:
        self.raw.seek(self.next)
        head = self.raw.read(12)
        if len(head) < 12:
            return False
        if head[:4] != EOF_BLOCK[:4]:
            raise ValueError(f"no block at byte {self.next}")
        extra = self.raw.read(struct.unpack_from("<H", head, 10)[0])
        at, size = 0, None
        while at < len(extra):
            kind, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + n
        if size is None:
            raise ValueError(f"no block size at byte {self.next}")
        body = self.raw.read(size - 12 - len(extra))
        data = zlib.decompress(body[:-8], -15)
        if zlib.crc32(data) != struct.unpack_from("<I", body, len(body) - 8)[0]:
            raise ValueError(f"a damaged block at byte {self.next}")
        skip = self.at if not self.held and self.block == self.next else 0
        self.block, self.held, self.at = self.next, data, skip
        self.next += size
        return True

    def read(self, n: int) -> bytes:
        """At most n bytes, none beyond the end place."""
        out = []
        while n > 0:
            if self.at >= len(self.held) and not (self._within(self.next << 16) and self._more()):
                break
            if not self._within(self.block << 16 | self.at):
                break
            last = len(self.held) if self.end is None or self.end >> 16 > self.block else min(len(self.held), self.end & 0xFFFF)
            part = self.held[self.at : min(self.at + n, last)]
            self.at += len(part)
            if not part and last < len(self.held):
                break
            out.append(part)
            n -= len(part)
        return b"".join(out)

    def _within(self, place: int) -> bool:
        return self.end is None or place < self.end


def _decoded(f, file: str, contigs: Contigs, region: Region | None, first: int) -> Iterator[pa.RecordBatch]:
    held, ordinal = b"", first
    while True:
        more = f.read(BATCH_BYTES)
        data = held + more if held else more
        starts, at = _record_starts(data)
        if starts:
            batch, past = decode(data, np.array(starts), file, contigs, ordinal, region)
            if batch.num_rows:
                yield batch
            if past:
                return
            ordinal += len(starts)
        held = data[at:]
        if not more:
            if held:
                raise ValueError("a BAM file that is cut off")
            return


def _taken(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the ranges end to end, offsets)."""
    at = np.concatenate([[0], np.cumsum(size)])
    return buf[np.arange(at[-1]) + np.repeat(start - at[:-1], size)], at


def _strings(flat: np.ndarray, at: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    made = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))).cast(pa.string())
    return made if missing is None else pa.compute.if_else(pa.array(missing), pa.scalar(None, pa.string()), made)


def decode(data: bytes, start: np.ndarray, file: str, contigs: Contigs, ordinal: int, region: Region | None = None) -> tuple[pa.RecordBatch, bool]:
    """(rows, whether a sorted file has none of the region's later) of the records whose bodies begin at ``start``."""
    buf = np.frombuffer(data, np.uint8)
    head = buf[start[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD)[:, 0]
    number = ordinal + np.arange(len(start))
    name = head["name"].astype(np.int64)
    ops, bases = head["ops"].astype(np.int64), head["bases"].astype(np.int64)
    ops_at = start + _HEAD.itemsize + name
    raw, at = _taken(buf, ops_at, 4 * ops)
    cigar = raw.view("<u4")
    past = False
    if region is not None:
        chrom, begin, end = region
        steps = np.concatenate([[0], np.cumsum(np.where(_ON_REFERENCE[cigar & 15], cigar >> 4, 0), dtype=np.int64)])
        reach = head["pos"] + steps[at[1:] // 4] - steps[at[:-1] // 4]
        tid = next((i for i, (n, _) in enumerate(contigs) if n == chrom), -2)
        keep = (head["tid"] == tid) & (reach > begin)
        if end is not None:
            keep &= head["pos"] < end
            past = bool(((head["tid"] > tid) | ((head["tid"] == tid) & (head["pos"] >= end)) | (head["tid"] < 0))[-1]) and _ascends(head)
        if not keep.all():
            batch, _ = decode(data, start[keep], file, contigs, ordinal) if keep.any() else (pa.RecordBatch.from_pylist([], schema=_ARROW), False)
            if batch.num_rows:
                batch = batch.set_column(1, "ordinal", pa.array(number[keep]))
            return batch, past
    half = (bases + 1) // 2
    seq_at = ops_at + 4 * ops
    packed, packed_at = _taken(buf, seq_at, half)
    letters = np.column_stack([packed >> 4, packed & 15]).ravel()
    letters, seq = _taken(letters, 2 * packed_at[:-1], bases)
    quals, qual = _taken(buf, seq_at + half, bases)
    first = np.append(quals, np.uint8(255))[qual[:-1]]
    tid = pa.array(head["tid"], mask=head["tid"] < 0)
    columns = [
        pa.array([file] * len(start)), pa.array(number), _strings(*_taken(buf, start + _HEAD.itemsize, name - 1)), pa.array(head["flag"].astype(np.int32)), pa.array(head["tid"]),
        pa.array([n for n, _ in contigs], pa.string()).take(tid), pa.array(head["pos"].astype(np.int64)), pa.array(head["mapq"].astype(np.int32)),
        pa.ListArray.from_arrays(pa.array((at // 4).astype(np.int32)), pa.StructArray.from_arrays([pa.array((cigar & 15).astype(np.int32)), pa.array((cigar >> 4).astype(np.int32))], ["op", "len"])),
        pa.array(head["bases"]), _strings(_BASES[letters], seq), _strings(quals + np.uint8(33), qual, (bases == 0) | (first == 255)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW), past


def _ascends(head: np.ndarray) -> bool:
    """Whether a batch of records is sorted by contig and place, those without a contig last."""
    place = (head["tid"].astype(np.uint32).astype(np.int64) << 32) + head["pos"]
    return bool((np.diff(place) >= 0).all())


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError("a BAM file that is cut off")
    return data


def read_header(f) -> tuple[str, Contigs]:
    """(header text, [(name, length)]) of an inflated stream."""
    if _exactly(f, 4) != b"BAM\1":
        raise ValueError("not BAM")
    text = _exactly(f, *struct.unpack("<i", _exactly(f, 4))).rstrip(b"\0").decode()
    contigs = []
    for _ in range(*struct.unpack("<i", _exactly(f, 4))):
        name = _exactly(f, *struct.unpack("<i", _exactly(f, 4)))[:-1].decode()
        contigs.append((name, *struct.unpack("<i", _exactly(f, 4))))
    return text, contigs


def read_bam(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("bam").options(path=path, pushdown=pushdown, **options).load()


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(file, tid, chrom, length) of the headers, which are small."""
    rows = []
    for file in expand(path):
        with open_input(file) as f:
            rows += [(file, i, name, length) for i, (name, length) in enumerate(read_header(f)[1])]
    return spark.createDataFrame(rows, CONTIGS)


# ---- the index ---------------------------------------------------------------------------


def _bins(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest bins that hold [begin, end)."""
    out = np.zeros(len(begin), np.int64)
    for bits, first in reversed(LEVELS):
        out = np.where(begin >> bits == (end - 1) >> bits, first + (begin >> bits), out)
    return out


def _placed(f: Blocks) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(data, offsets of records' bodies, virtual places where the records begin and, last, where
    the next one would) of batches of whole records."""
    held, marks = b"", [(0, f.tell())]  # offsets in the data, ascending, from which places count on
    while True:
        pieces, size = [held], len(held)
        while size < BATCH_BYTES + len(held):
            if not (piece := f.read(max(len(f.held) - f.at, 1))):  # no more than the rest of a block
                break
            if f.at == len(piece) or not marks:
                marks.append((size, f.block << 16 | f.at - len(piece)))
            pieces.append(piece)
            size += len(piece)
        data, ended = b"".join(pieces), size == len(held)
        starts, at = _record_starts(data)
        if starts:
            begins = np.append(np.array(starts, np.int64) - 4, at)
            offsets, places = (np.array(x, np.int64) for x in zip(*marks, strict=True))
            i = np.searchsorted(offsets, begins, "right") - 1
            where = places[i] + begins - offsets[i]
            if at == len(data):
                where[-1] = f.tell()
            yield data, np.array(starts), where
        held = data[at:]
        if ended:
            if held:
                raise ValueError("a BAM file that is cut off")
            return
        kept = [(o - at, p) for o, p in marks if o > at]
        if held:
            o, p = [m for m in marks if m[0] <= at][-1]
            kept.insert(0, (0, p + at - o))
        marks = kept


def _record_starts(data: bytes) -> tuple[list[int], int]:
    """(where the bodies of the whole records begin, where the first that is not whole does)."""
    starts, at, last, size_at = [], 0, len(data) - 4, struct.Struct("<i").unpack_from
    while at <= last:
        after = at + 4 + size_at(data, at)[0]
        if after > last + 4:
            break
        starts.append(at + 4)
        at = after
    return starts, at


def make_index(raw) -> bytes:
    """The index of a sorted file, read as a stream and indexed by the batch."""
    f = Blocks(raw)
    contigs = read_header(f)[1]
    bins: list[dict[int, list[list[int]]]] = [{} for _ in contigs]
    linear: list[dict[int, int]] = [{} for _ in contigs]
    without, last = 0, (0, -1)
    for data, start, where in _placed(f):
        head = np.frombuffer(data, np.uint8)[start[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD)[:, 0]
        has = head["tid"] >= 0
        without += int((~has).sum())
        if not has.any():
            continue
        head, start, begins, ends = head[has], start[has], where[:-1][has], where[1:][has]
        tid, pos = head["tid"].astype(np.int64), head["pos"].astype(np.int64)
        if (int(tid[0]), int(pos[0])) < last or (np.diff((tid << 32) + pos) < 0).any():
            raise ValueError("an unsorted BAM file has no index")
        last = int(tid[-1]), int(pos[-1])
        raw_ops, at = _taken(np.frombuffer(data, np.uint8), start + _HEAD.itemsize + head["name"], 4 * head["ops"].astype(np.int64))
        cigar = raw_ops.view("<u4")
        steps = np.concatenate([[0], np.cumsum(np.where(_ON_REFERENCE[cigar & 15], cigar >> 4, 0), dtype=np.int64)])
        end = pos + np.maximum(1, steps[at[1:] // 4] - steps[at[:-1] // 4])
        of = _bins(pos, end)
        # records in a row of one bin and contig are one chunk
        new = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(tid) != 0) | (begins[1:] != ends[:-1])]))
        for t, b, x, y in zip(tid[new].tolist(), of[new].tolist(), begins[new].tolist(), ends[np.append(new[1:], len(of)) - 1].tolist(), strict=True):
            chunks = bins[t].setdefault(b, [])
            if chunks and chunks[-1][1] == x:
                chunks[-1][1] = y
            else:
                chunks.append([x, y])
        # a window's place is that of the first record that reaches it
        first, final = pos >> WINDOW_BITS, (end - 1) >> WINDOW_BITS
        once = np.flatnonzero(np.concatenate([[True], (np.diff(tid) != 0) | (np.diff(first) != 0) | (np.diff(final) != 0)]))
        for i in once.tolist():
            for w in range(int(first[i]), int(final[i]) + 1):
                linear[int(tid[i])].setdefault(w, int(begins[i]))
    out = [b"BAI\1", struct.pack("<i", len(contigs))]
    for of_bin, of_window in zip(bins, linear, strict=True):
        out.append(struct.pack("<i", len(of_bin)))
        for b, chunks in sorted(of_bin.items()):
            out.append(struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
        places, known = [], 0
        for w in range(max(of_window, default=-1) + 1):
            known = of_window.get(w, known)
            places.append(known)
        out.append(struct.pack(f"<i{len(places)}Q", len(places), *places))
    return b"".join([*out, struct.pack("<Q", without)])


def read_index(data: bytes) -> tuple[list[list[int]], list[list[tuple[int, int]]]]:
    """(linear part, chunks) of each contig."""
    if data[:4] != b"BAI\1":
        raise ValueError("not an index of BAM")
    f = io.BytesIO(data[4:])
    number = lambda kind, n=1: struct.unpack(f"<{n}{kind}", f.read(n * struct.calcsize(f"<{kind}")))
    linear, chunks = [], []
    for _ in range(*number("i")):
        mine: list[tuple[int, int]] = []
        for _ in range(*number("i")):
            b, n = *number("I"), *number("i")
            pairs = [number("Q", 2) for _ in range(n)]
            if b <= 37448:  # others hold counts
                mine += pairs
        chunks.append(sorted(mine))
        linear.append(list(number("Q", *number("i"))))
    return linear, chunks


def indexed_parts(file: str, region: Region | None, chunk: int) -> list[Part]:
    """Partitions of an indexed file of about ``chunk`` compressed bytes; with a region, of what
    the index points to."""
    with open_raw(f"{file}.bai") as f:
        linear, chunks = read_index(f.read())
    with open_raw(file) as raw:
        contigs = read_header(blocks := Blocks(raw))[1]
        first = blocks.tell()
    begin, end = first, None
    if region is not None:
        tid = next((i for i, (n, _) in enumerate(contigs) if n == region[0]), None)
        if tid is None or not chunks[tid]:
            return []
        begin, end = chunks[tid][0][0], max(c[1] for c in chunks[tid])
        window = region[1] >> WINDOW_BITS
        begin = max(begin, linear[tid][window] if window < len(linear[tid]) else end)
        if region[2] is not None:
            after = (region[2] - 1 >> WINDOW_BITS) + 1
            later = [x for x in linear[tid][after:] if x]
            # records that begin before the region's end begin before those that begin in a later window
            starts = sorted(a for a, _ in chunks[tid] if later and a >= later[-1])
            end = min(end, starts[0]) if starts else end
        if begin >= end:
            return []
    places = sorted({x for contig in linear for x in contig if x} | {x for contig in chunks for c in contig for x in c})
    cuts = [begin]
    for place in places:
        if place > begin and (end is None or place < end) and (place >> 16) - (cuts[-1] >> 16) >= chunk:
            cuts.append(place)
    return [Part(file, a, b) for a, b in zip(cuts, [*cuts[1:], end], strict=True)]


def index_bam(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes): writes an index beside each sorted file, a task each."""
    from strandlake.sources.files import write_whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in map(files.__getitem__, batch.column(0).to_pylist()):
                with open_raw(file) as raw:
                    data = make_index(raw)
                write_whole(f"{file}.bai", data)
                yield pa.RecordBatch.from_pydict({"file": [file], "bytes": [len(data)]})

    files = [f for f in expand(path) if not f.endswith(".bai")]
    return spark.range(0, len(files), 1, max(len(files), 1)).mapInArrow(run, "file string, bytes long")


# ---- encoding ----------------------------------------------------------------------------


def bgzf_block(data: bytes) -> bytes:
    """One block, of at most 65,280 bytes of data."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def encode_header(contigs: Contigs, text: str = "") -> bytes:
    text = text or "".join(["@HD\tVN:1.6\n", *(f"@SQ\tSN:{n}\tLN:{x}\n" for n, x in contigs)])
    out = [b"BAM\1", struct.pack("<i", len(text)), text.encode(), struct.pack("<i", len(contigs))]
    for name, length in contigs:
        out += [struct.pack("<i", len(name) + 1), name.encode(), b"\0", struct.pack("<i", length)]
    return b"".join(out)


def encode_record(row: dict) -> bytes:
    name = row["qname"].encode() + b"\0"
    cigar = [(c["len"], c["op"]) for c in row["cigar"] or []]
    seq = row["seq"] or ""
    codes = [_CODE.get(c, 15) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    qual = bytes(ord(c) - 33 for c in row["qual"]) if row.get("qual") else b"\xff" * len(seq)
    tid = -1 if row["tid"] is None else row["tid"]
    body = struct.pack("<iiBBHHHiiii", tid, row["pos"], len(name), row.get("mapq") or 0, 0, len(cigar), row["flag"], len(seq), -1, -1, 0)
    body += name + struct.pack(f"<{len(cigar)}I", *(n << 4 | op for n, op in cigar)) + packed + qual
    return struct.pack("<i", len(body)) + body


def encode_bam(contigs: Contigs, rows: Iterable[dict]) -> Iterator[bytes]:
    """The bytes of a BAM file, block by block."""
    held = bytearray(encode_header(contigs))
    for row in rows:
        held += encode_record(row)
        yield from bgzf_blocks(held, whole=False)
    yield from bgzf_blocks(held)
    yield EOF_BLOCK


def bgzf_blocks(held: bytearray, whole: bool = True) -> Iterator[bytes]:
    """Takes full blocks off the held bytes, and with ``whole`` the rest too."""
    at = 0
    while len(held) - at >= BLOCK or whole and at < len(held):
        yield bgzf_block(bytes(held[at : at + BLOCK]))
        at += BLOCK
    del held[:at]


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, sizes) of a column of strings; a missing one has none."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return flat, at[:-1], np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)


def encoded(batch: pa.RecordBatch) -> Iterator[bytes]:
    """encode_records of a batch in runs of about BATCH_BYTES, so that long reads take no more memory."""
    letters, ops = _text(batch.column("seq"))[2], np.diff(batch.column("cigar").offsets.to_numpy())
    at, i = np.concatenate([[0], np.cumsum(letters + 8 * ops)]), 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BATCH_BYTES, "right")) - 1)
        yield encode_records(batch.slice(i, j - i))
        i = j


def encode_records(batch: pa.RecordBatch) -> bytes:
    """The records of a batch of alignments, as encode_record gives them, in numpy."""
    n = len(batch)
    if not n:
        return b""
    column = lambda name: batch.column(name)
    numbers = lambda name, missing: pa.compute.fill_null(column(name).cast(pa.int64()), missing).to_numpy()
    (names, name_at, name_size), (bases, base_at, size), (quals, qual_at, qual_size) = (_text(column(c)) for c in ("qname", "seq", "qual"))
    lists, valid = column("cigar"), column("cigar").is_valid().to_numpy(zero_copy_only=False)
    ops_at = lists.offsets.to_numpy()
    ops = np.where(valid, np.diff(ops_at), 0)
    op, length = (lists.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) if len(lists.values) else np.zeros(0, np.int64) for c in ("op", "len"))
    pos, flag, tid, mapq = numbers("pos", 1 << 40), numbers("flag", -1), numbers("tid", -1), numbers("mapq", 0)
    chosen, chosen_at = _taken(quals, qual_at, qual_size)
    letters, letters_at = _taken(bases, base_at, size)
    plain = (
        column("qname").null_count == 0 and (name_size < 255).all() and (ops < 65536).all() and ((pos >= -(1 << 31)) & (pos < 1 << 31)).all() and ((flag >= 0) & (flag < 65536)).all()
        and ((mapq >= 0) & (mapq < 256)).all() and (tid < 1 << 31).all() and ((qual_size == 0) | (qual_size == size)).all() and (letters < 128).all() and ((chosen >= 33) & (chosen < 128)).all()
        and lists.values.null_count == 0 and ((op >= 0) & (op < 16) & (length >= 0) & (length < 1 << 28)).all()
    )
    if not plain:  # not in ASCII, or an error, row by row
        return b"".join(map(encode_record, batch.to_pylist()))
    half = (size + 1) // 2
    body = _HEAD.itemsize + name_size + 1 + 4 * ops + half + size
    at = np.concatenate([[0], np.cumsum(body + 4)])
    out = np.zeros(at[-1], np.uint8)
    head = np.zeros(n, np.dtype([("size", "<i4"), *((k, _HEAD[k]) for k in _HEAD.names)]))
    head["mate"][:, :2] = -1
    for k, x in (("size", body), ("tid", tid), ("pos", pos), ("name", name_size + 1), ("mapq", mapq), ("ops", ops), ("flag", flag), ("bases", size)):
        head[k] = x
    here = at[:-1]
    out[here[:, None] + np.arange(head.itemsize)] = head.view(np.uint8).reshape(n, -1)

    def put(flat: np.ndarray, flat_at: np.ndarray, sizes: np.ndarray) -> None:
        out[np.arange(len(flat)) + np.repeat(here - flat_at[:-1], sizes)] = flat

    here = here + head.itemsize
    put(*_taken(names, name_at, name_size), name_size)
    here = here + name_size + 1
    put(*_taken(np.ascontiguousarray((length << 4 | op).astype("<u4")).view(np.uint8), 4 * ops_at[:-1].astype(np.int64), 4 * ops), 4 * ops)
    here = here + 4 * ops
    # every sequence takes an even number of codes, a 0 after an odd one
    codes, codes_at = np.zeros(2 * int(half.sum()), np.uint8), np.concatenate([[0], np.cumsum(2 * half)])
    codes[np.arange(len(letters)) + np.repeat(codes_at[:-1] - letters_at[:-1], size)] = _CODES[letters]
    put(codes[::2] << 4 | codes[1::2], codes_at // 2, half)
    here = here + half
    unknown = qual_size == 0
    if unknown.all():
        put(np.full(int(size.sum()), 255, np.uint8), letters_at, size)
    else:
        values = np.full(len(letters), 255, np.uint8)
        values[~np.repeat(unknown, size)] = chosen - np.uint8(33)
        put(values, letters_at, size)
    return out.tobytes()
