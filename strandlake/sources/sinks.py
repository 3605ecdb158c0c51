"""Text and binary outputs: tables of lines, and their writing."""

from __future__ import annotations

import struct
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.codecs import encode_quality_rle, fixed_decimals, pack_2bit, unpack
from strandlake.sources.files import moved, open_raw, open_write


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> None:
    """Writes the column ``value`` as text; ``compression`` may be gzip.  A path of - is the
    standard output, to which rows come a partition at a time."""
    if path == "-":
        for row in lines.select("value").toLocalIterator():
            sys.stdout.write(f"{row['value']}\n")
        return
    lines.select("value").write.options(**({"compression": compression} if compression else {})).text(path)


def _lines(df: DataFrame, value: Column, order: list) -> DataFrame:
    out = df.orderBy(*order) if order else df
    return out.select(value.alias("value"))


def fastq_lines(reads: DataFrame, count: str | None = None, order: tuple = ("ordinal",)) -> DataFrame:
    """Four-line records; with ``count``, that column follows the name after a tab."""
    name = F.concat("name", F.lit("\t"), F.col(count).cast("string")) if count else F.col("name")
    return _lines(reads, F.concat_ws("\n", name, F.col("seq"), F.lit("+"), F.col("qual")), [c for c in order if c in reads.columns])


def all_qualities_lines(collapsed: DataFrame) -> DataFrame:
    """Name and count, sequence, + and all qualities of collapse_all_qualities."""
    return _lines(collapsed, F.concat_ws("\n", F.concat("name", F.lit("\t"), F.col("n").cast("string")), F.col("seq"), F.lit("+"), F.col("quals")), [F.desc("n"), "seq"])


def sampled_lines(reads: DataFrame, fasta: bool = False) -> DataFrame:
    """Sampled reads, their names followed by _ and their place from 1; as FASTQ or FASTA."""
    name = F.concat("name", F.lit("_"), (F.col("ordinal") + 1).cast("string"))
    value = F.concat(F.lit(">"), name, F.lit("\n"), F.col("seq")) if fasta else F.concat_ws("\n", name, F.col("seq"), F.lit("+"), F.col("qual"))
    return _lines(reads, value, ["ordinal"])


def _tabs(*columns: str | Column) -> Column:
    return F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns))


def bedgraph_lines(segments: DataFrame) -> DataFrame:
    return _lines(segments, _tabs("chrom", "start", "end", "depth"), ["chrom", "start"])


def depth_table_lines(windows: DataFrame) -> DataFrame:
    return _lines(windows, _tabs("chrom", "start", "end", fixed_decimals(F.col("value"), 2)), ["chrom", "window"])


def wig_lines(windows: DataFrame, width: int) -> DataFrame:
    """variableStep blocks of the windows above zero; starts from 0."""
    some = windows.where("value > 0")
    head = some.select("chrom").distinct().select("chrom", F.lit(-1).cast("long").alias("window"), F.concat(F.lit("variableStep chrom="), F.col("chrom"), F.lit(f" span={width}")).alias("value"))
    body = some.select("chrom", "window", F.concat_ws(" ", F.col("start").cast("string"), fixed_decimals(F.col("value"), 2)).alias("value"))
    return head.union(body).orderBy("chrom", "window").select("value")


def chrom_sizes_lines(contigs: DataFrame) -> DataFrame:
    return _lines(contigs, _tabs("chrom", "length"), ["tid"])


def window_table_lines(windows: DataFrame, contigs: DataFrame, width: int) -> DataFrame:
    """A header, then a line for each contig with alignments: name, length, reads, bases, mean
    coverage and GC %, and place (from 1), count and GC % of every window.

    windows are those of window_count_gc with contigs.  A contig's windows are gathered,
    whose number the width bounds."""
    cell = F.struct("window", _tabs((F.col("window") + 1).cast("string"), "n", fixed_decimals(F.col("gc_percent"), 6)).alias("t"))
    sums = [F.sum(c).alias(c) for c in ("n", "bases", "gc")]
    rows = windows.groupBy("chrom").agg(F.sort_array(F.collect_list(cell)).alias("cells"), *sums).join(contigs.select("chrom", "tid", "length"), "chrom")
    gc = F.when(F.col("gc") == 0, 0.0).otherwise(F.col("gc") * 100.0 / F.col("bases"))
    line = _tabs("chrom", "length", "n", "bases", fixed_decimals(F.col("bases") / F.col("length"), 6), fixed_decimals(gc, 6), F.array_join(F.transform("cells", lambda c: c["t"]), "\t"))
    last = F.coalesce(F.max(F.floor(F.col("length") / width)), F.lit(0)) + 1
    names = F.concat_ws("\t", F.lit("#chr\tchr_len\tchr_sum_read_count\tchr_sum_base\tchr_mean_cov\tchr_mean_GC%"), F.transform(F.sequence(F.lit(1).cast("long"), last), lambda i: F.concat(i.cast("string"), F.lit("\tcount\tGC%"))))
    head = contigs.agg(names.alias("value")).select(F.lit(-1).alias("tid"), "value")
    return head.union(rows.select("tid", line.alias("value"))).orderBy("tid").select("value")


def qc_lines(summary: DataFrame) -> DataFrame:
    """File, reads, bases, mean, least and largest length, Q20 and Q30 with three digits."""
    whole = fixed_decimals(F.col("mean_length"), 0)
    return _lines(summary, _tabs("file", "reads", "bases", whole, "min_length", "max_length", fixed_decimals(F.col("q20"), 3), fixed_decimals(F.col("q30"), 3)), ["file"])


def length_histogram_lines(histogram: DataFrame) -> DataFrame:
    """Two lines, #Len: and #Freq:, over at most as many numbers as there are lengths."""
    both = histogram.agg(F.sort_array(F.collect_list(F.struct("length", "n"))).alias("h"))
    line = lambda head, field: F.concat(F.lit(head), F.array_join(F.transform("h", lambda x: x[field].cast("string")), "\t"))
    return both.select(F.explode(F.array(line("#Len:\t", "length"), line("#Freq:\t", "n"))).alias("value"))


def quality_table_lines(table: DataFrame) -> DataFrame:
    return _lines(table, _tabs(*(c for c in table.columns if c != "quality")), ["quality"])


# ---- binary files ------------------------------------------------------------------------


def _parts(rows: DataFrame, folder: str, suffix: str, head: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(part, n, path): writes the binary column of sorted rows as a file for each partition, in
    the rows' order, into a folder that all executors share.  A file is there whole or not at
    all.  ``head`` makes a file's beginning from its first row; equal rows are needed then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:05d}{suffix}"
        held, n = f"{path}.{uuid.uuid4().hex}.part", 0
        f = None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).to_pylist()
            if f is None:
                f = open_write(held)
                f.write(head(values[0]) if head else b"")
            f.write(b"".join(values))
            n += len(values)
        if f is not None:
            f.close()
            moved(held, path)
            yield pa.RecordBatch.from_pydict({"part": [part], "n": [n], "path": [path]}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("path", pa.string())]))

    return rows.mapInArrow(run, "part int, n long, path string")


def _joined(parts: DataFrame, path: str, skip: int) -> None:
    """The parts as one file, copied in pieces; of all but the first ``skip`` bytes are left out."""
    with open_write(f"{path}.part") as out:
        for i, row in enumerate(sorted(parts.collect(), key=lambda r: r["part"])):  # one row a partition
            with open_raw(row["path"]) as f:
                f.seek(skip if i else 0)
                while data := f.read(1 << 20):
                    out.write(data)
    moved(f"{path}.part", path)


def two_bit_parts(reads: DataFrame, folder: str, compat_order: bool = True) -> DataFrame:
    """Files of a 2-byte header (bases, bytes of a record) and packed records of equal lengths, a
    file for each partition; (part, n, path) of each.

    Records are in reverse order of arrival with ``compat_order``, through all parts.
    Lengths that differ or exceed 255 are an error."""
    lengths = [r[0] for r in reads.select(F.length("seq").alias("n")).distinct().limit(2).collect()]
    if len(lengths) > 1 or lengths and lengths[0] > 255:
        raise ValueError("reads of one length, at most 255, are needed")
    n = lengths[0] if lengths else 0
    rows = reads.orderBy(F.desc("ordinal") if compat_order else "ordinal").select(pack_2bit(F.col("seq")).alias("p"))
    return _parts(rows, folder, ".2bit", lambda _: struct.pack("BB", n, -(-n // 4)))


def two_bit_file(reads: DataFrame, path: str, compat_order: bool = True) -> None:
    """two_bit_parts as one file."""
    parts = two_bit_parts(reads, f"{path}.parts", compat_order).cache()
    _joined(parts, path, 2)


def read_two_bit(data: bytes) -> list[str]:
    """The sequences of a packed file."""
    n, size = struct.unpack_from("BB", data)
    return [unpack(data[a : a + size], 0, n) for a in range(2, len(data), size)] if size else []


def quality_code_parts(reads: DataFrame, folder: str) -> DataFrame:
    """Files of a length byte and the code of each quality, in order of arrival, a file for each
    partition; (part, n, path) of each.  Codes over 255 bytes are an error, as their length
    has no place."""
    code = encode_quality_rle(F.col("qual"))
    rows = reads.select("ordinal", code.alias("c")).orderBy("ordinal")
    size = F.octet_length("c")
    length = F.when(size <= 255, F.unhex(F.lpad(F.hex(size), 2, "0"))).otherwise(F.raise_error(F.lit("a code of more than 255 bytes")).cast("binary"))
    return _parts(rows.select(F.concat(length, F.col("c")).alias("c")), folder, ".rle")


def quality_code_file(reads: DataFrame, path: str) -> None:
    """quality_code_parts as one file."""
    _joined(quality_code_parts(reads, f"{path}.parts").cache(), path, 0)


def bam_files(alignments: DataFrame, contigs: DataFrame, folder: str) -> DataFrame:
    """(chrom, n, path): writes <chrom>.bam for each contig into a folder that all executors
    share.  Rows are dealt by ranges of their order, so that a contig is not one task: each range
    is encoded and compressed on its own into the shared folder, and a contig's ranges are then
    copied behind one another as they are."""
    from strandlake.plans.tables import gone_at_end, shared_folder
    from strandlake.sources.bam import EOF_BLOCK, bgzf_blocks, encode_header, encoded

    sizes = [(r["chrom"], r["length"]) for r in contigs.orderBy("tid").select("chrom", "length").collect()]
    columns = ["chrom", "pos", "ordinal", "qname", "flag", "tid", "mapq", "cigar", "seq", "qual"]
    rows = alignments.where("chrom is not null").select(*columns)
    rows = rows.repartitionByRange("chrom", "pos", "ordinal").sortWithinPartitions("chrom", "pos", "ordinal")
    spark = alignments.sparkSession
    held_folder = f"{shared_folder(spark)}/bam-ranges-{uuid.uuid4().hex}"
    gone_at_end(spark, held_folder)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chrom, path, f, n, held = TaskContext.get().partitionId(), None, "", None, 0, bytearray()

        def ended() -> pa.RecordBatch:
            f.write(b"".join(bgzf_blocks(held)))
            f.close()
            return pa.RecordBatch.from_pylist([{"chrom": chrom, "part": part, "n": n, "path": path}], schema=pa.schema([("chrom", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("path", pa.string())]))

        for batch in batches:
            runs = pa.compute.run_end_encode(batch.column("chrom"))
            begin = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if f is None or name != chrom:
                    if f is not None:
                        yield ended()
                    chrom, path, n = name, f"{held_folder}/{part:05d}-{uuid.uuid4().hex}", 0
                    f = open_write(path)
                for some in encoded(batch.slice(begin, end - begin)):
                    held += some
                    f.write(b"".join(bgzf_blocks(held, whole=False)))
                n += end - begin
                begin = end
        if f is not None:
            yield ended()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in batch.to_pylist()]  # a row for each range
        for chrom in dict.fromkeys(row["chrom"] for row in found):
            mine = [row for row in found if row["chrom"] == chrom]
            path = f"{folder}/{chrom}.bam"
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open_write(part) as out:
                out.write(b"".join(bgzf_blocks(bytearray(encode_header(sizes)))))
                for row in mine:
                    with open_raw(row["path"]) as f:
                        while data := f.read(1 << 20):
                            out.write(data)
                out.write(EOF_BLOCK)
            moved(part, path)
            yield pa.RecordBatch.from_pylist([{"chrom": chrom, "n": sum(row["n"] for row in mine), "path": path}])

    parts = rows.mapInArrow(ranges, "chrom string, part int, n long, path string")
    return parts.repartition(max(len(sizes), 1), "chrom").sortWithinPartitions("chrom", "part").mapInArrow(joined, "chrom string, n long, path string")
