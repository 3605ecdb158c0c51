"""The command surface: one function per program, from inputs to written outputs."""

from __future__ import annotations

import sys
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import coverage, qc
from strandlake.operators import reads as R
from strandlake.plans.tables import observed, written
from strandlake.sources import bam, fastx, packed, sinks
from strandlake.sources.fastx import is_gzip


def fastq_count(spark: SparkSession, files: str, out: str, by_file: bool = True) -> DataFrame:
    """Summary lines by file, and of all files together."""
    reads = fastx.read_fastx(spark, files)
    summary = qc.qc_summary_total(reads) if by_file else qc.qc_summary(reads)
    sinks.write_lines(sinks.qc_lines(summary), out)
    return summary


def fastq_trim(spark: SparkSession, path: str, out: str, start: int = 0, end: int = 400, gzip: bool = False) -> None:
    sinks.write_lines(sinks.fastq_lines(R.trim(fastx.read_fastx(spark, path), start, end)), out, "gzip" if gzip else None)


def run_metrics(name: str, began: float, seen: Observation) -> dict[str, float]:
    """Seconds, and the metrics observed, of a command; also printed to stderr."""
    out = {"seconds": round(time.time() - began, 3), **seen.get}
    if out.get("reads"):
        out["unique_percent"] = round(100.0 * out.get("distinct", 0) / out["reads"], 2)
    print(f"{name}: " + ", ".join(f"{k} {v}" for k, v in out.items()), file=sys.stderr)
    return out


def fastq_sort(spark: SparkSession, path: str, out: str, by: str = "seq") -> None:
    sinks.write_lines(sinks.fastq_lines(R.sort_reads(fastx.read_fastx(spark, path), by), order=()), out)


def fastq_sample(spark: SparkSession, first: str, out: str, second: str | None = None, n: int | None = None, fraction: float | None = None, seed: int = 0, fasta: bool = False) -> None:
    """Samples reads, or pairs, whose second mates follow the first."""
    a = fastx.read_fastx(spark, first)
    chosen = R.sample_n(a, n, seed) if n is not None else R.sample_fraction(a, fraction, seed)
    chosen = written(chosen)
    sinks.write_lines(sinks.sampled_lines(chosen, fasta), f"{out}_1", "gzip")
    if second:
        sinks.write_lines(sinks.sampled_lines(R.pick_ordinals(fastx.read_fastx(spark, second), chosen), fasta), f"{out}_2", "gzip")


def fastq_collapse(spark: SparkSession, first: str, out: str, second: str | None = None, keep: str = "best") -> dict[str, float]:
    """Distinct reads or pairs with counts: the best, the first, or all qualities.  Returns the
    run's metrics: seconds, reads, distinct ones and their percentage."""
    began = time.time()
    a = fastx.read_fastx(spark, first)
    counted = lambda df: observed(df, f"collapse-{uuid.uuid4().hex}", F.sum("n").alias("reads"), F.count(F.lit(1)).alias("distinct"))
    if second:
        pairs = R.zip_pairs(a, fastx.read_fastx(spark, second))
        kept, seen = counted(R.collapse_best_pairs(pairs) if keep == "best" else R.collapse_first_pairs(pairs))
        kept = written(kept)
        for i in (1, 2):
            side = kept.selectExpr("n", f"name{i} as name", f"seq{i} as seq", f"qual{i} as qual")
            sinks.write_lines(sinks.fastq_lines(side, "n", ()), f"{out}_{i}")
        return run_metrics("collapse", began, seen)
    kept, seen = counted(R.collapse_all_qualities(a) if keep == "all" else R.collapse_best(a) if keep == "best" else R.collapse_first(a))
    kept = written(kept)  # observed once, whatever the sort reads again
    if keep == "all":
        sinks.write_lines(sinks.all_qualities_lines(kept), out)
    else:
        sinks.write_lines(sinks.fastq_lines(kept.orderBy("seq") if keep == "best" else R.by_count(kept), "n", ()), out)
    return run_metrics("collapse", began, seen)


def pick_pairs(spark: SparkSession, first: str, second: str, out: str) -> None:
    """Paired reads of both files, and the others, as four gzip outputs."""
    a, b = fastx.read_fastx(spark, first), fastx.read_fastx(spark, second)
    both = written(R.paired(R.pair_reads(a, b)))
    for i, own, other in ((1, a, b), (2, b, a)):
        side = both.selectExpr("key", f"name{i} as name", f"seq{i} as seq", f"qual{i} as qual").orderBy("key")
        sinks.write_lines(sinks.fastq_lines(side, order=()), f"{out}_{i}_PE", "gzip")
        sinks.write_lines(sinks.fastq_lines(R.unpaired(own, other)), f"{out}_{i}_SE", "gzip")


def bam_depth(spark: SparkSession, path: str, out: str, width: int = 20_000, region: str | None = None, wig: bool = False, compat_wig: bool = False) -> None:
    """bedGraph, windows as a table or WIG, and contig sizes."""
    rows = bam.read_bam(spark, path, **({"region": region} if region else {}))
    contigs = bam.read_contigs(spark, path).select("tid", "chrom", "length").distinct()
    runs = written(coverage.segments(coverage.blocks(rows, strict=not compat_wig)))
    windows = coverage.window_depth(runs, contigs, width, compat_wig)
    sinks.write_lines(sinks.bedgraph_lines(runs), f"{out}.bedGraph")
    sinks.write_lines(sinks.wig_lines(windows, width) if wig or compat_wig else sinks.depth_table_lines(windows), f"{out}.{'wig' if wig or compat_wig else 'depth'}")
    sinks.write_lines(sinks.chrom_sizes_lines(contigs), f"{out}.sizes")


def bam_sliding_count(spark: SparkSession, path: str, out: str, width: int = 20_000, region: str | None = None) -> DataFrame:
    """Count and GC of windows by contig, and the contigs' totals."""
    rows = bam.read_bam(spark, path, **({"region": region} if region else {}))
    contigs = bam.read_contigs(spark, path).select("tid", "chrom", "length").distinct()
    sinks.write_lines(sinks.window_table_lines(coverage.window_count_gc(rows, width, contigs), contigs, width), out)
    return coverage.contig_rollup(rows, contigs, width)


def bam_split(spark: SparkSession, path: str, folder: str) -> DataFrame:
    return sinks.bam_files(bam.read_bam(spark, path), bam.read_contigs(spark, path).select("tid", "chrom", "length").distinct(), folder)


def two_bit(spark: SparkSession, path: str, out: str) -> None:
    sinks.two_bit_file(fastx.read_fastx(spark, path), out)


def two_bit_sequences(spark: SparkSession, path: str, out: str) -> None:
    """The sequences of packed files, one a line."""
    rows = packed.read_two_bit(spark, path)
    sinks.write_lines(rows.orderBy("file", "ordinal").select(rows["seq"].alias("value")), f"{out}.decompress")


def quality_codes(spark: SparkSession, path: str, out: str) -> None:
    sinks.quality_code_file(fastx.read_fastx(spark, path), out)


def qc_report(spark: SparkSession, first: str, second: str | None = None) -> dict[str, DataFrame]:
    return qc.qc_report(fastx.read_fastx(spark, first), fastx.read_fastx(spark, second) if second else None)


def fasta_part(spark: SparkSession, path: str, name: str, begin: int, end: int) -> DataFrame:
    """Bases [begin, end) of a FASTA sequence: by its index, or, of a zipped file or one whose
    lines are not equally long, by a scan."""
    try:
        if not is_gzip(path):
            return packed.fasta_ranges(spark, path, spark.createDataFrame([(name, begin, end)], "name string, begin long, end long")).where("seq is not null").select("seq")
    except ValueError:
        pass
    return fastx.read_fastx(spark, path, layout="fastx").where(F.col("name") == name).select(F.substring("seq", begin + 1, end - begin).alias("seq"))
