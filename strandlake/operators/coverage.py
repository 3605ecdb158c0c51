"""Coverage of contigs by alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import exprs as E

#: Bases of a contig over which one task sums depths.
BIN = 1 << 20


def blocks(alignments: DataFrame, strict: bool = True, compat_cigar: bool = False) -> DataFrame:
    """(chrom, s, e) of the aligned blocks of alignments that pass the strict or lax filter."""
    kept = alignments.where(E.strict_filter() if strict else E.lax_filter())
    return kept.select("chrom", F.inline(E.aligned_blocks(F.col("pos"), F.col("cigar"), compat_cigar)))


def depth_events(blocks: DataFrame) -> DataFrame:
    """(chrom, pos, delta): net changes of depth, zeros left out; combined before the shuffle."""
    both = blocks.select("chrom", F.inline(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("e").alias("pos"), F.lit(-1).alias("d")))))
    return both.groupBy("chrom", "pos").agg(F.sum("d").alias("delta")).where("delta <> 0")


def _with_depth(events: DataFrame, bin_size: int) -> DataFrame:
    """events with ``bin`` and ``depth``, the running sum up to and with each position.

    Sums run within bins of a contig; what is carried into a bin comes from the bins'
    totals, of which there are few, so that no contig is one task.
    """
    events = events.withColumn("bin", F.floor(F.col("pos") / bin_size))
    before = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = events.groupBy("chrom", "bin").agg(F.sum("delta").alias("total"))
    carried = totals.select("chrom", "bin", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("chrom", "bin").orderBy("pos")
    return events.join(carried, ["chrom", "bin"]).select("chrom", "bin", "pos", "delta", (F.col("carried") + F.sum("delta").over(inside)).alias("depth"))


def _with_next(rows: DataFrame) -> DataFrame:
    """rows (chrom, bin, pos, ...) with ``next``, the contig's next position, across bins too."""
    firsts = rows.groupBy("chrom", "bin").agg(F.min("pos").alias("first"))
    beyond = firsts.select("chrom", "bin", F.lead("first").over(Window.partitionBy("chrom").orderBy("bin")).alias("beyond"))
    inside = Window.partitionBy("chrom", "bin").orderBy("pos")
    return rows.join(beyond, ["chrom", "bin"]).withColumn("next", F.coalesce(F.lead("pos").over(inside), F.col("beyond"))).drop("beyond")


def segments(blocks: DataFrame, bin_size: int = BIN) -> DataFrame:
    """(chrom, start, end, depth): maximal half-open runs of equal depth above zero.

    Events are dealt to bins of a contig once; there the running sum and the next position are
    taken, and what a bin needs of the others, the depth carried into it and the first
    position after it, comes from one row a bin."""
    events = depth_events(blocks).withColumn("bin", F.floor(F.col("pos") / bin_size))
    bins = Window.partitionBy("chrom").orderBy("bin")
    per = events.groupBy("chrom", "bin").agg(F.sum("delta").alias("total"), F.min("pos").alias("first"))
    carried = F.coalesce(F.sum("total").over(bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("chrom", "bin", carried.alias("carried"), F.lead("first").over(bins).alias("beyond"))
    inside = Window.partitionBy("chrom", "bin").orderBy("pos")
    depth, after = F.col("carried") + F.sum("delta").over(inside), F.coalesce(F.lead("pos").over(inside), F.col("beyond"))
    run = events.join(per, ["chrom", "bin"]).select("chrom", F.col("pos").alias("start"), after.alias("end"), depth.alias("depth"))
    return run.where("depth > 0")


def window_count(contigs: DataFrame, width: int) -> DataFrame:
    """(chrom, window, start, end) of all windows of each contig: length div width + 1 of them."""
    last = F.floor(F.col("length") / width)
    every = contigs.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window"))
    return every.select("chrom", "window", (F.col("window") * width).alias("start"), F.least((F.col("window") + 1) * width, F.col("length")).alias("end"))


def window_depth(segments: DataFrame, contigs: DataFrame, width: int = 20_000, compat_wig: bool = False) -> DataFrame:
    """(chrom, window, start, end, value): summed depth over the full width, of every window.

    Each segment is dealt to the windows that it meets, an equi-grouping instead of an
    interval join.  With ``compat_wig``, windows end inclusively, which loses a base of
    segments that leave a window and gains one of those that end at its end.
    """
    s, e, d = F.col("start"), F.col("end"), F.col("depth")
    # with inclusive ends a segment meets one more window only to add nothing
    parts = segments.select("chrom", s, e, d, F.explode(F.sequence(F.floor(s / width), F.floor((e - 1) / width))).alias("window"))
    begin = F.col("window") * width
    if compat_wig:
        parts = parts.join(contigs.select("chrom", "length"), "chrom")
        end = F.least((F.col("window") + 1) * width - 1, F.col("length"))
        over = F.when(s < begin, F.when(e < end, e - begin).otherwise(end - begin + 1)).otherwise(F.when(e <= end, e - s).otherwise(end - s))
    else:
        over = F.least(e, begin + width) - F.greatest(s, begin)
    sums = parts.select("chrom", "window", (d * over).alias("v")).groupBy("chrom", "window").agg(F.sum("v").alias("v"))
    return window_count(contigs, width).join(sums, ["chrom", "window"], "left").select("chrom", "window", "start", "end", (F.coalesce("v", F.lit(0)) / F.lit(float(width))).alias("value"))


def window_count_gc(alignments: DataFrame, width: int = 20_000, contigs: DataFrame | None = None) -> DataFrame:
    """(chrom, window, n, gc, bases, gc_percent) of mapped alignments by their start.

    With contigs (chrom, length), every window of each contig that has an alignment, those
    without one as zeros; else only windows with alignments."""
    kept = alignments.where(E.lax_filter())
    out = kept.groupBy("chrom", E.window_id(F.col("pos"), width).alias("window")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(E.gc_count(F.col("seq"))).alias("gc"), F.sum(F.col("l_qseq").cast("long")).alias("bases")
    )
    if contigs is not None:
        every = window_count(contigs, width).select("chrom", "window").join(out.select("chrom").distinct(), "chrom", "left_semi")
        out = every.join(out, ["chrom", "window"], "full").select("chrom", "window", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "gc", "bases")))
    return out.withColumn("gc_percent", F.when(F.col("gc") == 0, 0.0).otherwise(F.col("gc") * 100.0 / F.col("bases")))


def contig_rollup(alignments: DataFrame, contigs: DataFrame, width: int = 20_000) -> DataFrame:
    """(chrom, n, bases, mean_coverage, mean_gc) from the windows."""
    per = window_count_gc(alignments, width).groupBy("chrom").agg(F.sum("n").alias("n"), F.sum("bases").alias("bases"), F.sum("gc").alias("gc"))
    return per.join(contigs, "chrom").select(
        "chrom", "n", "bases", (F.col("bases") / F.col("length")).alias("mean_coverage"), F.when(F.col("gc") == 0, 0.0).otherwise(F.col("gc") * 100.0 / F.col("bases")).alias("mean_gc")
    )


def depth_quantiles(values: DataFrame, column: str, q: float = 0.95, by: str = "chrom") -> DataFrame:
    """(by, quantile): the value at place int(float32(q) * float32(n)) of each group's sorted
    column, not interpolated.  Values are counted first, so equal ones are one row."""
    counted = values.groupBy(by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(by)
    reached = F.sum("_c").over(group.orderBy("_v"))
    total = F.sum("_c").over(group)
    at = F.least((F.lit(q).cast("float") * total.cast("float")).cast("float").cast("long"), total - 1)
    return counted.select(by, "_v", (reached > at).alias("_past")).where("_past").groupBy(by).agg(F.min("_v").alias("quantile"))


def hits_plot_data(windows: DataFrame, q: float = 0.95, height: int = 40) -> DataFrame:
    """(chrom, window, n, quantile, height): each window's bar in whole pixels of a contig whose
    quantile of counts is ``height`` pixels tall; zero where the quantile is."""
    top = depth_quantiles(windows, "n", q)
    tall = F.when(F.col("quantile") == 0, F.lit(0)).otherwise(F.floor(F.col("n") * height / F.col("quantile"))).cast("long")
    return windows.join(top, "chrom").select("chrom", "window", "n", "quantile", tall.alias("height"))


def trimmed_mean(values: DataFrame, column: str, sigmas: float = 3.0, rounds: int = 20) -> DataFrame:
    """(n, mean, sd) after dropping values beyond so many standard deviations until none is."""
    low, high = float("-inf"), float("inf")
    kept = values.select(F.col(column).cast("double").alias("x")).where("x is not null")
    seen = -1
    for _ in range(rounds):
        n, mean, sd = kept.where(F.col("x").between(low, high)).agg(F.count("x"), F.avg("x"), F.stddev_samp("x")).first()
        if n in (0, seen) or not sd:
            break
        seen, low, high = n, mean - sigmas * sd, mean + sigmas * sd
    return kept.where(F.col("x").between(low, high)).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))


def contig_counts(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def in_region(alignments: DataFrame, chrom: str, begin: int = 0, end: int | None = None) -> DataFrame:
    """Alignments that overlap [begin, end) of a contig."""
    reach = F.col("pos") + E.reference_span(F.col("cigar"))
    hit = (F.col("chrom") == chrom) & (reach > begin)
    return alignments.where(hit if end is None else hit & (F.col("pos") < end))


def parse_region(region: str) -> tuple[str, int, int | None]:
    """chr, chr:b or chr:b-e (1-based, inclusive, commas allowed) as half-open and 0-based."""
    chrom, _, span = region.partition(":")
    if not span:
        return chrom, 0, None
    begin, _, end = span.replace(",", "").partition("-")
    return chrom, max(int(begin) - 1, 0), int(end) if end else None


def overlapping(left: DataFrame, right: DataFrame, width: int = 1024) -> DataFrame:
    """Rows of left (chrom, s, e) that overlap an interval of right: intervals are dealt to
    bins, joined on these and tested; each row is kept once, by its own place and content."""
    from strandlake.plans.tables import written

    merged = merge_intervals(right)
    binned = lambda df: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    keyed = written(left.withColumn("_row", F.monotonically_increasing_id()))
    a = binned(keyed.where("e > s").select("_row", "chrom", "s", "e")).alias("a")
    b = binned(merged).alias("b")
    hit = a.join(b, (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e")))
    return keyed.join(hit.select("_row").distinct(), "_row", "left_semi").drop("_row")


def merge_intervals(intervals: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Unions of intervals (chrom, s, e) that touch or overlap: the covered runs."""
    depth = _with_depth(depth_events(intervals.where("e > s").select("chrom", "s", "e")), bin_size)
    edges = depth.where("depth = 0 or depth = delta").select("chrom", "bin", "pos", "depth")
    return _with_next(edges).where("depth > 0").select("chrom", F.col("pos").alias("s"), F.col("next").alias("e"))


def split_by_contig(alignments: DataFrame, path: str) -> None:
    """Writes a folder of Parquet for each contig."""
    alignments.withColumn("contig", F.coalesce("chrom", F.lit("unmapped"))).write.partitionBy("contig").parquet(path)
