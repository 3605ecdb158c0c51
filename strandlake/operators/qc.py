"""Quality control of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import exprs as E

Q20, Q30 = 53, 63


def _at_least(qual: Column, code: int) -> Column:
    """How many characters have at least this ASCII value."""
    return (F.length(qual) - F.length(F.regexp_replace(qual, f"[\\x{code:02x}-\\x7f]", ""))).cast("long")


def _summary() -> list[Column]:
    n = F.length("seq")
    bases = F.sum(n)
    return [
        F.count(F.lit(1)).alias("reads"),
        bases.alias("bases"),
        F.avg(n).alias("mean_length"),
        F.min(F.when(n > 0, n)).cast("long").alias("min_length"),
        F.max(n).cast("long").alias("max_length"),
        (F.sum(_at_least(F.col("qual"), Q20)) * 100.0 / F.nullif(bases, F.lit(0))).alias("q20"),
        (F.sum(_at_least(F.col("qual"), Q30)) * 100.0 / F.nullif(bases, F.lit(0))).alias("q30"),
    ]


def qc_summary(reads: DataFrame) -> DataFrame:
    """Per file: reads, bases, mean, least (zero ignored) and largest length, Q20 and Q30 in %."""
    return reads.groupBy("file").agg(*_summary())


def qc_summary_total(reads: DataFrame) -> DataFrame:
    """The summary of each file and, under a null file, of all, in one pass."""
    return reads.groupingSets([["file"], []], "file").agg(*_summary())


def length_histogram(reads: DataFrame) -> DataFrame:
    """(length, n) for every length from the smallest to the largest."""
    counted = reads.groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counted.agg(F.min("length").alias("a"), F.max("length").alias("b")).where("a is not null")
    every = bounds.select(F.explode(F.sequence("a", "b")).alias("length"))
    return every.join(counted, "length", "left").select("length", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def quality_matrix(reads: DataFrame) -> DataFrame:
    """(cycle, quality, n): ASCII values by cycle, from 0."""
    each = reads.select(F.posexplode(E.characters(F.col("qual"))).alias("cycle", "c"))
    return each.groupBy("cycle", F.ascii("c").alias("quality")).agg(F.count(F.lit(1)).alias("n"))


def quality_table(matrix: DataFrame, cycles: int) -> DataFrame:
    """The matrix as a row for each of the values 0 to 127 and a column for each cycle."""
    rows = matrix.sparkSession.range(128).select(F.col("id").cast("int").alias("quality"))
    wide = matrix.groupBy("quality").pivot("cycle", list(range(cycles))).agg(F.sum("n"))
    return rows.join(wide, "quality", "left").na.fill(0).orderBy("quality")


def base_matrix(reads: DataFrame) -> DataFrame:
    """(cycle, base, n): T, C, A, G and N by cycle; ``.`` is N, any other character T."""
    each = reads.select(F.posexplode(E.characters(F.col("seq"))).alias("cycle", "c"))
    base = F.when(F.col("c").isin("C", "A", "G", "N"), F.col("c")).when(F.col("c") == ".", "N").otherwise("T")
    return each.groupBy("cycle", base.alias("base")).agg(F.count(F.lit(1)).alias("n"))


def gc_per_read(reads: DataFrame) -> DataFrame:
    return reads.select("ordinal", E.gc_fraction(F.col("seq")).alias("gc"))


def mean_gc(reads: DataFrame) -> DataFrame:
    """Mean of the reads' own GC shares, and GC over all bases."""
    seq = F.col("seq")
    return reads.agg(F.avg(E.gc_fraction(seq)).alias("mean_gc"), (F.sum(E.gc_count(seq)) / F.nullif(F.sum(F.length(seq)), F.lit(0))).alias("total_gc"))


def duplicate_counts(reads: DataFrame) -> DataFrame:
    """(key, n) of duplicates by the first 50 bases of long reads."""
    return reads.groupBy(E.duplicate_key(F.col("seq")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def hits_histogram(counts: DataFrame) -> DataFrame:
    """(hits, keys): distinct keys by number of reads: 1 to 20, then from 21, 50, 100 and 500."""
    n = F.col("n")
    bin_ = F.when(n <= 20, n).when(n < 50, 21).when(n < 100, 50).when(n < 500, 100).otherwise(500).cast("long")
    return counts.groupBy(bin_.alias("hits")).agg(F.count(F.lit(1)).alias("keys"))


def duplication_levels(counts: DataFrame) -> DataFrame:
    """(level, reads, relative, duplication): reads by level 1 to 10 (10 and more), relative to
    level 1, and the share of reads beyond level 1."""
    level = F.least(F.col("n"), F.lit(10).cast("long"))
    per = counts.groupBy(level.alias("level")).agg(F.sum("n").alias("reads"))
    all_ = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # ten rows
    first = F.sum(F.when(F.col("level") == 1, F.col("reads"))).over(all_)
    total = F.sum("reads").over(all_)
    return per.select("level", "reads", (F.col("reads") / first).alias("relative"), (1 - F.coalesce(first, F.lit(0)) / total).alias("duplication"))


def quality_shares(matrix: DataFrame) -> DataFrame:
    """Q20 and Q30 as shares of the values 33 to 74 of a quality matrix."""
    n = lambda low: F.sum(F.when(F.col("quality").between(low, 74), F.col("n")))
    return matrix.agg((F.coalesce(n(Q20), F.lit(0)) / n(33)).alias("q20"), (F.coalesce(n(Q30), F.lit(0)) / n(33)).alias("q30"))


def quality_box(matrix: DataFrame) -> DataFrame:
    """Per cycle: least, quartiles and largest quality, weighted by counts; quartiles are the
    smallest value at which the share is reached."""
    w = Window.partitionBy("cycle").orderBy("quality")
    run = matrix.withColumn("run", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("cycle")))
    at = lambda p: F.min(F.when(F.col("run") >= F.col("all") * p, F.col("quality")))
    return run.groupBy("cycle").agg(F.min("quality").alias("low"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("quality").alias("high"))


def length_summary(histogram: DataFrame) -> DataFrame:
    """Total bases, total reads and mean length of a length histogram."""
    bases = F.sum(F.col("length").cast("long") * F.col("n"))
    return histogram.agg(bases.alias("bases"), F.sum("n").alias("reads"), (bases / F.sum("n")).alias("mean_length"))


def gc_histogram(reads: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n) of the reads' GC shares."""
    gc = E.gc_fraction(F.col("seq"))
    return reads.select(gc.alias("gc")).where("gc is not null").groupBy(F.least(F.floor(F.col("gc") * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def gc_density(histogram: DataFrame, bins: int = 50, points: int = 101) -> dict:
    """A Gaussian kernel density over a GC histogram, and the Gaussian k exp(-(x - mean)^2 / 2 sd^2)
    fitted to it by least squares.

    Works on at most ``bins`` numbers, on the driver."""
    import numpy as np

    rows = {r["bin"]: r["n"] for r in histogram.collect()}
    x, n = (np.arange(bins) + 0.5) / bins, np.array([rows.get(i, 0) for i in range(bins)], float)
    grid = np.linspace(0, 1, points)
    if not n.sum():
        return {"x": grid, "density": np.zeros(points), "mean": None, "sd": None, "height": None}
    mean = (x * n).sum() / n.sum()
    sd = float(np.sqrt((n * (x - mean) ** 2).sum() / n.sum()))
    width = max(0.9 * max(sd, 1 / bins) * n.sum() ** -0.2, 1e-3)
    density = (np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2) * n).sum(1) / (n.sum() * width * np.sqrt(2 * np.pi))
    # damped Gauss-Newton steps from the moments
    fit, damp = np.array([density.max(), mean, max(sd, width)]), 1e-3

    def apart(p: np.ndarray) -> np.ndarray:
        return p[0] * np.exp(-0.5 * ((grid - p[1]) / p[2]) ** 2) - density

    for _ in range(100):
        z = (grid - fit[1]) / fit[2]
        bell = np.exp(-0.5 * z * z)
        slope = np.column_stack([bell, fit[0] * bell * z / fit[2], fit[0] * bell * z * z / fit[2]])
        r = apart(fit)
        normal = slope.T @ slope
        step = np.linalg.solve(normal + damp * np.diag(np.diag(normal) + 1e-12), slope.T @ r)
        new = fit - step
        if new[2] > 0 and (apart(new) ** 2).sum() <= (r * r).sum():
            done = np.abs(step).max() < 1e-10
            fit, damp = new, damp / 3
            if done:
                break
        else:
            damp *= 4
    return {"x": grid, "density": density, "mean": float(fit[1]), "sd": float(fit[2]), "height": float(fit[0])}


def qc_report(reads: DataFrame, mates: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a quality report: GC, quality and base matrices, lengths, duplicates."""
    report = {}
    for i, part in enumerate([reads] if mates is None else [reads, mates], 1):
        report |= {f"gc_{i}": gc_per_read(part), f"quality_{i}": quality_matrix(part), f"bases_{i}": base_matrix(part), f"lengths_{i}": length_histogram(part)}
    keyed = reads
    if mates is not None:
        other = mates.select("ordinal", E.duplicate_key(F.col("seq")).alias("s2"))
        keyed = reads.join(other, "ordinal").withColumn("seq", F.concat(E.duplicate_key(F.col("seq")), F.col("s2")))
        report["duplicates"] = keyed.groupBy(F.col("seq").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    else:
        report["duplicates"] = duplicate_counts(reads)
    return report
