"""Operators on reads (ordinal, name, seq, qual, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import exprs as E
from strandlake.plans.tables import with_global_rank


def trim(reads: DataFrame, start: int = 0, end: int = 400) -> DataFrame:
    """Cycles [start, end) of seq and qual; a start past the end gives empty strings."""
    cut = lambda c: F.substring(c, start + 1, max(end - start, 0)).alias(c)
    return reads.select(*(cut(c) if c in ("seq", "qual") else c for c in reads.columns))


def only_acgtn(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("seq").rlike("^[ATCGN]+$"))


def count_reads(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count(F.lit(1)).alias("n_reads"))


def shortlex(column: str) -> list[Column]:
    """Order by length, then bytes."""
    return [F.length(column), F.col(column)]


def sort_reads(reads: DataFrame, by: str = "seq", order: str = "shortlex") -> DataFrame:
    """Reads sorted by seq or name, shortlex or bytewise; ties by ordinal."""
    keys = shortlex(by) if order == "shortlex" else [F.col(by)]
    return reads.orderBy(*keys, "ordinal")


def sorted_rank(reads: DataFrame, by: str = "seq", order: str = "shortlex") -> DataFrame:
    """Reads with their row number in that order."""
    keys = shortlex(by) if order == "shortlex" else [F.col(by)]
    return with_global_rank(reads, [*keys, F.col("ordinal")])


def sample_fraction(reads: DataFrame, fraction: float, seed: int = 0, name: str = "name") -> DataFrame:
    """Reads whose name's hash, moved by the seed, lies below the fraction; no shuffle."""
    return reads.where(E.sample_fraction_of(F.col(name), seed) < fraction)


def parse_fraction(value: float, generator=None) -> tuple[float, int]:
    """(fraction, seed offset) of a number whose whole part is a seed for ``generator``."""
    whole = int(value)
    return value - whole, generator(whole) if generator and whole else whole


def sample_n(reads: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n reads, without replacement, in their order; n over the total is an error.

    The n smallest keyed hashes are taken, a top-n that needs no full sort.
    """
    total = reads.count()
    if n > total:
        raise ValueError(f"{n} of {total} reads")
    key = F.md5(F.concat(F.col("ordinal").cast("string"), F.lit(f":{seed}")).cast("binary"))
    return reads.withColumn("_key", key).orderBy("_key", "ordinal").limit(n).drop("_key").orderBy("ordinal")


def pick_ordinals(reads: DataFrame, chosen: DataFrame) -> DataFrame:
    """Reads whose ordinal is among the chosen ones."""
    return reads.join(chosen.select("ordinal"), "ordinal", "left_semi")


def zip_pairs(first: DataFrame, second: DataFrame, check: bool = True, whole: bool = True) -> DataFrame:
    """Mates by position; with ``check``, unequal names (to the first space) are an error, and
    with ``whole`` so is a read without a mate, whichever columns are used later.  Else reads
    without a mate are left out."""
    a = first.select("ordinal", *(F.col(c).alias(f"{c}1") for c in ("name", "seq", "qual")))
    b = second.select("ordinal", *(F.col(c).alias(f"{c}2") for c in ("name", "seq", "qual")))
    both = a.join(b, "ordinal", "full" if whole else "inner")
    alone, unequal = F.lit(False), F.lit(False)
    if whole:
        alone = F.col("name1").isNull() | F.col("name2").isNull()
    if check:
        unequal = E.read_key(F.col("name1")) != E.read_key(F.col("name2"))
    if not (check or whole):
        return both
    names = F.concat(F.lit("unequal mates: "), F.coalesce("name1", F.lit("none")), F.lit(" and "), F.coalesce("name2", F.lit("none")))
    return both.where(F.when(alone | unequal, F.raise_error(names).cast("boolean")).otherwise(F.lit(True)))


def pair_reads(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer join of two files' reads on their names to the first space.

    key and name, seq and qual of each side; a side is null for an unpaired read."""
    side = lambda df, i: df.select(E.read_key(F.col("name")).alias("key"), *(F.col(c).alias(f"{c}{i}") for c in ("name", "seq", "qual")))
    return side(first, 1).join(side(second, 2), "key", "full_outer")


def paired(pairs: DataFrame) -> DataFrame:
    return pairs.where("name1 is not null and name2 is not null")


def unpaired(reads: DataFrame, others: DataFrame) -> DataFrame:
    """Reads without a mate among the others."""
    key = E.read_key(F.col("name"))
    return reads.withColumn("_key", key).join(others.select(key.alias("_key")), "_key", "left_anti").drop("_key")


def collapse_best(reads: DataFrame) -> DataFrame:
    """Per distinct seq: its count and the read of the highest summed quality, the first on ties.

    Sums and the best row are combined before the shuffle, so a hot sequence is no hot task.
    """
    return reads.groupBy("seq").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct("name", "qual"), F.struct(E.sum_quality(F.col("qual")).alias("q"), (-F.col("ordinal")).alias("o"))).alias("best"),
    ).select("seq", "n", F.col("best.name").alias("name"), F.col("best.qual").alias("qual"))


def _pair_key(compat: bool) -> list[Column]:
    return [F.concat("seq1", "seq2").alias("k")] if compat else [F.col("seq1").alias("k1"), F.col("seq2").alias("k2")]


def collapse_best_pairs(pairs: DataFrame, compat_pair_key: bool = False) -> DataFrame:
    """As collapse_best over both mates; with ``compat_pair_key`` mates are one string, so
    that different pairs of the same concatenation are one."""
    q = (E.sum_quality(F.col("qual1")) + E.sum_quality(F.col("qual2"))).alias("q")
    kept = F.struct("name1", "seq1", "qual1", "name2", "seq2", "qual2")
    return pairs.groupBy(*_pair_key(compat_pair_key)).agg(F.count(F.lit(1)).alias("n"), F.max_by(kept, F.struct(q, (-F.col("ordinal")).alias("o"))).alias("best")).select("n", "best.*")


def collapse_first(reads: DataFrame) -> DataFrame:
    """Per distinct seq: its count and its first read."""
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("name", "qual"), "ordinal").alias("first")).select(
        "seq", "n", F.col("first.name").alias("name"), F.col("first.qual").alias("qual")
    )


def collapse_first_pairs(pairs: DataFrame, compat_pair_key: bool = False) -> DataFrame:
    kept = F.struct("name1", "seq1", "qual1", "name2", "seq2", "qual2")
    return pairs.groupBy(*_pair_key(compat_pair_key)).agg(F.count(F.lit(1)).alias("n"), F.min_by(kept, "ordinal").alias("first")).select("n", "first.*")


def collapse_all_qualities(reads: DataFrame) -> DataFrame:
    """Per distinct seq: its count, the last read's name, and all qualities, last first."""
    every = F.reverse(F.sort_array(F.collect_list(F.struct("ordinal", "qual"))))
    return reads.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.max_by("name", "ordinal").alias("name"), every.alias("e")).select(
        "seq", "n", "name", F.array_join(F.transform("e", lambda x: x["qual"]), "\n").alias("quals")
    )


def by_count(collapsed: DataFrame) -> DataFrame:
    """Collapsed reads, most frequent first, ties by sequence."""
    return collapsed.orderBy(F.desc("n"), "seq")


def distinct_reads(reads: DataFrame, order: str = "shortlex") -> DataFrame:
    """The first read of each sequence, with its rank in shortlex or byte order."""
    first = collapse_first(reads).drop("n")
    return with_global_rank(first, shortlex("seq") if order == "shortlex" else [F.col("seq")])


def rank_reads(reads: DataFrame) -> DataFrame:
    """Each read's place by seq; of equal ones, later reads stand before earlier."""
    return with_global_rank(reads, [F.col("seq"), -F.col("ordinal")])


def rank_range(reads: DataFrame, start: int, stop: int, outside: bool = False) -> DataFrame:
    """Reads of places start to stop, or all others."""
    inside = F.col("rank").between(start, stop)
    return rank_reads(reads).where(~inside if outside else inside)


def key_ranks(reads: DataFrame) -> DataFrame:
    """(seq, n, rank): the lowest place of each sequence; ranks run over distinct sequences,
    whose counts give the places."""
    counted = reads.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    return with_running_sum(counted, "seq", "n").select("seq", "n", (F.col("before") + 1).alias("rank"))


def with_running_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with ``before``, the sum of value over all smaller keys: within ranges, plus the
    sums of earlier ranges."""
    from pyspark.sql import Window

    from strandlake.plans.tables import written

    ranged = written(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r["s"] for r in ranged.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    offsets, at = {}, 0
    for part in sorted(sums):
        offsets[part] = at
        at += sums[part]
    if not offsets:
        return df.withColumn("before", F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair)), F.col("_part")).cast("long")
    here = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("before", here + offset).drop("_part")


def top_reads(reads: DataFrame, n: int = 20) -> DataFrame:
    """The first n reads by seq, later ones first among equals."""
    return reads.orderBy("seq", F.desc("ordinal")).limit(n)


def neighbours(reads: DataFrame, key: str) -> DataFrame:
    """(at_most, at_least): the largest seq not above a key and the smallest not below it."""
    return reads.agg(F.max(F.when(F.col("seq") <= key, F.col("seq"))).alias("at_most"), F.min(F.when(F.col("seq") >= key, F.col("seq"))).alias("at_least"))


def key_range(reads: DataFrame, low: str, high: str, outside: bool = False) -> DataFrame:
    """Reads whose seq lies between two keys, both included, or all others."""
    inside = F.col("seq").between(low, high)
    return reads.where(~inside if outside else inside)


def range_ends(reads: DataFrame, low: str, high: str) -> DataFrame:
    """(first, last, n): the smallest and the largest seq between two keys, and the reads there."""
    return key_range(reads, low, high).agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))
