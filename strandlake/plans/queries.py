"""Queries over the derived reads and alignments, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import codecs as C
from strandlake.functions import documents as DOC
from strandlake.functions import exprs as E
from strandlake.functions import sequences as SEQ
from strandlake.functions import statistics as ST
from strandlake.operators import coverage, qc
from strandlake.operators import reads as R
from strandlake.plans.tables import shared_folder
from strandlake.sources import bam, derive, fastx, sinks
from strandlake.streaming import reads as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Common tables of the SQL.
BASE = f"""
with r as ({derive.READS_SQL}), m as ({derive.MATES_SQL}), a as ({derive.ALIGNMENTS_SQL}), blk as ({derive.BLOCKS_SQL}), ctg as ({derive.CONTIGS_SQL}),
rq as (select *, list_sum(list_transform(string_split(qual, ''), lambda c: ascii(c))) as sq from r),
pr as (select r.ordinal, r.name as name1, r.seq as seq1, r.qual as qual1, m.name as name2, m.seq as seq2, m.qual as qual2,
              list_sum(list_transform(string_split(r.qual || m.qual, ''), lambda c: ascii(c))) as sq from r join m on r.ordinal = m.ordinal)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = BASE + sql
        return f

    return add


def reads(spark: SparkSession, d: str) -> DataFrame:
    return derive.reads(spark, d)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.zip_pairs(derive.reads(spark, d), derive.mates(spark, d), whole=False)


# ---- reads -------------------------------------------------------------------------------


@query("select ordinal, name, substr(seq, 4, 9) as seq, substr(qual, 4, 9) as qual, file from r")
def reads_trim(spark, d):
    return R.trim(reads(spark, d), 3, 12)


@query("select ordinal, seq from r where regexp_full_match(seq, '[ATCGN]+')")
def reads_filter_acgtn(spark, d):
    return R.only_acgtn(reads(spark, d)).select("ordinal", "seq")


@query("select count(*) as n_reads from r")
def reads_count(spark, d):
    return R.count_reads(reads(spark, d))


@query("select ordinal, seq, row_number() over (order by length(seq), seq, ordinal) as rank from r")
def reads_sort_seq_rank(spark, d):
    return R.sorted_rank(reads(spark, d)).select("ordinal", "seq", "rank")


@query("select ordinal, name, row_number() over (order by length(name), name, ordinal) as rank from r")
def reads_sort_name_rank(spark, d):
    return R.sorted_rank(reads(spark, d), "name").select("ordinal", "name", "rank")


@query("select ordinal, seq, row_number() over (order by seq, ordinal) as rank from r")
def reads_sort_bytes_rank(spark, d):
    return R.sorted_rank(reads(spark, d), "seq", "bytes").select("ordinal", "seq", "rank")


_X31 = "list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split({0}, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (h * 31 + c) & 4294967295)"


@query(f"select ordinal, name from r where ((({_X31.format('name')}) + 11) & 16777215) / 16777216.0 < 0.3")
def reads_sample_hash(spark, d):
    return R.sample_fraction(reads(spark, d), 0.3, 11).select("ordinal", "name")


@query(f"select ordinal, name1, name2 from pr where ((({_X31.format('name1')}) + 11) & 16777215) / 16777216.0 < 0.3")
def reads_sample_hash_pairs(spark, d):
    return R.sample_fraction(pairs(spark, d), 0.3, 11, "name1").select("ordinal", "name1", "name2")


@query("select ordinal, name from r order by md5(cast(ordinal as varchar) || ':5'), ordinal limit 100")
def reads_sample_n(spark, d):
    return R.sample_n(reads(spark, d), 100, 5).select("ordinal", "name")


@query("select ordinal, name from r where ordinal in (select ordinal from m where length(seq) = 21)")
def reads_pick_ordinals(spark, d):
    return R.pick_ordinals(reads(spark, d), derive.mates(spark, d).where("length(seq) = 21")).select("ordinal", "name")


@query("select seq, n, name, qual from (select *, count(*) over (partition by seq) as n, row_number() over (partition by seq order by sq desc, ordinal) as k from rq) where k = 1")
def collapse_best(spark, d):
    return R.collapse_best(reads(spark, d))


_PAIR = "select n, name1, seq1, qual1, name2, seq2, qual2 from (select *, count(*) over (partition by {0}) as n, row_number() over (partition by {0} order by {1}) as k from pr) where k = 1"


@query(_PAIR.format("seq1, seq2", "sq desc, ordinal"))
def collapse_best_pairs(spark, d):
    return R.collapse_best_pairs(pairs(spark, d))


@query(_PAIR.format("seq1 || seq2", "sq desc, ordinal"))
def collapse_best_pairs_compat(spark, d):
    return R.collapse_best_pairs(pairs(spark, d), compat_pair_key=True)


@query("select seq, count(*) as n, arg_max(name, ordinal) as name, string_agg(qual, chr(10) order by ordinal desc) as quals from r group by seq")
def collapse_all(spark, d):
    return R.collapse_all_qualities(reads(spark, d))


@query("select seq, count(*) as n, arg_min(name, ordinal) as name, arg_min(qual, ordinal) as qual from r group by seq")
def collapse_first(spark, d):
    return R.by_count(R.collapse_first(reads(spark, d)))


@query(_PAIR.format("seq1, seq2", "ordinal"))
def collapse_first_pairs(spark, d):
    return R.collapse_first_pairs(pairs(spark, d))


_DISTINCT = "select seq, name, qual, row_number() over (order by {0}) as rank from (select seq, arg_min(name, ordinal) as name, arg_min(qual, ordinal) as qual from r group by seq)"


@query(_DISTINCT.format("length(seq), seq"))
def distinct_shortlex(spark, d):
    return R.distinct_reads(reads(spark, d))


@query(_DISTINCT.format("seq"))
def distinct_bytes(spark, d):
    return R.distinct_reads(reads(spark, d), "bytes")


_RANKED = "(select ordinal, seq, row_number() over (order by seq, ordinal desc) as rank from r)"


@query(f"select * from {_RANKED}")
def rank_reads(spark, d):
    return R.rank_reads(reads(spark, d)).select("ordinal", "seq", "rank")


@query(f"select * from {_RANKED} where rank between 10 and 60")
def rank_range(spark, d):
    return R.rank_range(reads(spark, d), 10, 60).select("ordinal", "seq", "rank")


@query(f"select * from {_RANKED} where rank not between 10 and 60")
def rank_range_removed(spark, d):
    return R.rank_range(reads(spark, d), 10, 60, outside=True).select("ordinal", "seq", "rank")


@query("select seq, count(*) as n, min(k) as rank from (select seq, rank() over (order by seq) as k from r) group by seq")
def key_rank(spark, d):
    return R.key_ranks(reads(spark, d))


@query("select ordinal, seq from r order by seq, ordinal desc limit 20")
def top_reads(spark, d):
    return R.top_reads(reads(spark, d)).select("ordinal", "seq")


@query("select max(case when seq <= 'G' then seq end) as at_most, min(case when seq >= 'G' then seq end) as at_least from r")
def key_neighbours(spark, d):
    return R.neighbours(reads(spark, d), "G")


@query("select ordinal, name1, seq1, qual1, name2, seq2, qual2 from pr")
def pair_zip(spark, d):
    return pairs(spark, d)


_OUTER = "(select split_part(name, ' ', 1) as key, name as name1, seq as seq1, qual as qual1 from r where qual not like '#%') x {0} (select split_part(name, ' ', 1) as key, name as name2, seq as seq2, qual as qual2 from m) y using (key)"


def _sides(spark, d):
    return reads(spark, d).where("qual not like '#%'"), derive.mates(spark, d)


@query(f"select * from {_OUTER.format('full join')}")
def pair_full_outer(spark, d):
    return R.pair_reads(*_sides(spark, d))


@query(f"select * from {_OUTER.format('join')}")
def pair_pe(spark, d):
    return R.paired(R.pair_reads(*_sides(spark, d)))


@query(f"select name1 as name, seq1 as seq, qual1 as qual from {_OUTER.format('anti join')}")
def pair_se1(spark, d):
    return R.unpaired(*_sides(spark, d)).select("name", "seq", "qual")


@query("select name, seq, qual from m where split_part(name, ' ', 1) not in (select split_part(name, ' ', 1) from r where qual not like '#%')")
def pair_se2(spark, d):
    a, b = _sides(spark, d)
    return R.unpaired(b, a).select("name", "seq", "qual")


# ---- scalar functions --------------------------------------------------------------------


@query(f"""
select ordinal, {_X31.format('name')} as x31,
       list_reduce(list_prepend(cast(5381 as bigint), list_transform(string_split(name, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (h * 33 + c) & 4294967295) as djb2,
       sq as sum_quality, split_part(name, ' ', 1) as key
from (select *, cast(sq as bigint) as sq_ from rq)
""".replace("sq as sum_quality", "sq_ as sum_quality"))
def expr_hashes(spark, d):
    name = F.col("name")
    return reads(spark, d).select("ordinal", E.x31(name).alias("x31"), E.djb2(name).alias("djb2"), E.sum_quality(F.col("qual")).alias("sum_quality"), E.read_key(name).alias("key"))


@query("""
select ordinal, (length(seq) - length(translate(seq, 'GC', ''))) / cast(length(seq) as double) as gc, reverse(translate(seq, 'ACGT', 'TGCA')) as revcomp,
       translate(seq, 'TCAGN', '01230') as codes, substr(seq, 1, 50) as dup_key, len(regexp_extract_all(seq, 'CA')) as n_ca, bit_count(ordinal) as bits
from r
""")
def expr_sequence(spark, d):
    seq = F.col("seq")
    return reads(spark, d).select(
        "ordinal", E.gc_fraction(seq).alias("gc"), E.reverse_complement(seq).alias("revcomp"), E.base_codes(seq).alias("codes"), E.duplicate_key(seq).alias("dup_key"),
        F.size(E.find_all(seq, "CA")).cast("long").alias("n_ca"), F.bit_count("ordinal").cast("int").alias("bits"),
    )


@query("""
select ordinal, list_filter(string_split(name, ':'), lambda x: x <> '') as parts, case when instr(file, 'X') > 0 then 23 else cast(regexp_extract(file, '([0-9]+)', 1) as integer) end as chrom,
       try_cast(regexp_extract(substr(name, 3), '^[0-9]+') as bigint) as number, upper(to_base(ordinal, 16)) as hex, format('{:,}', ordinal) as commas
from r
""")
def expr_text(spark, d):
    name = F.col("name")
    return reads(spark, d).select(
        "ordinal", E.split_nonempty(name, ":").alias("parts"), E.chromosome_number(F.col("file")).alias("chrom"), E.parse_unsigned(F.substring(name, 3, 100)).alias("number"),
        E.to_base(F.col("ordinal"), 16).alias("hex"), E.with_commas(F.col("ordinal")).alias("commas"),
    )


_MASK = "& 4294967295"


@query(f"""
, k1 as (select ordinal, ordinal {_MASK} as k from r), k2 as (select ordinal, (k + ((~(k << 15)) {_MASK})) {_MASK} as k from k1), k3 as (select ordinal, xor(k, k >> 10) as k from k2),
k4 as (select ordinal, (k + (k << 3)) {_MASK} as k from k3), k5 as (select ordinal, xor(k, k >> 6) as k from k4), k6 as (select ordinal, (k + ((~(k << 11)) {_MASK})) {_MASK} as k from k5)
select ordinal, xor(k, k >> 16) as wang, xor(xor(ordinal >> 33, ordinal), ordinal << 11) {_MASK} as folded from k6
""")
def expr_integer_hashes(spark, d):
    return reads(spark, d).select("ordinal", E.wang32(F.col("ordinal")).alias("wang"), E.fold64(F.col("ordinal")).alias("folded"))


@query("select ordinal, translate(seq, 'N', 'T') as two_bit, translate(seq, 'N', 'T') as three_base, qual as quality, length(seq) as n from r")
def codec_round_trips(spark, d):
    n, zero = F.length("seq"), F.lit(0)
    return reads(spark, d).select(
        "ordinal", C.unpack_2bit(C.pack_2bit(F.col("seq")), zero, n).alias("two_bit"), C.unpack_3(C.pack_3(F.col("seq")), zero, n).alias("three_base"),
        C.decode_quality_rle(C.encode_quality_rle(F.col("qual")), F.length("qual")).alias("quality"), n.cast("long").alias("n"),
    )


@query("""
select ordinal, upper(hex(list_reduce(list_prepend(cast(0 as hugeint), list_transform(string_split(rpad(translate(seq, 'TCAGN', '01230'), 24, '0'), ''), lambda c: cast(c as hugeint))), lambda h, c: h * 4 + c))) as packed
from r
""".replace("upper(hex(", "lpad(upper(to_hex(").replace("h * 4 + c)))", "h * 4 + c))), 12, '0')"))
def codec_pack_2bit(spark, d):
    return reads(spark, d).select("ordinal", F.rpad(F.hex(C.pack_2bit(F.col("seq"))), 12, "0").alias("packed"))


# ---- quality control ---------------------------------------------------------------------

_AT_LEAST = "sum(len(list_filter(string_split(qual, ''), lambda c: ascii(c) >= {0}))) * 100.0 / sum(length(seq))"
_SUMMARY = f"count(*) as reads, cast(sum(length(seq)) as bigint) as bases, avg(length(seq)) as mean_length, min(length(seq)) as min_length, max(length(seq)) as max_length, {_AT_LEAST.format(53)} as q20, {_AT_LEAST.format(63)} as q30"


@query(f"select file, {_SUMMARY} from r group by file")
def qc_summary(spark, d):
    return qc.qc_summary(reads(spark, d))


@query(f"select file, {_SUMMARY} from r group by grouping sets ((file), ())")
def qc_summary_total(spark, d):
    return qc.qc_summary_total(reads(spark, d))


@query("select cast(length(seq) as integer) as length, count(*) as n from r group by 1")
def qc_length_histogram(spark, d):
    return qc.length_histogram(reads(spark, d))


_QM = "select cast(p - 1 as integer) as cycle, ascii(qual[p]) as quality, count(*) as n from (select qual, unnest(range(1, length(qual) + 1)) as p from r) group by 1, 2"


@query(_QM)
def qc_quality_matrix(spark, d):
    return qc.quality_matrix(reads(spark, d))


@query("select cast(p - 1 as integer) as cycle, seq[p] as base, count(*) as n from (select seq, unnest(range(1, length(seq) + 1)) as p from r) group by 1, 2")
def qc_base_matrix(spark, d):
    return qc.base_matrix(reads(spark, d))


@query("select ordinal, (length(seq) - length(translate(seq, 'GC', ''))) / cast(length(seq) as double) as gc from r")
def qc_gc_per_read(spark, d):
    return qc.gc_per_read(reads(spark, d))


@query("select avg((length(seq) - length(translate(seq, 'GC', ''))) / cast(length(seq) as double)) as mean_gc, sum(length(seq) - length(translate(seq, 'GC', ''))) / cast(sum(length(seq)) as double) as total_gc from r")
def qc_mean_gc(spark, d):
    return qc.mean_gc(reads(spark, d))


_DUPS = "(select substr(seq, 1, 50) as key, count(*) as n from r group by 1)"


@query(f"select * from {_DUPS}")
def qc_duplicate_counts(spark, d):
    return qc.duplicate_counts(reads(spark, d))


@query(f"select cast(case when n <= 20 then n when n < 50 then 21 when n < 100 then 50 when n < 500 then 100 else 500 end as bigint) as hits, count(*) as keys from {_DUPS} group by 1")
def qc_hits_histogram(spark, d):
    return qc.hits_histogram(qc.duplicate_counts(reads(spark, d)))


@query("""
, u as (select least(count(*), 10) as level, count(*) as n from r group by name), v as (select ordinal % 11 + 1 as n from r),
l as (select least(n, 10) as level, cast(sum(n) as bigint) as reads from v group by 1)
select level, reads, reads / cast((select reads from l where level = 1) as double) as relative, 1 - (select reads from l where level = 1) / (select sum(reads) from l) as duplication from l
""")
def qc_duplication_levels(spark, d):
    return qc.duplication_levels(reads(spark, d).select((F.col("ordinal") % 11 + 1).alias("n")))


@query(f"select cast(sum(n) filter (quality between 53 and 74) as double) / sum(n) as q20, cast(coalesce(sum(n) filter (quality between 63 and 74), 0) as double) / sum(n) as q30 from ({_QM}) where quality between 33 and 74")
def qc_quality_shares(spark, d):
    return qc.quality_shares(qc.quality_matrix(reads(spark, d)))


@query("""
select cast(p - 1 as integer) as cycle, min(ascii(qual[p])) as low, quantile_disc(ascii(qual[p]), 0.25) as q1, quantile_disc(ascii(qual[p]), 0.5) as median, quantile_disc(ascii(qual[p]), 0.75) as q3, max(ascii(qual[p])) as high
from (select qual, unnest(range(1, length(qual) + 1)) as p from r) group by 1
""")
def qc_quality_box(spark, d):
    return qc.quality_box(qc.quality_matrix(reads(spark, d)))


@query("select cast(sum(length(seq)) as bigint) as bases, count(*) as reads, avg(length(seq)) as mean_length from r")
def qc_length_summary(spark, d):
    return qc.length_summary(qc.length_histogram(reads(spark, d)))


@query("select cast(least(floor((length(seq) - length(translate(seq, 'GC', ''))) / cast(length(seq) as double) * 50), 49) as bigint) as bin, count(*) as n from r group by 1")
def qc_gc_histogram(spark, d):
    return qc.gc_histogram(reads(spark, d))


# ---- coverage ----------------------------------------------------------------------------

_STRICT, _LAX = "(flag & 1796) = 0", "(flag & 4) = 0"
_EVENTS = f"select chrom, pos, cast(sum(d) as bigint) as d from (select chrom, s as pos, 1 as d from blk where {_STRICT} union all select chrom, e, -1 from blk where {_STRICT}) group by 1, 2 having sum(d) <> 0"
_SEGMENTS = f'seg as (select * from (select chrom, pos as start, lead(pos) over (partition by chrom order by pos) as "end", cast(sum(d) over (partition by chrom order by pos) as bigint) as depth from ({_EVENTS})) where depth > 0)'


def alignments(spark, d):
    return derive.alignments(spark, d)


@query(f"select chrom, s, e from blk where {_STRICT}")
def coverage_blocks(spark, d):
    return coverage.blocks(alignments(spark, d))


@query(f"select chrom, s, e from blk where {_LAX}")
def coverage_blocks_lax(spark, d):
    return coverage.blocks(alignments(spark, d), strict=False)


@query("select ordinal, cast(list_sum(list_transform(list_filter(cigar, lambda c: c.op in (0, 2, 3, 7, 8)), lambda c: c.len)) as bigint) as span, length(seq) - length(translate(seq, 'GC', '')) as gc from a")
def alignment_span(spark, d):
    return alignments(spark, d).select("ordinal", E.reference_span(F.col("cigar")).alias("span"), E.gc_count(F.col("seq")).alias("gc"))


@query(f"select chrom, pos, d as delta from ({_EVENTS})")
def coverage_events(spark, d):
    return coverage.depth_events(coverage.blocks(alignments(spark, d)))


@query(f", {_SEGMENTS} select * from seg")
def bedgraph(spark, d):
    return coverage.segments(coverage.blocks(alignments(spark, d)))


_WINDOWS = 'win as (select chrom, length, "window", "window" * 1000 as start, least(("window" + 1) * 1000, length) as "end" from (select chrom, length, unnest(range(0, length // 1000 + 1)) as "window" from ctg))'
_OVER = "least(seg.\"end\", win.start + 1000) - greatest(seg.start, win.start)"
_WIG_END = 'least((win."window" + 1) * 1000 - 1, win.length)'
_OVER_WIG = f'case when seg.start < win.start then case when seg."end" < {_WIG_END} then seg."end" - win.start else {_WIG_END} - win.start + 1 end else case when seg."end" <= {_WIG_END} then seg."end" - seg.start else {_WIG_END} - seg.start end end'
_DEPTHS = ', {0}, {1} select win.chrom, win."window", win.start, win."end", coalesce(sum(depth * ({2})), 0) / 1000.0 as value from win left join seg on seg.chrom = win.chrom and seg.start < win.start + 1000 and seg."end" > win.start group by 1, 2, 3, 4'


def _segments(spark, d):
    return coverage.segments(coverage.blocks(alignments(spark, d)))


@query(_DEPTHS.format(_SEGMENTS, _WINDOWS, _OVER))
def window_depth(spark, d):
    return coverage.window_depth(_segments(spark, d), derive.contigs(spark), 1000)


@query(_DEPTHS.format(_SEGMENTS, _WINDOWS, _OVER_WIG))
def window_depth_wig(spark, d):
    return coverage.window_depth(_segments(spark, d), derive.contigs(spark), 1000, compat_wig=True)


_GC = f"select chrom, pos // 1000 as \"window\", count(*) as n, cast(sum(length(seq) - length(translate(seq, 'GC', ''))) as bigint) as gc, cast(sum(l_qseq) as bigint) as bases from a where {_LAX} group by 1, 2"


@query(f'select *, gc * 100.0 / bases as gc_percent from ({_GC})')
def window_count_gc(spark, d):
    return coverage.window_count_gc(alignments(spark, d), 1000)


@query(f"select chrom, cast(sum(n) as bigint) as n, cast(sum(bases) as bigint) as bases, sum(bases) / cast(any_value(length) as double) as mean_coverage, sum(gc) * 100.0 / sum(bases) as mean_gc from ({_GC}) join ctg using (chrom) group by 1")
def contig_rollup(spark, d):
    return coverage.contig_rollup(alignments(spark, d), derive.contigs(spark), 1000)


@query(f"select max(n) as most, avg(n) as mean, stddev_samp(n) as sd from ({_GC})")
def window_moments(spark, d):
    return coverage.window_count_gc(alignments(spark, d), 1000).agg(F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))


@query("select chrom, count(*) as n from a group by 1")
def contig_counts(spark, d):
    return coverage.contig_counts(alignments(spark, d))


@query("select ordinal from a where chrom = 'chr1' and pos < 60000 and pos + list_sum(list_transform(list_filter(cigar, lambda c: c.op in (0, 2, 3, 7, 8)), lambda c: c.len)) > 50000")
def region_filter(spark, d):
    return coverage.in_region(alignments(spark, d), *coverage.parse_region("chr1:50,001-60,000")).select("ordinal")


@query(f"select x.chrom, x.s, x.e from (select chrom, s, e from blk where {_STRICT}) x where exists (select 1 from (select chrom, pos * 3 % 200000 as s, pos * 3 % 200000 + 5 as e from a where flag = 16) y where x.chrom = y.chrom and x.s < y.e and y.s < x.e)")
def interval_semi(spark, d):
    right = alignments(spark, d).where("flag = 16").select("chrom", (F.col("pos") * 3 % 200000).alias("s"), (F.col("pos") * 3 % 200000 + 5).alias("e"))
    return coverage.overlapping(coverage.blocks(alignments(spark, d)), right)


@query(f""", g as (select chrom, s, e, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) as m from blk where {_STRICT}),
i as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by chrom order by s, e rows unbounded preceding) as k from g) select chrom, min(s) as s, max(e) as e from i group by chrom, k""")
def interval_union(spark, d):
    return coverage.merge_intervals(coverage.blocks(alignments(spark, d)))


@query("select * from ctg")
def chrom_sizes(spark, d):
    return derive.contigs(spark)


# ---- statistics --------------------------------------------------------------------------


def _orders(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet")


@query("select corr(l_quantity, l_extendedprice) as r from lineitem")
def stat_pearson(spark, d):
    return ST.pearson(_orders(spark, d), "l_quantity", "l_extendedprice")


@query("""
, k as (select l_quantity as x, l_discount as y from lineitem), t as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from k)
select corr(rx, ry) as rho from t
""")
def stat_spearman(spark, d):
    return ST.spearman(_orders(spark, d), "l_quantity", "l_discount")


@query("""
, c as (select l_returnflag as x, l_linestatus as y, count(*) as n from lineitem group by 1, 2), rx as (select x, sum(n) as rx from c group by 1), cy as (select y, sum(n) as cy from c group by 1)
select sum(n) * (sum(n * n / (cast(rx as double) * cy)) - 1) as chi2, cast((count(distinct x) - 1) * (count(distinct y) - 1) as bigint) as df from c join rx using (x) join cy using (y)
""")
def stat_chi_square(spark, d):
    return ST.chi_square(_orders(spark, d), "l_returnflag", "l_linestatus").select("chi2", "df")


@query("""
, p as (select l_suppkey % 20 as g, sum(l_quantity) as s, count(*) as n from lineitem group by 1), t as (select sum(s) as ts, sum(n) as tn, count(*) as g from p), l as (select (ts - s) / (tn - n) as m from p, t)
select (select ts / tn from t) as estimate, (select g - 1 from t) * var_pop(m) as variance from l
""")
def stat_jackknife(spark, d):
    return ST.jackknife(_orders(spark, d).withColumn("g", F.col("l_suppkey") % 20), "g", "l_quantity")


@query("""
, k as (select unnest(range(0, 20)) as id)
select id, round(lgamma((id + 1) / 4.0), 9) as lgamma,
       round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: (1 - 2 * (n % 2)) * pow((id + 1) / 10.0, 2 * n + 1) / (exp(lgamma(n + 1)) * (2 * n + 1)))), 9) as erfc,
       round(1 - exp(-2) * list_sum(list_transform(range(0, id + 1), lambda n: pow(2.0, n) / exp(lgamma(n + 1)))), 9) as gamma_p,
       round(pow(0.3, (id + 1) / 4.0) * (1 + (id + 1) / 4.0 * 0.7), 9) as beta_i
from k
""")
def stat_special_functions(spark, d):
    import math

    x, nine = (F.col("id") + 1) / 4, lambda c, name: F.round(c, 9).alias(name)
    gamma, erfc, beta = ST.special(math.lgamma), ST.special(math.erfc), ST.special(ST.beta_i)
    whole = (F.col("id") + 1).cast("double")
    return spark.range(20).select("id", nine(gamma(x), "lgamma"), nine(erfc(whole / 10), "erfc"), nine(ST.special(ST.gamma_p)(whole, F.lit(2.0)), "gamma_p"), nine(beta(x, F.lit(2.0), F.lit(0.3)), "beta_i"))


# ---- documents, alignments of sequences, files and streams -------------------------------


@query("select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.missing.x[0]') as missing from events")
def expr_json(spark, d):
    props = F.col("props")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", DOC.json_at(props, "k").alias("k"), DOC.json_at(props, "missing", "x", 0).alias("missing"))


@query()
def align_local(spark, d):
    both = R.zip_pairs(derive.reads(spark, d), derive.mates(spark, d), whole=False)
    return both.select("ordinal", SEQ.local_alignment(F.col("seq1"), E.reverse_complement(F.col("seq2"))).alias("a")).select("ordinal", "a.*")


@query("select ordinal, name, seq, qual from r")
def source_fastq_round_trip(spark, d):
    path = f"{shared_folder(spark)}/fastq-{uuid.uuid4().hex}"
    sinks.write_lines(sinks.fastq_lines(reads(spark, d)), path, "gzip")
    back = fastx.read_fastx(spark, path)
    # files follow the order, but number their own records: the name holds the place
    return back.select(F.regexp_extract("name", "@R([0-9]+)", 1).cast("long").alias("ordinal"), "name", "seq", "qual")


@query("select ordinal, qname, flag, chrom, pos, l_qseq, cast(len(cigar) as integer) as ops from a".replace("ordinal, qname", "ordinal"))
def source_bam_round_trip(spark, d):
    folder = f"{shared_folder(spark)}/bam-{uuid.uuid4().hex}"
    some = alignments(spark, d).withColumn("qname", F.col("ordinal").cast("string"))
    sinks.bam_files(some.withColumn("mapq", F.lit(0)).withColumn("qual", F.lit(None).cast("string")), derive.contigs(spark), folder).collect()
    bam.index_bam(spark, folder).collect()
    return bam.read_bam(spark, folder, chunk="4096").select(F.col("qname").cast("long").alias("ordinal"), "flag", "chrom", "pos", "l_qseq", F.size("cigar").alias("ops"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_windowed_counts(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"windows_{uuid.uuid4().hex}"
    counted = streams.windowed_counts(stream, width="1 day", by="event_type")
    streams.run_once(counted, name, "complete", f"{shared_folder(spark)}/{name}")
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return collapse_best(spark, d)
