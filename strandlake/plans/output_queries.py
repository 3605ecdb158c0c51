"""Queries of written outputs, indexed sources, sequence algorithms and further statistics, and
their SQL for DuckDB.  They join the queries of ``strandlake.plans.queries``."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from strandlake.functions import codecs as C
from strandlake.functions import documents as DOC
from strandlake.functions import exprs as E
from strandlake.functions import matrices as M
from strandlake.functions import sequences as SEQ
from strandlake.functions import statistics as ST
from strandlake.operators import coverage, qc
from strandlake.operators import reads as R
from strandlake.plans import queries as Q
from strandlake.plans.queries import alignments, query, reads
from strandlake.plans.tables import gone_at_end, shared_folder
from strandlake.sources import bam, derive, fastx, packed, sinks
from strandlake.streaming import reads as streams

T = "chr(9)"
N = "chr(10)"


def _folder(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


# ---- lines of outputs --------------------------------------------------------------------

_BEST = "(select *, count(*) over (partition by seq) as n, row_number() over (partition by seq order by sq desc, ordinal) as k from rq)"


@query(f"select name || {T} || n || {N} || seq || {N} || '+' || {N} || qual as value from {_BEST} where k = 1")
def lines_fastq_count(spark, d):
    return sinks.fastq_lines(R.collapse_best(reads(spark, d)), "n", ())


@query(f"select arg_max(name, ordinal) || {T} || count(*) || {N} || seq || {N} || '+' || {N} || string_agg(qual, {N} order by ordinal desc) as value from r group by seq")
def lines_all_qualities(spark, d):
    return sinks.all_qualities_lines(R.collapse_all_qualities(reads(spark, d)))


@query(f"select '>' || name || '_' || (ordinal + 1) || {N} || seq as value from (select * from r order by md5(cast(ordinal as varchar) || ':5'), ordinal limit 50)")
def lines_sampled(spark, d):
    return sinks.sampled_lines(R.sample_n(reads(spark, d), 50, 5), fasta=True)


@query(f', {Q._SEGMENTS} select chrom || {T} || start || {T} || "end" || {T} || depth as value from seg')
def lines_bedgraph(spark, d):
    return sinks.bedgraph_lines(Q._segments(spark, d))


def _depths(spark, d, wig: bool = False):
    return coverage.window_depth(Q._segments(spark, d), derive.contigs(spark), 1000, compat_wig=wig)


def _values(over: str) -> str:
    head, _, select = Q._DEPTHS.format(Q._SEGMENTS, Q._WINDOWS, over).partition(" select win.chrom")
    return f"{head}, val as (select win.chrom{select})"


@query(f"""{_values(Q._OVER)} select chrom || {T} || start || {T} || "end" || {T} || printf('%.2f', value) as value from val""")
def lines_depth_table(spark, d):
    return sinks.depth_table_lines(_depths(spark, d))


@query(f"""{_values(Q._OVER)} select distinct 'variableStep chrom=' || chrom || ' span=1000' as value from val where value > 0
union all select start || ' ' || printf('%.2f', value) from val where value > 0""")
def lines_wig(spark, d):
    return sinks.wig_lines(_depths(spark, d), 1000)


@query(f"select chrom || {T} || length as value from ctg")
def lines_chrom_sizes(spark, d):
    return sinks.chrom_sizes_lines(derive.contigs(spark))


_EVERY = f"""gcw as ({Q._GC}), whole as (
  select w.chrom, w.length, w."window", coalesce(n, 0) as n, cast(coalesce(gc, 0) as bigint) as gc, cast(coalesce(bases, 0) as bigint) as bases
  from (select chrom, length, unnest(range(0, length // 1000 + 1)) as "window" from ctg where chrom in (select chrom from gcw)) w left join gcw on w.chrom = gcw.chrom and w."window" = gcw."window")"""
_PERCENT = "case when gc = 0 then 0.0 else gc * 100.0 / bases end"


def _windows(spark, d):
    return coverage.window_count_gc(alignments(spark, d), 1000, derive.contigs(spark))


@query(f', {_EVERY} select chrom, "window", n, gc, bases, {_PERCENT} as gc_percent from whole')
def window_count_gc_every(spark, d):
    return _windows(spark, d)


@query(f"""
, {_EVERY}, sums as (select chrom, any_value(length) as length, sum(n) as n, sum(bases) as bases, sum(gc) as gc,
                            string_agg(("window" + 1) || {T} || n || {T} || printf('%.6f', cast({_PERCENT} as double)), {T} order by "window") as cells from whole group by chrom)
select '#chr' || {T} || 'chr_len' || {T} || 'chr_sum_read_count' || {T} || 'chr_sum_base' || {T} || 'chr_mean_cov' || {T} || 'chr_mean_GC%'
       || (select string_agg({T} || i || {T} || 'count' || {T} || 'GC%', '' order by i) from (select unnest(range(1, max(length) // 1000 + 2)) as i from ctg)) as value
union all
select chrom || {T} || length || {T} || n || {T} || bases || {T} || printf('%.6f', cast(bases / cast(length as double) as double)) || {T} || printf('%.6f', cast({_PERCENT} as double)) || {T} || cells from sums
""")
def lines_window_table(spark, d):
    return sinks.window_table_lines(_windows(spark, d), derive.contigs(spark), 1000)


_TOP = f"{_EVERY}, top as (select chrom, list(n order by n)[cast(floor(cast(cast(0.95 as float) * cast(count(*) as float) as float)) as integer) + 1] as quantile from whole group by chrom)"


@query(f", {_TOP} select * from top")
def window_quantiles(spark, d):
    return coverage.depth_quantiles(_windows(spark, d), "n", 0.95)


@query(f', {_TOP} select chrom, "window", n, quantile, cast(case when quantile = 0 then 0 else n * 40 // quantile end as bigint) as height from whole join top using (chrom)')
def hits_plot_data(spark, d):
    return coverage.hits_plot_data(_windows(spark, d))


@query(f"""
, v as (select cast(n as double) as x from ({Q._GC})), bounds as (
  with recursive t as (
    select 0 as i, cast(-1e308 as double) as low, cast(1e308 as double) as high, cast(-1 as bigint) as seen, true as more
    union all
    select i + 1, case when go then m - 3 * s else low end, case when go then m + 3 * s else high end, n, go
    from (select i, low, high, n, m, s, n > 0 and n <> seen and s > 0 as go
          from (select t.i, t.low, t.high, t.seen, (select count(*) from v where x between t.low and t.high) as n,
                       (select avg(x) from v where x between t.low and t.high) as m, (select stddev_samp(x) from v where x between t.low and t.high) as s
                from t where t.more and t.i < 20))
  ) select arg_max(low, i) as low, arg_max(high, i) as high from t
)
select count(*) as n, avg(x) as mean, stddev_samp(x) as sd from v, bounds where x between low and high
""")
def window_trimmed_mean(spark, d):
    return coverage.trimmed_mean(coverage.window_count_gc(alignments(spark, d), 1000), "n")


@query(f"""select file || {T} || reads || {T} || bases || {T} || printf('%.0f', mean_length) || {T} || min_length || {T} || max_length || {T} || printf('%.3f', cast(q20 as double)) || {T} || printf('%.3f', cast(q30 as double)) as value
from (select file, {Q._SUMMARY} from r group by file)""")
def lines_qc(spark, d):
    return sinks.qc_lines(qc.qc_summary(reads(spark, d)))


@query(f"""
, h as (select l as length, count(r.seq) as n from (select unnest(range(min(length(seq)), max(length(seq)) + 1)) as l from r) left join r on length(r.seq) = l group by l)
select '#Len:' || {T} || string_agg(cast(length as varchar), {T} order by length) as value from h union all select '#Freq:' || {T} || string_agg(cast(n as varchar), {T} order by length) from h
""")
def lines_lengths(spark, d):
    return sinks.length_histogram_lines(qc.length_histogram(reads(spark, d)))


@query(f"""
, qm as ({Q._QM}) select string_agg(cast(coalesce(n, 0) as varchar), {T} order by c) as value
from (select q, c from (select unnest(range(0, 128)) as q), (select unnest(range(0, 12)) as c)) left join qm on qm.quality = q and qm.cycle = c group by q
""")
def lines_quality_table(spark, d):
    return sinks.quality_table_lines(qc.quality_table(qc.quality_matrix(reads(spark, d)), 12))


@query("""
, u1 as (select 'gc_1' as part, count(*) as n, sum((length(seq) - length(translate(seq, 'GC', ''))) / cast(length(seq) as double)) as v from r),
u2 as (select 'lengths_1' as part, count(*) as n, cast(sum(x) as double) as v from (select count(*) as x from r group by length(seq))),
u3 as (select 'duplicates' as part, count(*) as n, cast(sum(x) as double) as v from (select count(*) as x from r group by substr(seq, 1, 50))),
u4 as (select 'quality_1' as part, count(*) as n, cast(sum(x) as double) as v from (select count(*) as x from (select qual, unnest(range(1, length(qual) + 1)) as p from r) group by p, qual[p])),
u5 as (select 'bases_1' as part, count(*) as n, cast(sum(x) as double) as v from (select count(*) as x from (select seq, unnest(range(1, length(seq) + 1)) as p from r) group by p, seq[p]))
select part, n, round(v, 6) as v from u1 union all select part, n, round(v, 6) from u2 union all select part, n, round(v, 6) from u3 union all select part, n, round(v, 6) from u4 union all select part, n, round(v, 6) from u5
""")
def report_tables(spark, d):
    report = qc.qc_report(reads(spark, d))
    some = {"gc_1": "gc", "quality_1": "n", "bases_1": "n", "lengths_1": "n", "duplicates": "n"}
    parts = [report[k].where(F.col(v) > 0 if k == "lengths_1" else F.lit(True)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v).cast("double"), 6).alias("v")).select(F.lit(k).alias("part"), "n", "v") for k, v in some.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_LEVELS = """, c as (select count(*) as n from r group by substr(seq, 1, 50)), l as (select least(n, 10) as level, cast(sum(n) as bigint) as reads from c group by 1)
select level, reads, reads / cast((select reads from l where level = 1) as double) as relative, 1 - coalesce((select reads from l where level = 1), 0) / (select sum(reads) from l) as duplication from l"""


@query(_LEVELS)
def qc_read_duplication_levels(spark, d):
    return qc.duplication_levels(qc.duplicate_counts(reads(spark, d)))


@query("select substr(case when ordinal % 3 = 0 then repeat(seq, 5) else seq end, 1, 50) as key, count(*) as n from r group by 1")
def qc_long_duplicate_counts(spark, d):
    long = F.when(F.col("ordinal") % 3 == 0, F.repeat("seq", 5)).otherwise(F.col("seq"))
    return qc.duplicate_counts(reads(spark, d).withColumn("seq", long))


@query("select seq, n, row_number() over (order by n desc, seq) as place from (select seq, count(*) as n from r group by seq)")
def collapse_order(spark, d):
    from strandlake.plans.tables import with_global_rank

    return with_global_rank(R.collapse_first(reads(spark, d)).select("seq", "n"), [-F.col("n"), F.col("seq")], "place")


# ---- sources -----------------------------------------------------------------------------


@query("select ordinal, name, seq, qual from r")
def source_plain_files(spark, d):
    path = _folder(spark, "plain")
    sinks.write_lines(sinks.fastq_lines(reads(spark, d).repartition(3), order=()), path)
    back = fastx.read_fastx(spark, path, split="true", chunk="65536")
    return back.select(F.regexp_extract("name", "@R([0-9]+)", 1).cast("long").alias("ordinal"), "name", "seq", "qual")


@query("select ordinal, split_part(name, ' ', 1) as name, split_part(name, ' ', 2) as comment, seq from r")
def source_fasta(spark, d):
    path = _folder(spark, "fasta")
    folded = F.regexp_replace("seq", "(.{7})(?=.)", "$1\n")
    sinks.write_lines(reads(spark, d).select(F.concat(F.lit(">"), F.substring("name", 2, 1000), F.lit("\n"), folded).alias("value")), path)
    back = fastx.read_fastx(spark, path, layout="fastx")
    return back.select(F.regexp_extract("name", "R([0-9]+)", 1).cast("long").alias("ordinal"), F.concat(F.lit("@"), "name").alias("name"), F.coalesce("comment", F.lit("")).alias("comment"), "seq")


@query("select ordinal, substr(seq, 4, 9) as seq from r where ordinal < 300")
def source_fasta_ranges(spark, d):
    path = f"{_folder(spark, 'genome')}/genome.fa"
    from strandlake.sources.files import write_whole

    rows = reads(spark, d).where("ordinal < 300").orderBy("ordinal").select("ordinal", "seq").collect()  # a genome's few sequences
    write_whole(path, "".join(f">s{r['ordinal']}\n" + "".join(r["seq"][i : i + 6] + "\n" for i in range(0, len(r["seq"]), 6)) for r in rows).encode())
    asked = reads(spark, d).where("ordinal < 300").select(F.concat(F.lit("s"), "ordinal").alias("name"), F.lit(3).alias("begin"), F.lit(12).alias("end"))
    return packed.fasta_ranges(spark, path, asked).select(F.substring("name", 2, 20).cast("long").alias("ordinal"), "seq")


@query("select row_number() over (order by ordinal) - 1 as place, translate(substr(seq, 1, 20), 'N', 'T') as seq from r")
def source_two_bit_round_trip(spark, d):
    path = _folder(spark, "twobit")
    cut = reads(spark, d).select("ordinal", F.substring("seq", 1, 20).alias("seq"))
    sizes = {r["part"]: r["n"] for r in sinks.two_bit_parts(cut, path, compat_order=False).collect()}
    before, at = {}, 0
    for part in sorted(sizes):
        before[part], at = at, at + sizes[part]
    part = F.regexp_extract("file", "part-([0-9]+)", 1).cast("int")
    first = F.element_at(F.create_map(*(F.lit(x) for p in before.items() for x in p)), part).cast("long")
    return packed.read_two_bit(spark, path, chunk="1000").select((first + F.col("ordinal")).alias("place"), "seq")


@query("select qual, count(*) as n from (select substr(qual, 1, 20) as qual from r) group by 1")
def source_quality_codes_round_trip(spark, d):
    path = _folder(spark, "codes")
    sinks.quality_code_parts(reads(spark, d).select("ordinal", F.substring("qual", 1, 20).alias("qual")), path).collect()
    return packed.read_quality_codes(spark, path, 20).groupBy("qual").agg(F.count(F.lit(1)).alias("n"))


@query("select ordinal, pos from a where chrom = 'chr1' and pos < 60000 and pos + list_sum(list_transform(list_filter(cigar, lambda c: c.op in (0, 2, 3, 7, 8)), lambda c: c.len)) > 50000")
def source_bam_region(spark, d):
    folder = _folder(spark, "region")
    some = alignments(spark, d).withColumn("qname", F.col("ordinal").cast("string"))
    sinks.bam_files(some.withColumn("mapq", F.lit(0)).withColumn("qual", F.lit(None).cast("string")), derive.contigs(spark), folder).collect()
    bam.index_bam(spark, folder).collect()
    return bam.read_bam(spark, folder, region="chr1:50,001-60,000", chunk="4096").select(F.col("qname").cast("long").alias("ordinal"), "pos")


# ---- keys, functions, statistics ---------------------------------------------------------


@query("select min(seq) as first, max(seq) as last, count(*) as n from r where seq between 'AC' and 'GT'")
def key_range_ends(spark, d):
    return R.range_ends(reads(spark, d), "AC", "GT")


@query("select ordinal, seq from r where seq not between 'AC' and 'GT'")
def key_range_removed(spark, d):
    return R.key_range(reads(spark, d), "AC", "GT", outside=True).select("ordinal", "seq")


@query("select list(l_extendedprice order by l_extendedprice)[1000] as value from lineitem")
def kth_smallest(spark, d):
    return ST.kth_smallest(Q._orders(spark, d), "l_extendedprice", 1000)


@query("select ordinal, row_number() over (order by md5(cast(ordinal as varchar) || ':3'), cast(ordinal as varchar)) as place from r")
def shuffle_places(spark, d):
    from strandlake.plans.tables import with_global_rank

    key = F.md5(F.concat(F.col("ordinal").cast("string"), F.lit(":3")).cast("binary"))
    return with_global_rank(reads(spark, d).select("ordinal"), [key, F.col("ordinal").cast("string")], "place")


@query("""
select ordinal, len(list_filter(string_split(translate(rpad(seq, 32, 'T'), 'N', 'T'), ''), lambda c: c = 'T')) as t, len(list_filter(string_split(seq, ''), lambda c: c = 'C')) as c,
       len(list_filter(string_split(seq, ''), lambda c: c = 'A')) as a, len(list_filter(string_split(seq, ''), lambda c: c = 'G')) as g
from r
""")
def expr_base_counts(spark, d):
    word = F.conv(F.hex(C.pack_2bit(F.rpad(F.col("seq"), 32, "T"))), 16, -10).cast("long")
    return reads(spark, d).select("ordinal", *(E.code_count(word, i).cast("long").alias(x) for i, x in enumerate("tcag")))


@query("""
select ordinal, upper(printf('%02x%02x%02x%02x', (p & 127) + 1, ((p >> 7) & 127) + 1, ((p >> 14) & 127) + 1, ((p >> 21) & 127) + 1)) as code, p as place
from (select ordinal, cast(ordinal * 7919 % 268435456 as bigint) as p from r)
""")
def expr_place_codes(spark, d):
    place = (F.col("ordinal") * 7919 % (1 << 28)).cast("long")
    return reads(spark, d).select("ordinal", E.place_code(place).alias("c")).select("ordinal", F.hex("c").alias("code"), E.place_of_code(F.col("c")).alias("place"))


@query("""
select ordinal, trim(name, '@R') as trimmed, lower(name) as low, upper(name) as up, substr(name, 2, 4) as part, name < 'Z' as below, translate(name, '0123', 'abcd') as mapped, array_to_string(string_split(name, ':'), '/') as joined,
       name || '-' || seq as both, printf('%05d|%8.3f|%-6s|%x', cast(ordinal as bigint), ordinal / 7.0, substr(seq, 1, 4), cast(ordinal as bigint)) as formatted, string_split(name, ' ')[1] as token
from r
""")
def expr_strings(spark, d):
    name = F.col("name")
    return reads(spark, d).select(
        "ordinal", F.btrim(name, F.lit("@R")).alias("trimmed"), F.lower(name).alias("low"), F.upper(name).alias("up"), F.substring(name, 2, 4).alias("part"), (name < "Z").alias("below"),
        F.translate(name, "0123", "abcd").alias("mapped"), F.array_join(F.split(name, ":"), "/").alias("joined"), F.concat(name, F.lit("-"), F.col("seq")).alias("both"),
        F.format_string("%05d|%8.3f|%-6s|%x", "ordinal", F.col("ordinal") / 7.0, F.substring("seq", 1, 4), "ordinal").alias("formatted"), F.element_at(F.split(name, " "), 1).alias("token"),
    )


@query("select event_id, cast(json(props) as varchar) as text from events where json_valid(props)")
def expr_json_values(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", DOC.json_text(DOC.json_value(F.col("props"))).alias("text")).where("text is not null")


_TREE = "select r_regionkey as region, '(' || string_agg(n_name || ':' || (n_nationkey + 1), ',' order by n_nationkey) || ')' || r_name || ';' as text, count(*) as k from nation join region on n_regionkey = r_regionkey group by r_regionkey, r_name"


@query(f"""
, t as ({_TREE}), leaf as (select n_regionkey as region, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as integer) as node, n_name as name, cast(n_nationkey + 1 as double) as distance from nation)
select region, node, cast(k as integer) as parent, name, distance from leaf join t using (region)
union all select region, cast(k as integer), -1, r_name, null from t join region on region = r_regionkey
""")
def newick_nodes(spark, d):
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    leaf = F.struct("n_nationkey", F.concat_ws(":", "n_name", (F.col("n_nationkey") + 1).cast("string")).alias("t"))
    inner = F.array_join(F.transform(F.sort_array(F.collect_list(leaf)), lambda x: x["t"]), ",")
    trees = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").alias("region"), "r_name").agg(inner.alias("i"))
    trees = trees.select("region", F.concat(F.lit("("), "i", F.lit(")"), "r_name", F.lit(";")).alias("text"))
    return trees.lateralJoin(DOC.NewickNodes(F.col("text").outer())).select("region", "node", "parent", "name", "distance")


@query("select ordinal, list_transform(list_sort(list_transform(range(0, length(seq)), lambda i: {'s': substr(seq, cast(i + 1 as bigint)), 'i': i})), lambda x: cast(x.i as integer)) as places from r")
def sequence_suffixes(spark, d):
    return reads(spark, d).select("ordinal", SEQ.suffixes(F.col("seq")).alias("places"))


@query("""
, s as (select ordinal, seq, unnest(range(0, length(seq) + 1)) as i from r), o as (select ordinal, seq, i, row_number() over (partition by ordinal order by substr(seq, i + 1)) - 1 as k from s)
select ordinal, string_agg(seq[i], '' order by k) filter (i > 0) as text, cast(max(k) filter (i = 0) as integer) as row from o group by ordinal
""")
def sequence_transform(spark, d):
    return reads(spark, d).select("ordinal", SEQ.transformed(F.col("seq")).alias("t")).select("ordinal", "t.*")


@query("select ordinal, length(seq) * 2 as score, length(seq) || 'M' as cigar, length(seq) * 2 as extended, length(seq) as query_bases from r")
def sequence_global_self(spark, d):
    seq = F.col("seq")
    both = reads(spark, d).select("ordinal", SEQ.global_alignment(seq, seq).alias("g"), SEQ.extension(seq, seq).alias("e"))
    return both.select("ordinal", F.col("g.score").cast("long").alias("score"), "g.cigar", F.col("e.score").cast("long").alias("extended"), F.col("e.query_bases").cast("long").alias("query_bases"))


@query("select ordinal, 2 * length(seq) as score, length(seq) - 1 as te, length(seq) - 1 as qe, 0 as tb, 0 as qb from r")
def sequence_local_self(spark, d):
    both = reads(spark, d).select("ordinal", SEQ.local_alignment(F.col("seq"), F.col("seq")).alias("a"))
    return both.select("ordinal", *(F.col(f"a.{c}").cast("long").alias(c) for c in ("score", "te", "qe", "tb", "qb")))


@query("""
select ordinal, cast(2 * (length(seq) - 5) - 5 - 2 * 5 as bigint) as score, (length(seq) - 5) || 'M5I' as cigar from r
""")
def sequence_global_cut(spark, d):
    target = F.repeat(F.lit("A"), F.length("seq") - 5)
    both = reads(spark, d).select("ordinal", SEQ.global_alignment(F.concat(target, F.lit("CCCCC")), target).alias("g"))  # only an insertion at the end fits
    return both.select("ordinal", F.col("g.score").cast("long").alias("score"), "g.cigar")


_MODEL = SEQ.HiddenMarkov(np.array([1.0, 0.0]), np.array([[0.0, 1.0], [1.0, 0.0]]), np.array([[0.2, 0.2, 0.2, 0.2, 0.2], [0.4, 0.1, 0.2, 0.2, 0.1]]))


@query("""
select ordinal, substr(repeat('01', 50), 1, length(seq)) as path,
       round(list_sum(list_transform(range(1, length(seq) + 1), lambda i: ln(case when i % 2 = 1 then 0.2 when seq[i] = 'A' then 0.4 when seq[i] in ('C', 'N') then 0.1 else 0.2 end))), 6) as logp
from r
""")
def sequence_state_paths(spark, d):
    done = reads(spark, d).select("ordinal", SEQ.state_paths(_MODEL, F.col("seq"), "ACGTN").alias("p"), SEQ.likelihoods(_MODEL, F.col("seq"), "ACGTN").alias("l"))
    return done.select("ordinal", "p.path", F.round((F.col("p.logp") + F.col("l")) / 2, 6).alias("logp"))


@query("""
, n as (select l_suppkey % 50 as g, cast(count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') % 6 as integer) as a, cast(count(*) filter (l_returnflag = 'A') % 6 as integer) as b, cast(count(*) filter (l_returnflag = 'N') % 6 as integer) as c, cast(count(*) % 6 as integer) as d from lineitem group by 1),
x as (select *, unnest(range(greatest(0, a + b + a + c - a - b - c - d), least(a + b, a + c) + 1)) as i from n),
p as (select *, case when a + b + c + d = 0 then 1.0 else exp(lgamma(a + c + 1) - lgamma(i + 1) - lgamma(a + c - i + 1) + lgamma(b + d + 1) - lgamma(a + b - i + 1) - lgamma(b + d - (a + b - i) + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1)) end as p from x),
h as (select g, max(p) filter (i = a) as here from p group by g)
select g, round(least(1, sum(p) filter (i <= a)), 9) as "left", round(least(1, sum(p) filter (i >= a)), 9) as "right", round(least(1, sum(p) filter (p <= here * 1.000000001)), 9) as two from p join h using (g) group by g
""")
def stat_fisher(spark, d):
    rows = Q._orders(spark, d).groupBy((F.col("l_suppkey") % 50).alias("g"))
    c = lambda x: (F.count_if(x) % 6).cast("int")
    flag = F.col("l_returnflag")
    cells = rows.agg(c((flag == "R") & (F.col("l_linestatus") == "F")).alias("a"), c(flag == "A").alias("b"), c(flag == "N").alias("c"), (F.count(F.lit(1)) % 6).cast("int").alias("d"))
    out = cells.select("g", ST.fisher(*(F.col(x) for x in "abcd")).alias("f"))
    return out.select("g", *(F.round(f"f.{x}", 9).alias(x) for x in ("left", "right", "two")))


@query("""
, v as (select l_quantity as x, count(*) filter (l_returnflag = 'R') as a, count(*) filter (l_returnflag <> 'R') as b from lineitem group by 1),
s as (select sum(a) over (order by x) / (select cast(sum(a) as double) from v) as fa, sum(b) over (order by x) / (select cast(sum(b) as double) from v) as fb from v)
select round(max(abs(fa - fb)), 9) as distance from s
""")
def stat_kolmogorov_smirnov(spark, d):
    return ST.kolmogorov_smirnov(Q._orders(spark, d), "l_quantity", F.col("l_returnflag") == "R").select(F.round("distance", 9).alias("distance"))


@query("""
, k as (select unnest(range(0, 21)) as i)
select i, round(lgamma(21) - lgamma(i + 1) - lgamma(21 - i), 9) as ways, round(0.5 * (1 - i / 20.0) ** 3 + 3 * 2.0 * (i / 20.0) * (1 - i / 20.0) ** 2 - 3 * 1.0 * (i / 20.0) ** 2 * (1 - i / 20.0) + 4.0 * (i / 20.0) ** 3, 9) as curve from k
""")
def stat_polynomials(spark, d):
    t = F.col("id") / 20
    return spark.range(21).select(F.col("id").alias("i"), F.round(ST.log_binomial(F.lit(20), F.col("id")), 9).alias("ways"), F.round(ST.bernstein([0.5, 2.0, -1.0, 4.0], t), 9).alias("curve"))


@query("""
, o as (select l_orderkey as k, l_quantity as q, l_discount as e, l_tax as t from lineitem where l_linenumber = 1)
select k, t as b10, round(q + 2 * e, 6) as s00, round(q * e + t, 6) as p00, round((2 * q + 3 - t) / (2 * q + 3), 6) as x0, round(t / (2 * q + 3), 6) as x1 from (select k, cast(q as double) as q, cast(e as double) as e, cast(t as double) as t from o)
""".replace("(2 * q + 3 - t) / (2 * q + 3)", "1.0 - t / (2 * q + 3)").replace("round(q + 2 * e, 6)", "round(q + e, 6)"))
def stat_matrices(spark, d):
    rows = Q._orders(spark, d).where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), *(F.col(c).cast("double").alias(x) for c, x in (("l_quantity", "q"), ("l_discount", "e"), ("l_tax", "t"))))
    q, e, t, one, zero = F.col("q"), F.col("e"), F.col("t"), F.lit(1.0), F.lit(0.0)
    a, b = F.array(F.array(q, one), F.array(zero, one)), F.array(F.array(e, zero), F.array(t, one))
    m = F.array(F.array(one, one), F.array(zero, 2 * q + 3))  # x0 + x1 = 1 and (2 q + 3) x1 = t
    out = rows.select("k", M.add(a, b).alias("s"), M.multiply(a, b).alias("p"), M.transpose(b)[0][1].alias("b10"), M.solve(m, F.array(one, t)).alias("x"))
    return out.select("k", "b10", F.round(F.col("s")[0][0], 6).alias("s00"), F.round(F.col("p")[0][0], 6).alias("p00"), F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[1], 6).alias("x1"))


@query("select n_regionkey || string_agg(chr(9) || n_nationkey || 'x1', '' order by n_nationkey) as value from nation group by n_regionkey union all select cast(n_nationkey as varchar) from nation where n_nationkey not in (select r_regionkey from region)")
def graph_lines(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    none = nation.select(F.col("src").alias("id")).limit(0)
    vertices, arcs = DOC.with_arcs(none, nation.limit(0), nation)
    return DOC.graph_lines(vertices, arcs)


@query("select n_regionkey as src, n_nationkey as dst from nation where n_nationkey % 2 = 1")
def graph_without_arcs(spark, d):
    arcs = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))
    return DOC.without_arcs(arcs, arcs.where("dst % 2 = 0"))


# ---- streams -----------------------------------------------------------------------------


def _streamed(spark, d, frame, mode: str):
    name, checkpoint = f"stream_{uuid.uuid4().hex}", _folder(spark, "stream")
    gone_at_end(spark, f"{checkpoint}-rows")
    streams.run_once(frame, name, mode, checkpoint)
    return spark.table(name)


def _read_stream(spark, d):
    path = _folder(spark, "reads")
    batch = reads(spark, d)
    batch.repartition(3).write.parquet(path)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"select file, {Q._SUMMARY} from r group by file")
def stream_summary(spark, d):
    return _streamed(spark, d, streams.running_summary(_read_stream(spark, d)), "complete")


@query(f"select ordinal, substr(seq, 3, 7) as seq, substr(qual, 3, 7) as qual from r where regexp_full_match(seq, '[ATCGN]+') and (({Q._X31.format('name')}) & 16777215) / 16777216.0 < 0.5")
def stream_trimmed_sample(spark, d):
    return _streamed(spark, d, streams.trimmed_sample(_read_stream(spark, d), 2, 9, 0.5), "append").select("ordinal", "seq", "qual")


@query("select distinct user_id from events")
def stream_first_seen(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", "user_id")
    path = _folder(spark, "events")
    events.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _streamed(spark, d, streams.first_seen(stream, delay="3650 days", key="user_id"), "append").select("user_id")
