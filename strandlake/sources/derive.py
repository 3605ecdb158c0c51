"""Reads and alignments derived from the star-schema tables, for queries and benchmarks.

Each derivation is also given as text of DuckDB's SQL, so that queries on top of it can be
checked there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions of derived alignments lie below this.
SPAN = 200_000

READS_SQL = """
SELECT event_id AS ordinal,
       '@R' || cast(event_id AS varchar(20)) || ' 1:N:0' AS name,
       substr(translate(md5(cast(user_id % 40 AS varchar(20)) || event_type), '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, cast(20 + user_id % 3 AS int)) AS seq,
       substr(translate(md5(cast(event_id AS varchar(20))), '0123456789abcdef', '###///777<<<BBFF'), 1, cast(20 + user_id % 3 AS int)) AS qual,
       'f' || cast(event_id % 3 AS varchar(5)) AS file
FROM events
"""

#: Mates: of every read but each seventh, in the same order.
MATES_SQL = f"""
SELECT ordinal, replace(name, ' 1:', ' 2:') AS name, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq, reverse(qual) AS qual, file
FROM ({READS_SQL}) r WHERE ordinal % 7 <> 3
"""

_ALIGNED = f"""
SELECT l_orderkey * 8 + l_linenumber AS ordinal, 'q' || cast(l_orderkey AS varchar(20)) AS qname,
       cast(CASE l_orderkey % 16 WHEN 0 THEN 4 WHEN 1 THEN 256 WHEN 2 THEN 512 WHEN 3 THEN 1024 WHEN 4 THEN 16 ELSE 0 END AS int) AS flag,
       cast(l_suppkey % 3 AS int) AS tid, 'chr' || cast(l_suppkey % 3 AS varchar(5)) AS chrom,
       cast((l_orderkey * 7919 + l_partkey * 31) % {SPAN} AS bigint) AS pos,
       cast(l_linenumber AS int) AS ln, cast(l_linenumber % 4 AS int) AS form,
       translate(md5(cast(l_orderkey AS varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq
FROM lineitem
"""
ALIGNMENTS_SQL = f"""
SELECT ordinal, qname, flag, tid, chrom, pos, seq, cast(length(seq) AS int) AS l_qseq,
       CASE form WHEN 0 THEN [{{'op': 0, 'len': 10 + ln}}]
                 WHEN 1 THEN [{{'op': 4, 'len': 3}}, {{'op': 0, 'len': 5 + ln}}, {{'op': 1, 'len': 2}}, {{'op': 0, 'len': 6}}]
                 WHEN 2 THEN [{{'op': 0, 'len': 4 + ln}}, {{'op': 2, 'len': 3}}, {{'op': 0, 'len': 7}}]
                 ELSE [{{'op': 0, 'len': 6}}, {{'op': 3, 'len': 20}}, {{'op': 7, 'len': 5 + ln}}, {{'op': 5, 'len': 1}}] END AS cigar
FROM ({_ALIGNED}) a
"""
#: Aligned blocks [s, e) by arithmetic, apart from the walk over the CIGAR.
BLOCKS_SQL = f"""
SELECT ordinal, flag, chrom, unnest([pos + b[1] for b in bs]) AS s, unnest([pos + b[2] for b in bs]) AS e
FROM (SELECT *, CASE form WHEN 0 THEN [[0, 10 + ln]] WHEN 1 THEN [[0, 5 + ln], [5 + ln, 11 + ln]]
                     WHEN 2 THEN [[0, 4 + ln], [7 + ln, 14 + ln]] ELSE [[0, 6], [26, 31 + ln]] END AS bs FROM ({_ALIGNED}) a) x
"""
CONTIGS_SQL = f"SELECT cast(i AS int) AS tid, 'chr' || cast(i AS varchar(5)) AS chrom, cast({SPAN + 100} + 10 * i AS bigint) AS length FROM range(3) t(i)"


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", READS_SQL)


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", MATES_SQL)


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _view(spark, sf_dir, "lineitem", _ALIGNED)
    op = lambda code, length: F.struct(F.lit(code).alias("op"), (F.lit(length) if isinstance(length, int) else length).alias("len"))
    ln = F.col("ln")
    cigar = (
        F.when(F.col("form") == 0, F.array(op(0, ln + 10)))
        .when(F.col("form") == 1, F.array(op(4, 3), op(0, ln + 5), op(1, 2), op(0, 6)))
        .when(F.col("form") == 2, F.array(op(0, ln + 4), op(2, 3), op(0, 7)))
        .otherwise(F.array(op(0, 6), op(3, 20), op(7, ln + 5), op(5, 1)))
    )
    return a.select("ordinal", "qname", "flag", "tid", "chrom", "pos", "seq", F.length("seq").alias("l_qseq"), cigar.alias("cigar"))


def contigs(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(3).select(i.cast("int").alias("tid"), F.concat(F.lit("chr"), i.cast("string")).alias("chrom"), (F.lit(SPAN + 100) + 10 * i).alias("length"))
