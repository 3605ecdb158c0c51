"""Reads as streams: the stateless operators as they are, counters in complete mode, and
windows of event time.

Trimming, filtering and hash sampling need no state and apply to a streaming frame
unchanged.  First-wins collapsing keeps its sequences as state within a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators import qc
from strandlake.operators import reads as R


def trimmed_sample(stream: DataFrame, start: int, end: int, fraction: float, seed: int = 0) -> DataFrame:
    return R.trim(R.sample_fraction(R.only_acgtn(stream), fraction, seed), start, end)


def running_summary(stream: DataFrame) -> DataFrame:
    """The quality summary by file; written in complete mode."""
    return qc.qc_summary(stream)


def running_quality_matrix(stream: DataFrame) -> DataFrame:
    return qc.quality_matrix(stream)


def windowed_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", by: str | None = None) -> DataFrame:
    """(start, end, [by], n): rows by windows of event time; later rows than ``delay`` go."""
    keys = [F.window(time, width, slide or width).alias("w"), *([F.col(by)] if by else [])]
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    counted = stream.withWatermark(time, delay).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *([by] if by else []), "n")


def first_seen(stream: DataFrame, time: str = "ts", delay: str = "1 hour", key: str = "seq") -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_once(frame: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Runs a query over all that is there now, into a table of that name for the session.

    Appended rows go to files in ``<checkpoint>-rows``, a folder that all executors share, and
    never to the driver; a later run on the same checkpoint adds to them.  Complete results,
    a row for each group, are a table in memory."""
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode != "append":
        query = writer.format("memory").queryName(name).start()
        query.awaitTermination()
        return query
    spark, rows = frame.sparkSession, f"{checkpoint}-rows"
    place = spark._jvm.org.apache.hadoop.fs.Path(rows)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)  # without rows there is no file
    query = writer.format("parquet").queryName(name).start(rows)
    query.awaitTermination()
    spark.read.schema(frame.schema).parquet(rows).createOrReplaceTempView(name)
    return query
