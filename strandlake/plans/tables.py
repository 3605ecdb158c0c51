"""Written intermediate tables and ranks over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a temporary one in local mode,
    as in tests; on a cluster it is an error, since executors could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="shared"))
            folder = context.getCheckpointDir()
    return folder.rstrip("/")


def gone_at_end(spark: SparkSession, path: str) -> None:
    """The path is deleted when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again, so that it is computed once.  The files
    go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    gone_at_end(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with its row number, from 1, in a total order of the whole table; a column of that
    name is replaced.

    Rows are range-partitioned and numbered within partitions; the partitions' sizes, one
    number each, give the offsets.  So no task sees more than its range.
    """
    kept = [c for c in df.columns if c != name]
    mark = next(m for m in (f"_{i}" for i in range(len(kept) + 1)) if not any(c.startswith(m) for c in kept))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.select(*kept, *(k.alias(f"{mark}k{i}") for i, k in enumerate(keys)))
    columns, part = [F.col(f"{mark}k{i}") for i in range(len(keys))], f"{mark}part"
    ranged = written(named.repartitionByRange(*columns).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, at = {}, 0
    for row in sorted(sizes, key=lambda r: r[part]):
        offsets[row[part]] = at
        at += row["n"]
    if not offsets:
        return df.select(*kept).withColumn(name, F.lit(0).cast("long"))
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair)), F.col(part))
    number = F.row_number().over(Window.partitionBy(part).orderBy(*columns))
    return ranged.select(*kept, (number + offset.cast("long")).alias(name))


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """df with metrics taken while it is computed: its rows, unless others are named."""
    seen = Observation(name)
    return df.observe(seen, *(metrics or (F.count(F.lit(1)).alias("rows"),))), seen
