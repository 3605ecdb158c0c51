"""Session helpers: the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
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


def _on_files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stash(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage is cut, and a lost
    executor costs no more than the tasks it ran.  The files go when the application ends,
    or by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    files, place = _on_files(spark, path)
    files.deleteOnExit(place)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Deletes the files of stashed frames that nothing reads any more."""
    for df in stashed:
        files, place = _on_files(df.sparkSession, df.stash_path)
        files.delete(place, True)


def dealt(df: DataFrame) -> DataFrame:
    """A scan that comes in fewer partitions than there are cores, a few small files, dealt to all
    cores; a large table comes in more and stays as it is, as does what was shuffled."""
    plan = df._jdf.queryExecution()
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id's decimal text modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: Edges of which a task drops those that close a cycle.
FOREST = 250_000


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges without those between nodes that earlier edges of up to 2 FOREST nodes join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        if len(parent) > 2 * FOREST:
            parent.clear()
        keep = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            keep.append(x != y)
            parent[max(x, y)] = min(x, y)
        yield batch.filter(pa.array(keep, pa.bool_()))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, forest: bool = False) -> DataFrame:
    """(node, component) of every node of an undirected graph; component is its smallest node.

    Alternates the large-star and small-star steps, which turn each component into a star
    around its smallest node in a logarithmic number of rounds.  Every step is a grouped
    minimum, combined before the shuffle, and an equi-join, so a hub is not gathered in a
    task; each round is written to the shared folder.  Self-loops only add their node.
    With ``forest``, tasks of FOREST edges first drop those that close a cycle, in Python.
    """
    all_nodes = edges.select(F.col(u).alias("node")).union(edges.select(F.col(v).alias("node"))).distinct()
    current = stash(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a != b").distinct())
    if forest and (n := current.count()):
        last, current = current, stash(current.coalesce(-(-n // FOREST)).mapInArrow(spanning, "a long, b long"))
        discard(last)
    mark = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, current = current, stash(small.where("a != b").distinct())
        discard(last)
        now = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return all_nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
