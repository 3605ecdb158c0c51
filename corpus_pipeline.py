"""A corpus pipeline: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs.  Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, jaccard, packing, pii, quality
from strandlake.llm._spark import shared_folder, stash
from strandlake.llm.queries import EXAMPLE_KEY, QUALITY_PASSING, table, tokenizer_path

#: Share of benchmark words from which a document goes; any shared window of this many words counts.
SPAN = 10


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier, fitted on docs, accepts."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model, passing=QUALITY_PASSING).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group linked by five-word n-grams at 0.8 or
    more.  Different texts of one doc_id are judged each; rows with a null doc_id all stay."""
    return jaccard.deduplicated(docs, k=5, similarity=(8, 10))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a window of SPAN words with a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), span=SPAN)
    hit = stash(found.where("n_hit > 0").select("doc_id").distinct())  # written, so that its size decides about the join
    return docs.where("doc_id is not null").join(hit, "doc_id", "left_anti").select(docs.columns).union(docs.where("doc_id is null"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by surrogates; n_chars follows the text."""
    done = pii.replace_private(docs, EXAMPLE_KEY, spans=None)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: Training, keyed surrogates and subword ids are not SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
