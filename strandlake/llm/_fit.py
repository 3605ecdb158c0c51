"""Shared by the classifiers: labelled training rows, features to the driver, scores to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm._spark import crc_mod, dealt
from strandlake.llm._text import slices

#: Rows held out have this remainder of crc32(doc_id as text) by FOLDS.
FOLDS, HELD_OUT = 5, 0


def held_out(column: str = "doc_id"):
    """True for held-out rows; a null id is held out."""
    return F.coalesce(crc_mod(column, FOLDS) == HELD_OUT, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out fold.

    The sample is the ids with the smallest hashes, so it is the same on every run; ids
    without a label are left out, of several labels of an id the largest counts.  The chosen
    ids are at most ``most``, which bounds what is broadcast; rows repeated under one id all
    stay here.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return dealt(docs.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id")


def vectors_of(rows: DataFrame, vectors: Callable[[pa.Array], list[bytes]]) -> DataFrame:
    """(doc_id, x, label) of training rows, x being the bytes of the text's vector; of several
    rows of an id, that whose text has the smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors(batch.column(1)), pa.binary()), batch.column(2), batch.column(3)], ["doc_id", "x", "label", "h"])

    made = rows.select("doc_id", "text", "label", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, x binary, label int, h long")
    return made.groupBy("doc_id").agg(F.min_by("x", "h").alias("x"), F.max("label").alias("label"))


def collect_vectors(vectors: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """(vector bytes, labels) of training rows, in the order of their ids."""
    got = vectors.toArrow().sort_by([("doc_id", "ascending")])
    return got["x"].to_pylist(), got["label"].to_numpy()


def add_scores(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], name: str, keep: list[str] | None = None, passing: float | None = None) -> DataFrame:
    """docs with a column of scores of their texts; ``keep`` are the columns that stay (all, but
    one named as the scores is replaced).  With ``passing``, only rows that score at least that
    stay."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index
            scores = np.asarray(score(batch.column(at("text"))), np.float64)
            out = pa.RecordBatch.from_arrays([*(batch.column(at(c)) for c in keep), pa.array(scores)], [*keep, name])
            yield out if passing is None else out.filter(pa.array(scores >= passing))

    return dealt(source).mapInArrow(run, schema)
