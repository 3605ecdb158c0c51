"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are [0-9a-z] and everything non-ASCII, A-Z lower-cased.  The fingerprints of a text
are the minimum hashes of its k-grams in every window of ``span - k + 1`` consecutive
k-grams, so two texts that share ``span`` words share a fingerprint.  Documents are joined
with the benchmark on fingerprints alone; each hit is then extended to the whole windows of
``span`` item words around it, whose words are compared, so hashing decides nothing.
Items shorter than ``span`` words are one window, met by grams of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._spark import stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def _shifted(a: Column, by: int, op) -> Column:
    """op(a[i], a[i + by]) for every i at which both exist."""
    left = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), left), F.slice(a, F.lit(by + 1), left), op)


def _steps(columns: DataFrame, source: str, width: int, op, name: str) -> tuple[DataFrame, str]:
    """Adds columns that combine ever wider runs of an array; returns the one of ``width``."""
    reach, at = 1, source
    while reach < width:
        by = min(reach, width - reach)
        columns = columns.withColumn(f"{name}{reach + by}", _shifted(F.col(at), by, op))
        reach, at = reach + by, f"{name}{reach + by}"
    return columns, at


def _with_grams(rows: DataFrame, words: Column, lengths: list[int]) -> DataFrame:
    """Adds g<L>, the hashes of the L-grams of the words, for every length."""
    rows = rows.withColumn("g1", F.transform(words, lambda x: F.xxhash64(F.lower(x))))  # word by word, so that equal words hash equally
    for length in lengths:
        rows, at = _steps(rows, "g1", length, lambda x, y: F.xxhash64(x, y), f"g{length}_")
        if at != f"g{length}":
            rows = rows.withColumn(f"g{length}", F.col(at))
    return rows


def _salted(a: Column, length: int) -> Column:
    return F.transform(a, lambda x: F.xxhash64(x, F.lit(length)))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 7) -> DataFrame:
    """(doc_id, n_words, n_hit, items, hits) of docs (doc_id, text) against benchmark (item_id, text).

    n_hit counts the words inside any occurrence of an item's window, items is the sorted
    array of item ids with occurring windows, hits the array of struct<at, length> of those
    occurrences (first word from 0).  A null or empty text has no words; items without
    words are ignored; equal items are all named; repeated rows keep a row each, also under
    one doc_id; other columns are ignored; with an empty benchmark nothing is hit.  A very long
    text is one row throughout, and of it only grams that a benchmark item has leave the scan.
    """
    w = span - k + 1
    items = benchmark.select("item_id", words_of(F.translate("text", UPPER, LOWER)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("n", F.size("words"))
    short = sorted(r[0] for r in items.where(F.col("n") < span).select("n").distinct().collect())  # below span, so a few numbers

    def windows_of(rows: DataFrame, starts: Column, length: int) -> DataFrame:
        """A row for every window of an item that holds the gram at p."""
        rows = rows.withColumn("s", F.explode(starts))
        win = F.array_join(F.slice("words", F.col("s") + 1, F.lit(length)), " ")
        return rows.select("fp", (F.col("p") - F.col("s")).alias("delta"), F.lit(length).alias("length"), "item_id", win.alias("win"))

    grams = _with_grams(items.where(F.col("n") >= span), F.col("words"), [k])
    grams, low = _steps(grams, f"g{k}", w, lambda x, y: F.least(x, y), "m")
    grams = grams.withColumn("chosen", F.array_distinct(low)).select("item_id", "words", "n", "chosen", F.posexplode(f"g{k}").alias("p", "fp"))
    grams = grams.where(F.array_contains("chosen", F.col("fp")))
    parts = windows_of(grams, F.sequence(F.greatest(F.col("p") - (span - k), F.lit(0)), F.least(F.col("p"), F.col("n") - span)), span)
    for length in short:
        whole = _with_grams(items.where(F.col("n") == length), F.col("words"), [length])
        whole = whole.select("item_id", "words", F.lit(0).alias("p"), F.explode(_salted(F.col(f"g{length}"), length)).alias("fp"))
        parts = parts.union(windows_of(whole, F.array(F.lit(0)), length))
    windows = stash(parts.distinct())
    prints = stash(windows.select("fp").distinct()).withColumn("known", F.lit(True))

    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("twin", F.xxhash64("text"))
    scanned = docs.select("doc_id", "twin", words_of(F.col("text")).alias("words"))
    scanned = _with_grams(scanned, F.col("words"), [*short, k])
    scanned, low = _steps(scanned, f"g{k}", w, lambda x, y: F.least(x, y), "m")
    chosen = [F.array_distinct(low), *(F.array_distinct(_salted(F.col(f"g{x}"), x)) for x in short)]
    # every document also keeps a row of its own, under a key that joins with nothing and is spread
    marked = lambda fp, every: F.struct(fp.alias("fp"), F.lit(every).alias("every"))
    each = F.concat(F.array(marked(F.xxhash64("doc_id", "twin"), True)), F.transform(F.concat(*chosen), lambda x: marked(x, False)))
    met = scanned.select("doc_id", "twin", F.size("words").cast("long").alias("n_words"), F.inline(each))
    met = met.alias("m").join(prints.alias("p"), (F.col("m.fp") == F.col("p.fp")) & ~F.col("m.every"), "left").where(F.col("every") | F.col("known"))
    met = stash(met.select("doc_id", "twin", "n_words", "m.fp", "every"))

    # written, so that the size of the suspects, not of the documents, decides how the two are joined
    suspects = stash(met.where(~F.col("every")).groupBy("doc_id", "twin").agg(F.collect_set("fp").alias("fps")))
    same = (F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))) & (F.col("d.twin") == F.col("s.twin"))
    near = docs.alias("d").join(suspects.alias("s"), same).select("d.doc_id", "d.twin", "s.fps", words_of(F.translate("d.text", UPPER, LOWER)).alias("words"))
    near = _with_grams(near, F.col("words"), [*short, k])
    placed = [F.transform(f"g{k}", lambda x, i: F.struct(i.alias("p"), x.alias("fp")))]
    placed += [F.transform(_salted(F.col(f"g{x}"), x), lambda x, i: F.struct(i.alias("p"), x.alias("fp"))) for x in short]
    placed = near.select("doc_id", "twin", "fps", "words", F.inline(F.concat(*placed))).where(F.array_contains("fps", F.col("fp")))
    reach = span - k
    first = F.greatest(F.col("p") - reach, F.lit(0))
    placed = placed.select("doc_id", "twin", "p", "fp", first.alias("first"), F.slice("words", first + 1, F.lit(span + reach)).alias("around"))
    hit = placed.join(windows, "fp").withColumn("at", F.col("p") - F.col("delta"))
    hit = hit.where((F.col("at") >= F.col("first")) & (F.array_join(F.slice("around", F.greatest(F.col("at") - F.col("first"), F.lit(0)) + 1, F.col("length")), " ") == F.col("win")))
    found = hit.groupBy("doc_id", "twin").agg(
        F.collect_set(F.struct("at", "length")).alias("hits"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1))))
    found = stash(found.select("doc_id", "twin", "items", F.sort_array("hits").alias("hits"), F.size(covered).cast("long").alias("n_hit")))
    every = met.where("every").alias("d")
    same = (F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("d.twin") == F.col("f.twin"))
    return every.join(found.alias("f"), same, "left").select(
        "d.doc_id",
        "d.n_words",
        F.coalesce("f.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("f.items", F.array().cast(found.schema["items"].dataType)).alias("items"),
        F.coalesce("f.hits", F.array().cast(found.schema["hits"].dataType)).alias("hits"),
    )
