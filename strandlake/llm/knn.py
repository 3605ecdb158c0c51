"""Exact top-k search by a Voronoi kNN join for inner products.

1. Data vectors are dealt to the cell of their nearest pivot; the pivots grow with the table.
   A cell's summary is its size and radius.  Queries are grouped by the pivot of their
   largest inner product.
2. Every query is first solved within its own group's cell.  Its k-th score there is one
   that its final neighbours surely reach.
3. For a query q and a cell of pivot c and radius r every q.x is at most q.c + |q| r.  Only where
   that reaches q's score do the two have to meet.  For each pair of a group and a cell the side
   of which less would be copied travels: the queries that reach the cell go to its blocks, or
   the vectors x of the cell that reach the group, by p.x + s|x| for a group of pivot p and
   radius s, go to the group.  Where nothing can be pruned, that is the side that is smaller.
4. At each place blocks of one side are held and the other side passes by in matrix products;
   the best of all places are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm._spark import stash
from strandlake.llm.jaccard import _merged

#: Pivots are the square root of the rows, but at most so many, from a sample of so many vectors for each.
MAX_PIVOTS, SAMPLE = 1024, 16
#: Queries, and data vectors, held at a place; and vectors that pass by a block of queries in one task.
QUERY_BLOCK, DATA_BLOCK, PASSING = 1024, 8192, 1 << 19


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, width)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    cell = gap.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where every sum stays below 2**53, else by integers."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if largest < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, exactly.

    vectors and queries are (vec_id, vector array<long>); a query is not compared with rows
    of its own vec_id, and only with vectors of its own length.  Ties go to the smaller
    vec_id; repeated data rows count each, repeated query rows are asked once, and different vectors of one
    query id are one query that takes the best of all; fewer than k candidates give fewer rows.  Rows with a
    null vec_id or vector, or a null component, take no part; other columns are ignored;
    empty tables give no rows.
    """
    clean = lambda df: df.where("vec_id is not null and vector is not null and size(vector) > 0").where(~F.exists("vector", lambda x: x.isNull())).select("vec_id", "vector")
    vectors, queries = stash(clean(vectors)), stash(clean(queries).distinct())
    widths = sorted(r[0] for r in queries.select(F.size("vector")).distinct().collect())
    out = None
    for width in widths:
        part = _top_k_of(vectors.where(F.size("vector") == width), queries.where(F.size("vector") == width), k, width)
        out = part if out is None else out.union(part)
    if out is None:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    return out


def _top_k_of(vectors: DataFrame, queries: DataFrame, k: int, width: int) -> DataFrame:
    found = _search(vectors, queries, k, width)[0]
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


KINDS = "vec_id long, vector array<long>"


def _small(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``rows`` at a time and never none."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _added(df: DataFrame, work: Callable[[np.ndarray, int], dict[str, pa.Array]], kinds: str, width: int) -> DataFrame:
    """Columns of df and those that work makes of a matrix of vectors and its first row's number in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in _small(batches):
            made = work(_matrix(batch.column(1), width).astype(np.float64), rows)
            rows += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{old}, {kinds}")


def _search(vectors: DataFrame, queries: DataFrame, k: int, width: int) -> tuple[DataFrame, dict[str, int]]:
    """((query_id, vec_id, score) with the k best of each query among them, copies sent)."""
    n = vectors.count()
    count = min(MAX_PIVOTS, max(1, int(np.sqrt(n))))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE * count).toArrow()
    if not sample.num_rows:
        return queries.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).where("false"), {}
    pivots = _choose_pivots(_matrix(sample["vector"], width).astype(np.float64), count)

    def placed(x: np.ndarray, begin: int) -> dict[str, pa.Array]:
        cell, gap = _nearest(x, pivots)
        return {"cell": pa.array(cell.astype(np.int32)), "gap": pa.array(gap), "turn": pa.array(np.arange(begin, begin + len(x)))}

    data = stash(_added(vectors, placed, "cell int, gap double, turn long", width))
    cells = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()  # at most one a pivot
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in cells:
        size[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    blocks = -(-size // DATA_BLOCK)

    def grouped(x: np.ndarray, _: int) -> dict[str, pa.Array]:
        home = np.where(size > 0, x @ pivots.T, -np.inf).argmax(1)
        return {"cell": pa.array(home.astype(np.int32)), "gap": pa.array(np.sqrt(((x - pivots[home]) ** 2).sum(1)))}

    asked = stash(_added(queries, grouped, "cell int, gap double", width))
    groups = {r["cell"]: r for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()}
    blocks_of = F.element_at(F.array(*(F.lit(int(b)) for b in blocks)), F.col("cell") + 1)
    every = F.explode(F.sequence(F.lit(0), blocks_of - 1)).alias("block")
    block = F.pmod(F.xxhash64("vec_id", "turn", "gap"), blocks_of).cast("int").alias("block")
    held = data.select("cell", block, F.lit(0).alias("kind"), *KEPT)
    at_home = held.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")
    sent = {"home": int(sum(g["n"] * blocks[c] for c, g in groups.items()))}
    first = _solved(at_home.union(asked.select("cell", every, F.lit(1).alias("kind"), *KEPT)), k, width, False, int(blocks.sum()))
    first = stash(_ranked(first, k).drop("rank"))
    bar = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("met"))
    bar = bar.select(F.col("query_id").alias("vec_id"), F.when(F.col("met") >= k, F.col("least")).cast("double").alias("bar"))
    asked = stash(asked.join(bar, "vec_id", "left").select("vec_id", "vector", "cell", "gap", F.coalesce("bar", F.lit(float("-inf"))).alias("bar")))

    def reached(batch: pa.RecordBatch) -> np.ndarray:
        """Which cells each query has to meet."""
        x = _matrix(batch.column(1), width).astype(np.float64)
        reach = x @ pivots.T + np.sqrt((x * x).sum(1))[:, None] * radius
        bars = batch.column(4).to_numpy()[:, None]
        meets = (reach + 1e-6 * (1 + np.abs(reach)) >= bars) & (size > 0)
        meets[np.arange(len(x)), batch.column(2).to_numpy()] = False
        return meets

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(pivots), len(pivots)), np.int64)
        for batch in _small(batches):
            np.add.at(sums, batch.column(2).to_numpy(), reached(batch))
        g, c = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(sums[g, c])], ["g", "c", "n"])

    pairs = asked.mapInArrow(counted, "g int, c int, n long").groupBy("g", "c").agg(F.sum("n").alias("n")).toArrow()  # at most one a pair of pivots
    g, c, met = (pairs[x].to_numpy() for x in ("g", "c", "n"))
    group_blocks = np.zeros(len(pivots), np.int64)
    for cell, r in groups.items():
        group_blocks[cell] = -(-r["n"] // QUERY_BLOCK)
    to_cells = met * blocks[c] <= size[c] * group_blocks[g]
    travels = np.zeros((len(pivots), len(pivots)), bool)
    travels[g[to_cells], c[to_cells]] = True
    visits = [np.sort(g[~to_cells][c[~to_cells] == i]) for i in range(len(pivots))]  # groups that a cell's vectors go to
    sent |= {"queries": int((met * blocks[c])[to_cells].sum()), "data at most": int((size[c] * group_blocks[g])[~to_cells].sum())}

    def travelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            row, cell = np.nonzero(reached(batch) & travels[batch.column(2).to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(batch.column(i).take(pa.array(row)) for i in range(2))], ["cell", *KEPT])

    goes = asked.mapInArrow(travelling, f"cell int, {KINDS}").select("cell", every, F.lit(1).alias("kind"), *KEPT)
    found = first
    if to_cells.any():
        used = vectors.sparkSession.createDataFrame([(int(x),) for x in np.unique(c[to_cells])], "cell int")
        found = found.union(_solved(held.join(F.broadcast(used), "cell", "left_semi").union(goes), k, width, False, int(blocks.sum())))
    if not to_cells.all():
        least = {r["cell"]: r["least"] for r in asked.groupBy("cell").agg(F.min("bar").alias("least")).collect()}
        spread = np.array([groups[i]["radius"] if i in groups else 0.0 for i in range(len(pivots))])
        bars = np.array([least.get(i, np.inf) for i in range(len(pivots))])
        passing = np.bincount(g[~to_cells], size[c[~to_cells]], len(pivots))
        turns = np.maximum(1, -(-passing // PASSING)).astype(np.int64)

        def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _small(batches):
                x = _matrix(batch.column(1), width).astype(np.float64)
                norm, cell = np.sqrt((x * x).sum(1)), batch.column(2).to_numpy()
                for i in np.unique(cell):
                    mine = np.flatnonzero(cell == i)
                    if not len(visits[i]):
                        continue
                    reach = x[mine] @ pivots[visits[i]].T + norm[mine, None] * spread[visits[i]]
                    row, group = np.nonzero(reach + 1e-6 * (1 + np.abs(reach)) >= bars[visits[i]])
                    rows, group = pa.array(mine[row]), visits[i][group]
                    turn = batch.column(4).take(rows).to_numpy() % turns[group]
                    yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(turn.astype(np.int32)), *(batch.column(j).take(rows) for j in range(2))], ["cell", "turn", *KEPT])

        parts = F.element_at(F.array(*(F.lit(int(max(b, 1))) for b in group_blocks)), F.col("cell") + 1)
        times = F.element_at(F.array(*(F.lit(int(b)) for b in turns)), F.col("cell") + 1)
        place = lambda part, turn: (part * times + turn).cast("int").alias("block")
        sits = asked.where(F.col("cell").isin([int(x) for x in np.unique(g[~to_cells])])).withColumn("turn", F.explode(F.sequence(F.lit(0), times - 1)))
        sits = sits.select("cell", place(F.pmod(F.xxhash64("vec_id"), parts), F.col("turn")), F.lit(0).alias("kind"), *KEPT)
        come = data.mapInArrow(visiting, f"cell int, turn int, {KINDS}").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        come = come.select("cell", place(F.col("part"), F.col("turn")), F.lit(1).alias("kind"), *KEPT)
        found = found.union(_solved(sits.union(come), k, width, True, int((group_blocks * turns).sum())))
    return found, sent


KEPT = ("vec_id", "vector")


def _solved(rows: DataFrame, k: int, width: int, queries_held: bool, places: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query at each place (cell, block) of rows (cell, block,
    kind, vec_id, vector), those of kind 0 held and those of kind 1 passing by, or the reverse
    of what is asked with ``queries_held``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(parts, min(places, 20_000)), "cell", "block").sortWithinPartitions("cell", "block", "kind")

    def pairs(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _best(_products(q, x), np.broadcast_to(ids, (len(q), len(ids))), own, k)

    def result(best: tuple[np.ndarray, np.ndarray], own: np.ndarray) -> pa.RecordBatch:
        row, col = np.nonzero(best[1] != own[:, None])
        return pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(best[1][row, col]), pa.array(best[0][row, col])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, best = None, [], None
        x = ids = None

        def close() -> Iterator[pa.RecordBatch]:
            if queries_held and best is not None:
                yield result(best, ids)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, block, kind, vec = (batch.column(i).to_numpy() for i in range(4))
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                if (cell[i], block[i]) != key:
                    yield from close()
                    key, held, best, x = (cell[i], block[i]), [], None, None
                part = _matrix(batch.column(4).slice(i, j - i), width), vec[i:j]
                if kind[i] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if x is None:
                    x, ids = np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held])
                if queries_held:
                    for a in range(0, j - i, DATA_BLOCK):
                        new = pairs(x, ids, part[0][a : a + DATA_BLOCK], part[1][a : a + DATA_BLOCK])
                        best = new if best is None else _best(np.concatenate([best[0], new[0]], 1), np.concatenate([best[1], new[1]], 1), ids, k)
                else:
                    for a in range(0, j - i, QUERY_BLOCK):
                        own = part[1][a : a + QUERY_BLOCK]
                        yield result(pairs(part[0][a : a + QUERY_BLOCK], own, x, ids), own)
        yield from close()

    return rows.mapInArrow(_merged(run), "query_id long, vec_id long, score long")


def _best(s: np.ndarray, i: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of every row, ties to the smaller id; own ids come last."""
    low = np.iinfo(np.int64).min
    s = np.where(i == own[:, None], low, s)
    if s.shape[1] > 4 * k:
        bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        width = int((s >= bar[:, None]).sum(1).max())
        if width < s.shape[1]:
            keep = np.argsort(s < bar[:, None], axis=1, kind="stable")[:, :width]
            s, i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
    order = np.lexsort((i, ~s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` centres of the sample, by a few rounds of k-means."""
    distinct = np.unique(sample, axis=0)
    count = min(count, len(distinct))
    rng = np.random.default_rng(3)
    centres = distinct[rng.choice(len(distinct), count, replace=False)]
    for _ in range(8):
        cell, _ = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        sizes = np.bincount(cell, minlength=count)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres
