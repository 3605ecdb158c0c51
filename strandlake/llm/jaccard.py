"""Jaccard self-join of documents on word n-grams by rare-first prefix filtering.

The order of n-grams is by document frequency, rarest first, ties by hash.  Two sets of
similarity t or more share an n-gram in their prefixes, the first n - ceil(t n) + 1 of
each.  The join runs in these steps:

1. Equal sets are one class, known by a 128-bit fingerprint; only the smallest doc_id of a
   class goes on, as the class's key.  Where that doc_id has several different sets, the key
   is the first half of the fingerprint instead.
2. Frequencies are counted up to CAP over packed blocks: each task sends, per bucket of
   hashes, one block of its documents' n-grams.  Of an n-gram that has reached CAP within a
   task one place a block goes to its bucket, with that weight; the others, whose
   frequency is then known, are dealt over all buckets.  n-grams of a single document
   cannot match; they only count in the lengths.
3. Documents whose prefix holds a shared n-gram are joined on it.  Pairs that fail the
   length filter, the positional filter or the suffix filter (a lower bound of the
   symmetric difference from bit signatures) are dropped.  A hot n-gram's documents are
   split into blocks, and each pair of blocks is a task's.
4. Each remaining pair is verified once, on the whole sets of hashes, within
   components of candidates; large components are split into pairs of blocks as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm._spark import connected_components, dealt, spanning, stash
from strandlake.llm._text import mix, scan, segment_sums, shingle_sets, slices

#: n-grams that a bucket of the counting step holds on average.
BUCKET = 1_500_000
#: Documents of a hot n-gram, or of a large component, in a block.
BLOCK = 1024
#: 64-bit words of a signature; frequencies count up to CAP; beginnings of prefixes compared.
SIGNATURE, CAP, HEAD = 8, 32, 8
#: Bits of the cells in which a task counts n-grams roughly.
SKETCH = 22
U64 = np.uint64


@dataclass(frozen=True)
class Threshold:
    """Similarity of at least num / den."""

    num: int
    den: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-n * self.num // self.den) + 1

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least intersection of sets of sizes a and b that are similar enough."""
        return -(-(a + b) * self.num // (self.num + self.den))


def _pack(doc: np.ndarray, size: np.ndarray, at: np.ndarray, tok: np.ndarray, freq: np.ndarray) -> bytes:
    """A block: a table of documents, and n-grams ascending with places in that table and
    weights or frequencies.

    Hashes are kept as differences, byte by byte, so that equal high bytes compress; places as well.
    """
    used, place = np.unique(at, return_inverse=True)
    steps = np.diff(tok, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T
    wide = np.uint16 if len(used) < 65536 else np.uint32
    head = np.array([len(used), len(tok)], np.int64)
    parts = [head, doc[used].astype(np.int64), size[used].astype(np.int32), np.ascontiguousarray(steps), place.astype(wide).view(np.uint8).reshape(len(tok), -1).T, freq.astype(np.uint8)]
    return zstandard.ZstdCompressor(1).compress(b"".join(p.tobytes() for p in parts))


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    docs, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    at = 16
    doc = np.frombuffer(raw, np.int64, docs, at)
    at += 8 * docs
    size = np.frombuffer(raw, np.int32, docs, at)
    at += 4 * docs
    tok = np.cumsum(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T.copy().view(U64).ravel(), dtype=U64)
    at += 8 * n
    wide = np.dtype(np.uint16 if docs < 65536 else np.uint32)
    place = np.frombuffer(raw, np.uint8, wide.itemsize * n, at).reshape(-1, n).T.copy().view(wide).ravel() if n else np.zeros(0, wide)
    at += wide.itemsize * n
    return doc, size, place, tok, np.frombuffer(raw, np.uint8, n, at)


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, set sizes, offsets, sets, fingerprints) of a batch (doc_id, text); the id of a null one means nothing."""
    values, offsets = shingle_sets(scan(batch.column(1)), k)
    doc = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
    prints = np.column_stack([segment_sums(mix(values, salt), offsets) for salt in (5, 6)]).view(np.int64)
    return doc, np.diff(offsets), offsets, values, prints


def _binary(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2): set sizes and fingerprints of whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, sizes, _, _, prints = _sets(batch, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])], ["doc_id", "n_shingles", "f1", "f2"])

    return dealt(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long")


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


BLOCKS = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])


def _blocks_of(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's n-grams.  A sketch of the task's counts says which n-grams are frequent
    by now; one that it takes for so by mistake has the same frequency everywhere all the
    same, since its bucket is told in each block."""
    met = np.zeros(1 << SKETCH, np.uint8)
    for batch in slices(batches):
        doc, sizes, offsets, values, prints = _sets(batch, k)
        if not len(values):
            continue
        order = np.lexsort((doc, prints[:, 1], prints[:, 0], sizes))
        new = np.ones(len(order), bool)
        new[1:] = (sizes[order[1:]] != sizes[order[:-1]]) | (prints[order[1:]] != prints[order[:-1]]).any(1)
        keep = np.zeros(len(order), bool)
        keep[order[new]] = True
        if batch.num_columns > 2:
            doc = np.where(batch.column(2).fill_null(False).to_numpy(zero_copy_only=False), prints[:, 0], doc)
        row = np.repeat(np.arange(len(doc)), sizes)
        mine = keep[row]
        if not mine.any():
            continue
        tok, row = values[mine], row[mine]
        order = np.argsort(tok, kind="stable")
        tok, row = tok[order], row[order]
        bucket = _bucket(tok, buckets)
        weight = np.ones(len(tok), np.uint8)
        starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        counts = np.diff(starts, append=len(tok))
        cell = (mix(tok[starts], 3) >> U64(64 - SKETCH)).astype(np.int64)
        so_far = np.minimum(met[cell] + counts, CAP)
        met[cell] = so_far
        many = so_far == CAP
        if many.any():
            weight[np.repeat(many, counts)] = 0
            weight[starts[many]] = CAP
            bucket[weight == 0] = _bucket(mix(doc.view(U64), 2)[row[weight == 0]], buckets)
            order = np.lexsort((tok, bucket))
            tok, row, bucket, weight = tok[order], row[order], bucket[order], weight[order]
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(b, _pack(doc, sizes, row[i:j], tok[i:j], weight[i:j])) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if j > i]
        yield from _binary(rows, BLOCKS)


def _hash_blocks(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Blocks of n-grams by bucket of hashes, of all documents but a task's local copies.  Rows
    for which a column ``twin`` is true go by their fingerprints instead of their doc_ids."""
    twins = ["twin"] if "twin" in docs.columns else []
    return dealt(docs.where("doc_id is not null").select("doc_id", "text", *twins)).mapInArrow(lambda x: _blocks_of(x, k, buckets), "bucket int, block binary")


def _by_bucket(blocks: DataFrame, parts: int, work: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies work to all blocks of each bucket; a task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != own and held:
                    yield from work(held)
                    held = []
                own = bucket
                held.append(block.as_buffer())
        if held:
            yield from work(held)

    return blocks.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _shared_grams(blocks: list[bytes], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of one bucket of hashes: the n-grams of two or more documents with their frequencies,
    as blocks by bucket of documents."""
    parts = [_unpack(b) for b in blocks]
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    doc = np.concatenate([p[0] for p in parts])
    size = np.concatenate([p[1] for p in parts])
    tok = np.concatenate([p[3] for p in parts])
    at = np.concatenate([p[2].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
    weight = np.concatenate([p[4] for p in parts])
    del parts
    order = np.argsort(tok, kind="stable")
    tok, at, weight = tok[order], at[order], weight[order]
    starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    counts = np.diff(starts, append=len(tok))
    freq = np.repeat(np.minimum(np.add.reduceat(weight.astype(np.int64), starts), CAP), counts)
    freq[weight == 0] = CAP
    many = freq > 1
    tok, at, freq = tok[many], at[many], freq[many]
    target = _bucket(mix(doc.view(U64)), buckets)[at]
    order = np.argsort(target, kind="stable")
    tok, at, freq, target = tok[order], at[order], freq[order], target[order]
    bounds = np.searchsorted(target, np.arange(buckets + 1))
    rows = [(b, _pack(doc, size, at[i:j], tok[i:j], freq[i:j])) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if j > i]
    yield from _binary(rows, BLOCKS)


PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("head", pa.int32()), ("lone", pa.int32()), ("cold", pa.int32()), ("grams", pa.binary())])


def _profiles(blocks: list[bytes], limit: Threshold) -> Iterator[pa.RecordBatch]:
    """Documents of one bucket whose prefix holds a shared n-gram: their size, how many shared
    n-grams the prefix holds, how many others there are, how many of the shared are below
    CAP, and the shared n-grams in order."""
    parts = [_unpack(b) for b in blocks]
    doc = np.concatenate([p[0][p[2]] for p in parts])
    size = np.concatenate([p[1][p[2]] for p in parts]).astype(np.int64)
    tok = np.concatenate([p[3] for p in parts])
    freq = np.concatenate([p[4] for p in parts])
    del parts
    order = np.lexsort((tok, freq, doc))
    again = np.zeros(len(order), bool)  # n-grams of a row repeated in another task
    again[1:] = (doc[order[1:]] == doc[order[:-1]]) & (tok[order[1:]] == tok[order[:-1]])
    order = order[~again]
    doc, size, tok, freq = doc[order], size[order], tok[order], freq[order]
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    counts = np.diff(starts, append=len(doc))
    n = size[starts]
    head = np.minimum(limit.prefix(n) - (n - counts), counts)
    cold = np.add.reduceat((freq < CAP).astype(np.int64), starts)
    rows = [(int(doc[i]), int(m), int(h), int(m - c), int(b), tok[i : i + c].tobytes()) for i, c, m, h, b in zip(starts, counts, n, head, cold, strict=True) if h > 0]
    yield from _binary(rows, PROFILE)


ENTRY = "gram long, doc_id long, n int, place int, lone int, hot boolean, heads binary, mark binary"


def _signatures(grams: np.ndarray) -> bytes:
    """Bits of a signature are the parities of n-grams hashed to them, so that the bits in
    which two signatures differ are at most the n-grams in which two sets differ."""
    bit = (mix(grams, 9) & U64(SIGNATURE * 64 - 1)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=SIGNATURE * 64).astype(np.uint8) & 1).tobytes()


def _entries(profiles: DataFrame) -> DataFrame:
    """A row for every shared n-gram in a prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, n, head, lone, cold, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                grams = np.frombuffer(raw, U64)
                mark, heads = _signatures(grams), grams[: min(head, HEAD)].tobytes()
                for at in range(0, head, 4096):
                    part = grams[at : min(head, at + 4096)].view(np.int64)
                    m = len(part)
                    fixed = [pa.array([x] * m, t) for x, t in ((doc, pa.int64()), (n, pa.int32()))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part), *fixed, pa.array(np.arange(at, at + m, dtype=np.int32)), pa.array([lone] * m, pa.int32()), pa.array(np.arange(at, at + m) >= cold), pa.array([heads[: 8 * p] for p in range(at, at + m)], pa.binary()), pa.array([mark] * m, pa.binary())],
                        ["gram", "doc_id", "n", "place", "lone", "hot", "heads", "mark"],
                    )

    return profiles.select("doc_id", "n", "head", "lone", "cold", "grams").mapInArrow(_merged(run), ENTRY)


def _merged(run: Callable) -> Callable:
    """The same rows in batches of 2,000 or more, for work that yields small ones."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in run(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return wrapped


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns, of rows sorted by these."""
    held: list[pa.RecordBatch] = []
    own = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cut = np.zeros(n, bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        edges = [0, *np.flatnonzero(cut).tolist(), n]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            key = first if i == 0 else tuple(c[i] for c in cols)
            if held and key != own:
                yield pa.Table.from_batches(held)
                held = []
            own = key
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _spread(rows: DataFrame, size: DataFrame, key: str, parts: int | None) -> DataFrame:
    """Rows with (key, i, j): a group of more than BLOCK rows is dealt into blocks, and each
    row goes to all pairs of blocks that hold its own, with its block as ``own``."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.join(size.select(key, blocks.alias("blocks")), key)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    rows = rows.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *(c for c in rows.columns if c not in (key, "blocks", "other")))
    return rows.repartition(parts, key, "i", "j") if parts else rows


def _candidates(entries: DataFrame, limit: Threshold, parts: int) -> DataFrame:
    """(a, others): pairs that share an n-gram of their prefixes and pass the filters, a row
    for each n-gram and document, so that rows do not grow with the pairs.

    An n-gram below CAP has fewer documents than a block; only others are counted."""
    hot = entries.where("hot").drop("hot")
    size = hot.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    none = F.lit(0)
    cold = entries.where("not hot").drop("hot").select("gram", none.alias("i"), none.alias("j"), *(c for c in hot.columns if c != "gram"), none.alias("own"))
    rows = cold.unionByName(_spread(hot, size, "gram", None)).repartition(parts, "gram", "i", "j").sortWithinPartitions("gram", "i", "j", "n", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            g = {c: group.column(c).to_numpy() for c in ("doc_id", "n", "place", "lone", "own")}
            m = len(g["n"])
            if m < 2:
                continue
            n, place, doc, lone = (g[c].astype(np.int64) for c in ("n", "place", "doc_id", "lone"))
            within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            marks = np.frombuffer(b"".join(group.column("mark").to_pylist()), U64).reshape(m, SIGNATURE)
            heads = np.zeros((m, HEAD), U64)
            for x, raw in enumerate(group.column("heads").to_pylist()):
                part = np.frombuffer(raw, U64)[: place[x]]
                heads[x, : len(part)] = part
            left, right = [], []
            for x in range(m - 1):
                last = int(np.searchsorted(n, n[x] * limit.den // limit.num, "right"))  # length filter
                y = np.arange(x + 1, last)
                if not within:
                    y = y[g["own"][y] != g["own"][x]]
                if not len(y):
                    continue
                least = limit.overlap(n[x], n[y])
                y = y[1 + np.minimum(n[x] - lone[x] - place[x], n[y] - lone[y] - place[y]) - 1 >= least]  # positional filter
                apart = np.bitwise_count(marks[y] ^ marks[x]).sum(1, dtype=np.int64) + lone[x] + lone[y]
                y = y[apart <= n[x] + n[y] - 2 * limit.overlap(n[x], n[y])]  # suffix filter
                if len(y) and place[x]:  # a pair belongs to the first n-gram that it shares
                    mine = heads[x][heads[x] > 0]
                    y = y[~np.isin(heads[y], mine).any(1)]
                if len(y):
                    left.append(int(doc[x]))
                    right.append(doc[y])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.list_(pa.int64()))], ["a", "others"])

    return rows.mapInArrow(_merged(run), "a long, others array<long>")


def _forest(pairs: DataFrame) -> DataFrame:
    """(a, b): edges that join what the pairs (a, others) join, those of a task's without cycles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
            yield from spanning(iter([pa.RecordBatch.from_arrays([pa.array(a), batch.column(1).flatten()], ["a", "b"])]))

    return pairs.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, profiles: DataFrame, limit: Threshold, parts: int) -> DataFrame:
    """(a, root, degree, links) of the documents of similar pairs: links are those to larger
    ids, root the smallest id that a task's links reach, degree counts a task's links."""
    part = stash(connected_components(_forest(pairs), "a", "b", forest=True))
    size = part.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    docs = profiles.join(part.withColumnRenamed("node", "doc_id"), "doc_id").select("component", "doc_id", "n", "grams")
    none = F.lit(None).cast("array<bigint>")
    docs = _spread(docs, size, "component", None).select("component", "i", "j", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.col("n").cast("long").alias("n"), "grams", none.alias("others"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = lambda c: F.pmod(F.xxhash64(c, F.lit(17)), F.col("blocks")).cast("int")
    links = pairs.join(part.withColumnRenamed("node", "a"), "a").join(size.select("component", blocks.alias("blocks")), "component")
    links = links.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("others", F.filter("others", lambda b: own(b) == F.col("k"))).where("size(others) > 0")
    mine = own(F.col("a"))
    links = links.select("component", F.least(mine, "k").alias("i"), F.greatest(mine, "k").alias("j"), F.lit(1).alias("kind"), "a", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("grams"), "others")
    rows = docs.unionByName(links).repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "kind", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            kind, a, n_of = (group.column(c).to_numpy() for c in ("kind", "a", "n"))
            docs = int((kind == 0).sum())
            if docs in (0, len(kind)):
                continue
            ids, first = np.unique(a[:docs], return_index=True)
            raw = group.column("grams").to_pylist()
            sets = [np.sort(np.frombuffer(raw[i], U64)) for i in first]
            n = n_of[first].astype(np.int64)
            others = group.column("others").combine_chunks()
            each = others.slice(docs)
            x = np.repeat(a[docs:], pa.compute.list_value_length(each).to_numpy(zero_copy_only=False).astype(np.int64))
            x, y = np.searchsorted(ids, x), np.searchsorted(ids, each.flatten().to_numpy())
            met = np.unique(np.minimum(x, y)[x != y] * len(ids) + np.maximum(x, y)[x != y])
            left, right = met // len(ids), met % len(ids)
            shared = _intersections(sets, left, right)
            linked = shared * limit.den >= limit.num * (n[left] + n[right] - shared)
            if linked.any():
                yield _links(ids, n, left[linked], right[linked], shared[linked])

    return rows.mapInArrow(_merged(run), "a long, root long, degree long, links array<struct<b:bigint,shared:bigint,size_a:bigint,size_b:bigint>>")


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of intersections of pairs of sorted sets; left ascends.  The sets that one set meets
    are looked up in it together, VALUES at a time."""
    out = np.zeros(len(left), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else []
    for i, j in zip(starts, [*starts[1:], len(left)], strict=True):
        own = sets[left[i]]
        while i < j:
            part, size, k = [], 0, i
            while k < j and (size < VALUES or k == i):
                part.append(sets[right[k]])
                size += len(part[-1])
                k += 1
            flat = np.concatenate(part)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            ends = np.cumsum([len(p) for p in part])
            sums = np.concatenate([[0], np.cumsum(hit)])
            out[i:k] = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
            i = k
    return out


def _links(ids: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
    """(a, root, degree, links) of the documents of links between places of ``ids``; left ascends."""
    degree = np.bincount(np.concatenate([left, right]), minlength=len(ids))
    root, last = np.arange(len(ids)), None
    while last is None or (root != last).any():
        last = root.copy()
        np.minimum.at(root, left, last[right])
        np.minimum.at(root, right, last[left])
        root = root[root]
    keep = np.flatnonzero(degree)
    at = np.concatenate([np.searchsorted(left, keep), [len(left)]])
    parts = [pa.array(v) for v in (ids[right], shared, n[left], n[right])]
    links = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(parts, ["b", "shared", "size_a", "size_b"]))
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(ids[root[keep]]), pa.array(degree[keep]), links], schema=LINK)


#: Hashes of sets looked up at a time.
VALUES = 1 << 21
LINK = pa.schema([*((c, pa.int64()) for c in ("a", "root", "degree")), ("links", pa.list_(pa.struct([(c, pa.int64()) for c in ("b", "shared", "size_a", "size_b")])))])


@dataclass(frozen=True)
class Joined:
    """classes: (doc_id, n_shingles, class_id, key), a row per document; class_id is the smallest
    doc_id of equal sets, or null for a document without words or with a null id.
    linked: (a, root, degree, links) of the classes with links, as _verified gives them, by key.
    kinds: (n_shingles, f1, f2, class_id, key) of the classes, with their sets' fingerprints.
    again: (doc_id, twin) of ids of several rows, twin where their sets differ.
    several: whether a class's key may differ from its class_id."""

    classes: DataFrame
    linked: DataFrame
    kinds: DataFrame
    again: DataFrame
    several: bool = False

    @property
    def keys(self) -> DataFrame | None:
        return self.kinds.select("key", "class_id") if self.several else None

    @property
    def links(self) -> DataFrame:
        """(a, b, shared, size_a, size_b), the similar pairs of different classes."""
        found = self.linked.select("a", F.inline("links"))
        if self.keys is None:
            return found
        for c in ("a", "b"):
            found = found.withColumnRenamed(c, "key").join(self.keys.withColumnRenamed("class_id", c), "key").drop("key")
        swap = lambda x, y: F.when(F.col("a") <= F.col("b"), F.col(x)).otherwise(F.col(y))
        return found.select(swap("a", "b").alias("a"), swap("b", "a").alias("b"), "shared", swap("size_a", "size_b").alias("size_a"), swap("size_b", "size_a").alias("size_b"))

    def components(self) -> DataFrame:
        """classes with component_id, the smallest doc_id reachable by links, and n_links,
        the class's links to other classes.  A document linked with nothing is its own."""
        degree = self.linked.groupBy(F.col("a").alias("key")).agg(F.sum("degree").alias("n_links"))
        parts = connected_components(self.linked.select("a", "root"), "a", "root", forest=True).select(F.col("node").alias("key"), "component")
        if self.keys is not None:
            parts = stash(parts)
            least = parts.join(self.keys, "key").groupBy("component").agg(F.min("class_id").alias("least"))
            parts = parts.join(least, "component").select("key", F.col("least").alias("component"))
        return self.classes.join(parts.join(degree, "key"), "key", "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
        )


    def representatives(self) -> DataFrame:
        """(doc_id, n_shingles, f1, f2): of each group of linked classes the one with the
        smallest doc_id, and of several of that id the one with the smallest fingerprint."""
        parts = connected_components(self.linked.select("a", "root"), "a", "root", forest=True).select(F.col("node").alias("key"), "component")
        grouped = self.kinds.join(parts, "key", "left").groupBy(F.coalesce("component", "key").alias("group"))
        return grouped.agg(F.min(F.struct(F.col("class_id").alias("doc_id"), "n_shingles", "f1", "f2")).alias("r")).select("r.*")


def deduplicated(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """docs (doc_id, text, ...) with one row of each group of linked texts, that with the smallest
    doc_id.  Rows repeated under one doc_id are told apart by their sets of n-grams: of equal
    sets one row stays, different ones are judged each.  Of rows without words one for each
    doc_id stays; rows with a null doc_id all stay."""
    joined = jaccard_join(docs, k, similarity)
    best = stash(joined.representatives())
    named = docs.where("doc_id is not null")
    none = joined.classes.where("n_shingles = 0 and doc_id is not null").select("doc_id")
    kept = named.join(best.select("doc_id").union(none), "doc_id", "left_semi")
    if not joined.again.isEmpty():
        same = [F.col(f"r.{a}") == F.col(f"b.{b}") for a, b in (("doc_id", "doc_id"), ("_n", "n_shingles"), ("_f1", "f1"), ("_f2", "f2"))]
        rows = _with_prints(named.join(joined.again, "doc_id", "left_semi").select(docs.columns), k)
        of_group = rows.alias("r").join(best.alias("b"), same, "left_semi").union(rows.where("_n = 0"))
        kept = kept.join(joined.again, "doc_id", "left_anti").select(docs.columns).union(of_group.dropDuplicates(["doc_id", "_n", "_f1", "_f2"]).select(docs.columns))
    return kept.select(docs.columns).union(docs.where("doc_id is null"))


def _with_prints(docs: DataFrame, k: int) -> DataFrame:
    """docs with _n, _f1 and _f2, the sizes and fingerprints of their sets."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_n", "_f1", "_f2"))])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, sizes, _, _, prints = _sets(pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"]), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1])], [*batch.schema.names, "_n", "_f1", "_f2"])

    return docs.mapInArrow(run, schema)


def jaccard_join(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (8, 10)) -> Joined:
    """Links documents (doc_id, text) whose sets of k-word n-grams are similar enough.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer than
    k words has its whole sequence as one n-gram; a null, empty or blank text has none and
    links with nothing, as does a row with a null doc_id.  Rows repeated under one doc_id
    keep a row each; where their sets differ, each is linked by its own set.  Other columns are ignored; an empty table gives no rows.
    """
    limit = Threshold(*similarity)
    seen = stash(fingerprints(docs, k))
    known = seen.where("doc_id is not null and n_shingles > 0")
    kinds = known.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("class_id"))
    prints = ("n_shingles", "f1", "f2")
    sets = seen.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), *(f(c).alias(f"{c}_{f.__name__}") for c in prints for f in (F.min, F.max)))
    differ = " or ".join(f"{c}_min <> {c}_max" for c in prints)
    again = stash(sets.where("rows > 1").select("doc_id", F.expr(differ).alias("twin")))
    twins = again.where("twin")
    several = not twins.isEmpty()
    key = F.col("class_id")
    if several:
        kinds = kinds.join(twins.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
        docs = docs.where("doc_id is not null").select("doc_id", "text").join(twins, "doc_id", "left")
        key = F.when(F.col("twin"), F.col("f1")).otherwise(key)
    kinds = stash(kinds.select("n_shingles", "f1", "f2", "class_id", key.alias("key")))
    same = ["n_shingles", "f1", "f2"]
    mine = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    classes = seen.join(kinds, same, "left").select("doc_id", "n_shingles", mine("class_id"), mine("key"))
    total = seen.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(buckets, 20_000))
    blocks = _hash_blocks(docs, k, buckets)
    shared = _by_bucket(blocks, min(parts, buckets), lambda b: _shared_grams(b, buckets), "bucket int, block binary")
    profiles = _by_bucket(shared, min(parts, buckets), lambda b: _profiles(b, limit), "doc_id long, n int, head int, lone int, cold int, grams binary")
    profiles = stash(profiles.join(kinds.select(F.col("key").alias("doc_id")), "doc_id", "left_semi"))
    pairs = stash(_candidates(stash(_entries(profiles)), limit, parts))
    return Joined(classes, stash(_verified(pairs, profiles, limit, parts)), kinds, again, several)
