"""Language-model scores of texts: a causal attention model over subword ids, beside a unigram base.

A text's score is the log10 probability that the attention model gives its subword ids and
its end; nothing else enters it.  The base score is the smoothed unigram probability under the
counts of the training texts' words.

1. Words are counted in packed blocks by bucket of hashes, combined in each task first.
   Words that are at least one in HOT_WORDS of all occurrences, which are at most HOT_WORDS,
   go to all tasks.
2. The texts' subword ids are written once, a row a text, with what its frequent words give.
   Of every occurrence of another word its hash goes to a bucket.
3. Counts and neighbours of all ids of the training texts give the classes.  After first
   steps on a sample, which only set where it begins, the attention model meets every id of
   the training texts once in ROUNDS rounds: tasks train copies of it on disjoint shards, and
   a round ends with the mean of the copies.
4. The model scores each id of every text once.  Each bucket of words gives its counts'
   part of the base scores; sums by text return to buckets of texts and are added up.  A
   row of frequent words alone needs no other's part and is dealt to any bucket, so rows that
   repeat too often for one bucket never meet in one: all their words are frequent.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import _attention
from strandlake.llm._spark import crc_mod, dealt, stash
from strandlake.llm._subword import subwords
from strandlake.llm._text import Words, column_bytes, mix, scan, segment_sums, slices
from strandlake.llm.jaccard import BLOCKS, _binary, _bucket, _by_bucket

#: Held-out rows have this remainder of crc32(doc_id as text) by FOLDS.
FOLDS, HELD_OUT = 10, 0
#: Words settled in every task, unless there are more buckets.
HOT_WORDS = 20_000
#: Texts, and windows of each, of the attention model's first steps.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 1500, 32
#: Bytes of text scored at a time, which bounds a task's arrays; bytes of text per bucket.
SCORE_BYTES = 3 << 20
BUCKET_BYTES = 64 << 20
#: Words that a task's slices hold before they are merged; merged ones that it hands on.
HELD_WORDS, FLUSHED_WORDS = 2_500_000, 1_500_000
#: Smoothing of the base score.
SMOOTHING = 0.1
#: Rounds of training; windows of a shard, unless a round has MAX_SHARDS; of a piece of a text; of a step.
ROUNDS, SHARD, MAX_SHARDS, PIECE, STEP = 4, 16_384, 256, 256, 192
#: Sums of copies that the driver adds up.
SUMS_TO_DRIVER = 8
#: Windows shuffled together, and the rate of the first round, which falls to its twentieth part.
MIXED, RATE = 8192, 0.003
U64 = np.uint64
#: One text's share: its key (of doc_id and text), whether it needs no other's share, how often
#: it occurs, and sums.
PART = np.dtype([("k1", "<u8"), ("k2", "<u8"), ("doc", "<i8"), ("named", "?"), ("settled", "?"), ("rows", "<i4"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
SUMS = ("rows", "tokens", "known", "base", "score")


def held_out(column: str = "doc_id"):
    return F.coalesce(crc_mod(column, FOLDS) == HELD_OUT, F.lit(True))


def _trains(doc: list[int | None]) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % FOLDS != HELD_OUT for x in doc], bool)


def _planes(x: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte by byte."""
    return np.ascontiguousarray(np.diff(x, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T.copy().view(U64).ravel(), dtype=U64)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of the rows of values of each)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(values, starts, axis=0) if len(keys) else values


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(distinct words, their occurrences in training texts and in all, training texts) of runs of
    rows (doc_id, text); what the slices of a run give is held, and merged when it is much."""
    words, counts, held, ends = [], [], 0, 0
    for batch in slices(batches):
        trains = _trains(batch.column(0).to_pylist())
        w = scan(batch.column(1))
        order = np.argsort(w.h)
        h, mine = w.h[order], trains[w.row[order]]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        words.append(h[starts])
        counts.append(np.column_stack([np.add.reduceat(mine, starts, dtype=np.int64) if len(h) else starts, np.diff(starts, append=len(h))]))
        held += len(starts)
        ends += int(trains.sum())
        if held > HELD_WORDS:
            u, n = _sum_by(np.concatenate(words), np.concatenate(counts))
            words, counts, held = [u], [n], len(u)
            if held > FLUSHED_WORDS:
                yield u, n, ends
                words, counts, held, ends = [], [], 0, 0
    if held or ends:
        yield *_sum_by(np.concatenate(words), np.concatenate(counts)), ends


def _word_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks by bucket: distinct words, their occurrences in training texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts, ends in _counted(batches):
            bounds = np.searchsorted(_bucket(words, buckets), np.arange(buckets + 1))
            rows = [(b, np.array([j - i, ends if b == 0 else 0], np.int64).tobytes() + _planes(words[i:j]) + counts[i:j].astype("<i4").tobytes()) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if j > i or b == 0]
            yield from _binary(rows, BLOCKS)

    return dealt(docs.select("doc_id", "text")).mapInArrow(run, "bucket int, block binary")


COUNTS = pa.schema([("kind", pa.int32()), ("word", pa.int64()), ("n", pa.int64()), ("whole", pa.int64())])


def _count(blocks: list[bytes], most: int) -> Iterator[pa.RecordBatch]:
    """Of one bucket: (0, distinct in training, tokens in training, tokens), (1, -, ends, -) and (2, word,
    count in training, count) of the words that are at least one in ``most`` of its own tokens,
    hence of all that are at least one in ``most`` of the corpus's."""
    words, counts, ends = [], [], 0
    for raw in blocks:
        n, e = (int(x) for x in np.frombuffer(raw, np.int64, 2))
        ends += e
        words.append(_from_planes(raw, n, 16))
        counts.append(np.frombuffer(raw, "<i4", 2 * n, 16 + 8 * n).astype(np.int64).reshape(-1, 2))
    u, n = _sum_by(np.concatenate(words), np.concatenate(counts))
    trained, whole = (int(x) for x in n.sum(0))
    top = np.flatnonzero(n[:, 1] * most >= whole)
    rows = [(0, int((n[:, 0] > 0).sum()), trained, whole), (1, 0, ends, 0), *((2, int(x), int(y), int(z)) for x, (y, z) in zip(u[top].view(np.int64), n[top], strict=True))]
    yield from _binary(rows, COUNTS)


def _keys(ids: list[int | None], texts: pa.Array) -> np.ndarray:
    """128-bit keys, as two columns, of rows (doc_id, text): equal for equal rows alone."""
    buf, off = column_bytes(texts)
    raw = b"".join(xxhash.xxh3_128_digest(buf[a:b], seed=xxhash.xxh3_64_intdigest(b"%d" % i if i is not None else b"-")) for i, a, b in zip(ids, off[:-1], off[1:], strict=True))
    return np.frombuffer(raw, U64).reshape(-1, 2)


def _texts(batch: pa.RecordBatch) -> tuple[list[int | None], np.ndarray, Words, np.ndarray]:
    """(ids, which rows train, words, keys) of a slice of rows (doc_id, text)."""
    ids = batch.column(0).to_pylist()
    return ids, _trains(ids), scan(batch.column(1)), _keys(ids, batch.column(1))


def _hot_places(h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are hot, and the place of each of these."""
    spot = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    is_hot = hot[spot] == h if len(hot) else np.zeros(len(h), bool)
    return is_hot, spot[is_hot]


def _encoded(docs: DataFrame, tokenizer_path: str, hot: np.ndarray, hot_n: np.ndarray, ends: int, base: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(part, windows, ids, key) of each text: its share so far, its windows if it trains (else 0),
    its 16-bit ids with the end, and a hash of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SCORE_BYTES):
            ids, trains, w, keys = _texts(batch)
            n, first, row = len(ids), w.first, w.row
            flat, at = subwords(tokenizer_path).encode(w)
            bounds = at[first] + np.arange(n + 1)  # each text's ids and its end, in one array
            seq = np.full(len(flat) + n, _attention.END, np.uint16)
            seq[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(at[first]))] = flat
            is_hot, spot = _hot_places(w.h, hot)
            parts = np.zeros(n, PART)
            parts["k1"], parts["k2"] = keys.T
            parts["doc"] = [0 if x is None else x for x in ids]
            parts["named"] = [x is not None for x in ids]
            parts["rows"] = 1
            parts["tokens"] = w.counts + 1
            parts["known"] = np.bincount(row[is_hot], hot_n[spot] > 0, n) + (ends > 0)
            parts["base"] = np.bincount(row[is_hot], base(hot_n[spot]), n) + base(np.array(ends))
            parts["settled"] = np.bincount(row[~is_hot], minlength=n) == 0
            windows = np.where(trains, -(-np.diff(bounds) // _attention.WINDOW), 0)
            yield pa.RecordBatch.from_arrays([_binaries(parts.view(np.uint8), np.arange(n + 1) * PART.itemsize), pa.array(windows), _binaries(seq.view(np.uint8), 2 * bounds), pa.array((parts["k1"] >> U64(1)).astype(np.int64))], ["part", "windows", "ids", "key"])

    return dealt(docs.select("doc_id", "text")).mapInArrow(run, "part binary, windows long, ids binary, key long")


def _binaries(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _cold(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Blocks by bucket of words: occurrences of words that are not hot, with their texts' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SCORE_BYTES):
            _, trains, w, keys = _texts(batch)
            left = np.flatnonzero(~_hot_places(w.h, hot)[0])
            order = left[np.argsort(w.h[left])]
            h, place = w.h[order], w.row[order]
            limits = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            rows = []
            for b, (i, j) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
                if j > i:
                    used, at_used = np.unique(place[i:j], return_inverse=True)
                    wide = "<u2" if len(used) < 65536 else "<u4"
                    own = np.column_stack([keys[used], trains[used].astype(U64)])
                    rows.append((b, b"".join([np.array([len(used), j - i], np.int64).tobytes(), own.tobytes(), _planes(h[i:j]), at_used.astype(wide).tobytes()])))
            yield from _binary(rows, BLOCKS)

    return dealt(docs.select("doc_id", "text")).mapInArrow(run, "bucket int, block binary")


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Ids from BEGIN to END of texts (ids), a list a slice."""
    begin = np.array([_attention.BEGIN], "<u2")
    for batch in slices(batches, "ids", SCORE_BYTES):
        ids, at = column_bytes(batch.column(0))
        ids, at = np.frombuffer(ids, "<u2"), at // 2
        yield [np.concatenate([begin, ids[i:j]]) for i, j in zip(at[:-1], at[1:], strict=True)]


def _sample(encoded: DataFrame) -> np.ndarray:
    """At most SAMPLE_WINDOWS windows, spread over the whole text, of at most SAMPLE_TEXTS
    training texts, those whose keys are smallest."""
    size = _attention.WINDOW + 1
    chosen = encoded.where("windows > 0").select("key", "windows").orderBy("key", "windows").limit(SAMPLE_TEXTS)
    last = chosen.agg(F.max("key")).first()[0]
    if last is None:
        return np.zeros((0, size), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", SCORE_BYTES):
            out = []
            for seq in next(_training(iter([batch.select(["ids"])]))):
                starts = np.unique(np.linspace(0, max(0, len(seq) - size), min(SAMPLE_WINDOWS, 1 + len(seq) // size)).astype(np.int64))
                rows = np.full((len(starts), size), -1, np.int32)
                for r, s in zip(rows, starts, strict=True):
                    part = seq[s : s + size]
                    r[: len(part)] = part
                out.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["key", "windows"])

    mine = encoded.where((F.col("windows") > 0) & (F.col("key") <= last)).select("ids", "key").mapInArrow(run, "key long, windows binary")
    out = mine.orderBy("key", "windows").limit(SAMPLE_TEXTS).toArrow()
    return np.frombuffer(b"".join(out["windows"].to_pylist()), np.int32).reshape(-1, size)


def _classes(encoded: DataFrame) -> _attention.Classes:
    """Classes from the counts and neighbours of all ids of the training texts."""

    def summed(batches: Iterator[pa.RecordBatch], of: Callable, size: int) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for parts in _training(batches):
            if parts:
                np.add.at(sums, of(np.concatenate(parts), np.cumsum([len(x) for x in parts])), 1)
        keys = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[keys])], ["key", "n"])

    def total(of: Callable, size: int) -> np.ndarray:
        got = encoded.where("windows > 0").select("ids").mapInArrow(lambda x: summed(x, of, size), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros(size, np.int64)
        sums[got["key"].to_numpy()] = got["n"].to_numpy()
        return sums

    def pairs(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inner = np.ones(len(flat) - 1, bool)
        inner[ends[:-1] - 1] = False
        return _attention.neighbours(flat[:-1][inner], flat[1:][inner], class_of)

    counts = total(lambda flat, _: flat, _attention.VOCABULARY)
    class_of = _attention.alone(counts)[1]
    near = total(pairs, _attention.VOCABULARY * 2 * _attention.ALONE)
    return _attention.classes(counts, near.astype(np.float32).reshape(_attention.VOCABULARY, -1))


def _pieces(encoded: DataFrame, turn: int, shards: int) -> DataFrame:
    """(shard, turn, first, ids): pieces of at most PIECE windows of the training texts, those of one
    round; a piece that is not a text's first begins with the last id of the one before."""
    span = 2 * PIECE * _attention.WINDOW
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("windows") - 1) / PIECE)))
    rows = encoded.where("windows > 0").select("key", "ids", at.alias("at")).withColumn("h", F.pmod(F.xxhash64("key", "at"), F.lit(1 << 40)))
    begin = F.greatest(F.col("at") * span - 2, F.lit(0))
    rows = rows.where(F.col("h") % ROUNDS == turn)
    shard = (F.floor(F.col("h") / ROUNDS) % shards).cast("int")
    return rows.select(shard.alias("shard"), F.col("h").alias("turn"), (F.col("at") == 0).alias("first"), F.substring("ids", (begin + 1).cast("int"), (F.col("at") * span + span - begin).cast("int")).alias("ids"))


def _sum_of_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(windows, targets, params): sums of copies, their parameters weighted by their windows."""
    windows = targets = 0
    total: np.ndarray | float = 0.0
    for batch in batches:
        for w, t, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            windows, targets = windows + w, targets + t
            total = total + np.frombuffer(raw.as_buffer(), "<f4").astype(np.float64) * w
    if windows:
        yield pa.RecordBatch.from_arrays([pa.array([windows]), pa.array([targets]), pa.array([total.tobytes()], pa.binary())], ["windows", "targets", "params"])


def _trained(encoded: DataFrame) -> tuple[_attention.Model, int]:
    """The attention model, and how many targets it met after its first steps; ``encoded`` are
    texts as _encoded gives them."""
    windows = encoded.agg(F.sum("windows")).first()[0] or 0
    model = _attention.train(_sample(encoded), of=_classes(encoded))
    shards = min(MAX_SHARDS, max(1, -(-windows // (ROUNDS * SHARD))))
    size, begin_id = _attention.WINDOW + 1, np.array([_attention.BEGIN], np.int32)
    met = 0
    for r in range(ROUNDS if windows else 0):
        begin = model
        rate = RATE * (1 - 0.95 * r / ROUNDS)

        def run(batches: Iterator[pa.RecordBatch], begin: _attention.Model = begin, rate: float = rate) -> Iterator[pa.RecordBatch]:
            own, held, count, copy, adam, rng, seen, targets = None, [], 0, None, None, None, 0, 0

            def steps(most: int) -> None:
                nonlocal held, count, seen, targets
                w = np.concatenate(held) if held else np.zeros((0, size), np.int32)
                now, rest = w[:most], w[most:]
                held, count = [rest], len(rest)
                now = now[rng.permutation(len(now))]
                for a in range(0, len(now), STEP):
                    adam.step(now[a : a + STEP], rate)
                seen += len(now)
                targets += int((now[:, 1:] >= 0).sum())

            def result() -> Iterator[pa.RecordBatch]:
                steps(count)
                flat = np.concatenate([copy.params[k].ravel() for k in sorted(copy.params)]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([seen]), pa.array([targets]), pa.array([flat.tobytes()], pa.binary())], ["shard", "windows", "targets", "params"])

            for batch in batches:
                for shard, first, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                    if shard != own:
                        if own is not None:
                            yield from result()
                        own, held, count, seen, targets = shard, [], 0, 0, 0
                        copy = _attention.Model({k: v.copy() for k, v in begin.params.items()}, begin.of)
                        adam, rng = _attention.Adam(copy), np.random.default_rng(shard)
                    seq = np.frombuffer(ids.as_buffer(), "<u2").astype(np.int32)
                    held.append(_attention.cut(np.concatenate([begin_id, seq]) if first else seq))
                    count += len(held[-1])
                    while count >= MIXED:
                        steps(MIXED)
            if own is not None:
                yield from result()

        mine = _pieces(encoded, r, shards).repartitionById(shards, "shard").sortWithinPartitions("shard", "turn", "ids")
        copies = mine.mapInArrow(run, "shard int, windows long, targets long, params binary")
        copies = copies.repartitionById(min(shards, SUMS_TO_DRIVER), "shard").sortWithinPartitions("shard").mapInArrow(_sum_of_copies, "windows long, targets long, params binary")
        sums = copies.collect()
        if not sums:
            continue
        met += sum(c["targets"] for c in sums)
        mean = sum(np.frombuffer(c["params"], np.float64) for c in sums) / sum(c["windows"] for c in sums)
        at, params = 0, {}
        for k in sorted(begin.params):
            v = begin.params[k]
            params[k] = mean[at : at + v.size].astype(np.float32).reshape(v.shape)
            at += v.size
        model = _attention.Model(params, begin.of)
    return model, met


def _part_rows(parts: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Shares of texts as blocks by bucket of texts; settled ones are dealt over all buckets."""
    own = np.where(parts["settled"], mix(parts["k1"] + np.arange(len(parts)).astype(U64), 4), mix(parts["k1"]))
    target = _bucket(own, buckets)
    order = np.argsort(target, kind="stable")
    parts, target = parts[order], target[order]
    bounds = np.searchsorted(target, np.arange(buckets + 1))
    yield from _binary([(b, parts[i:j].tobytes()) for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if j > i], BLOCKS)


def _attended(encoded: DataFrame, model: _attention.Model, buckets: int) -> DataFrame:
    """The texts' shares with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", SCORE_BYTES):
            parts = np.frombuffer(column_bytes(batch.column(0))[0], PART).copy()
            ids, at = column_bytes(batch.column(1))
            ids, bounds = np.frombuffer(ids, "<u2"), at // 2
            parts["score"] = segment_sums(model.log10_probabilities(ids, bounds).astype(np.float64), bounds)
            yield from _part_rows(parts, buckets)

    return encoded.select("part", "ids").mapInArrow(run, "bucket int, block binary")


def _settled(blocks: list[bytes], buckets: int, base: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of one bucket of words: its part of the base scores of texts."""
    keys, hashes, places, so_far = [], [], [], 0
    for raw in blocks:
        a, b = (int(x) for x in np.frombuffer(raw, np.int64, 2))
        keys.append(np.frombuffer(raw, U64, 3 * a, 16).reshape(-1, 3))
        hashes.append(_from_planes(raw, b, 16 + 24 * a))
        wide = np.dtype("<u2" if a < 65536 else "<u4")
        places.append(np.frombuffer(raw, wide, b, 16 + 24 * a + 8 * b).astype(np.int64) + so_far)
        so_far += a
    key, h, place = (np.concatenate(x) for x in (keys, hashes, places))
    order = np.argsort(h, kind="stable")
    h, place = h[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.repeat(np.add.reduceat(key[place, 2].astype(np.int64), starts), np.diff(starts, append=len(h)))
    parts = np.zeros(len(key), PART)
    parts["k1"], parts["k2"] = key[:, 0], key[:, 1]
    parts["known"] = np.bincount(place, count > 0, len(key))
    parts["base"] = np.bincount(place, base(count), len(key))
    yield from _part_rows(parts, buckets)


def _added(blocks: list[bytes], train_tokens: int) -> Iterator[pa.RecordBatch]:
    """The rows of one bucket of texts from their shares."""
    parts = np.concatenate([np.frombuffer(b, PART) for b in blocks])
    whole = parts[parts["settled"]]
    rest = parts[~parts["settled"]]
    rest = rest[np.lexsort((rest["score"], rest["base"], rest["rows"], rest["k2"], rest["k1"]))]
    if len(rest):
        last = np.flatnonzero(np.concatenate([(rest["k1"][1:] != rest["k1"][:-1]) | (rest["k2"][1:] != rest["k2"][:-1]), [True]]))
        sums = {c: np.add.reduceat(rest[c].astype(np.float64 if c in ("base", "score") else np.int64), np.concatenate([[0], last[:-1] + 1])) for c in SUMS}
        one = rest[last]  # a share of the row itself, which also names it
        for c in SUMS[1:]:
            one[c] = sums[c] // sums["rows"] if sums[c].dtype == np.int64 else sums[c] / sums["rows"]
        whole = np.concatenate([whole, np.repeat(one, sums["rows"])])
    yield pa.RecordBatch.from_arrays(
        [pa.array(whole["doc"], mask=~whole["named"]), pa.array(whole["tokens"]), pa.array(whole["known"]), pa.array(np.full(len(whole), train_tokens)), pa.array(whole["base"]), pa.array(whole["score"])],
        ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def score_texts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of docs (doc_id, text).

    Tokens are words, runs of anything but ASCII white space with A-Z lower-cased, and one
    end.  base_score is the smoothed unigram log10 probability under the training counts,
    score the attention model's.  A null text is empty: its end alone.  A null doc_id is held
    out.  Repeated rows count and are returned as often as they occur; a very long text is
    scored whole, by itself; other columns are ignored; an empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    most = max(HOT_WORDS, buckets)
    counted = stash(_by_bucket(_word_blocks(docs, buckets), buckets, lambda b: _count(b, most), "kind int, word long, n long, whole long"))
    totals = {r["kind"]: r for r in counted.where("kind < 2").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("word", "n", "whole"))).collect()}
    distinct, words, whole = (int(totals[0][c]) for c in ("word", "n", "whole")) if totals else (0, 0, 0)
    ends = int(totals[1]["n"]) if totals else 0
    train_tokens, vocabulary = words + ends, distinct + (ends > 0)
    top = counted.where((F.col("kind") == 2) & (F.col("whole") * most >= whole)).select("word", "n").toArrow()  # at most ``most`` rows
    order = np.argsort(top["word"].to_numpy().view(U64))
    hot, hot_n = top["word"].to_numpy().view(U64)[order], top["n"].to_numpy()[order]
    log_all = np.log10(train_tokens + SMOOTHING * (vocabulary + 1))
    base = lambda count: np.log10(count + SMOOTHING) - log_all
    encoded = stash(_encoded(docs, tokenizer_path, hot, hot_n, ends, base))
    model, _ = _trained(encoded)
    cold = _by_bucket(_cold(docs, buckets, hot), buckets, lambda b: _settled(b, buckets, base), "bucket int, block binary")
    return _by_bucket(_attended(encoded, model, buckets).union(cold), buckets, lambda b: _added(b, train_tokens), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
