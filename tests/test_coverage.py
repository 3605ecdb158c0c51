import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import exprs as E
from strandlake.operators import coverage as C

BLOCK = "chrom string, s long, e long"


def runs(spark, *blocks, bin_size=C.BIN):
    got = C.segments(spark.createDataFrame([("c", *b) for b in blocks], BLOCK), bin_size).collect()
    return sorted((r.start, r.end, r.depth) for r in got)


def test_sweeps(spark):
    assert runs(spark, (0, 10), (5, 15)) == [(0, 5, 1), (5, 10, 2), (10, 15, 1)]
    assert runs(spark, (0, 5), (5, 10)) == [(0, 10, 1)]
    assert runs(spark, (3, 8), (8, 12), (3, 12)) == [(3, 12, 2)]
    assert runs(spark) == []


def model(blocks):
    depth = {}
    for s, e in blocks:
        for p in range(s, e):
            depth[p] = depth.get(p, 0) + 1
    out = []
    for p in sorted(depth):
        if out and out[-1][1] == p and out[-1][2] == depth[p]:
            out[-1] = (out[-1][0], p + 1, depth[p])
        else:
            out.append((p, p + 1, depth[p]))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30)), min_size=1, max_size=15))
def test_sweep_in_small_bins_equals_the_model(spark, items):
    blocks = [(s, s + n) for s, n in items]
    assert runs(spark, *blocks, bin_size=7) == model(blocks)


@pytest.mark.parametrize(("segment", "compat", "sums"), [((12, 25), False, [0, 8, 5, 0]), ((12, 25), True, [0, 7, 5, 0]), ((0, 30), True, [9, 10, 10, 0]), ((0, 30), False, [10, 10, 10, 0])])
def test_windows(spark, segment, compat, sums):
    segs = spark.createDataFrame([("c", *segment, 1)], "chrom string, start long, end long, depth long")
    contigs = spark.createDataFrame([(0, "c", 35)], "tid int, chrom string, length long")
    got = C.window_depth(segs, contigs, 10, compat).orderBy("window").collect()
    assert [round(r.value * 10) for r in got] == sums


def test_last_window_may_be_empty(spark):
    contigs = spark.createDataFrame([(0, "c", 40)], "tid int, chrom string, length long")
    got = C.window_count(contigs, 10).orderBy("window").collect()
    assert len(got) == 5 and (got[-1].start, got[-1].end) == (40, 40)


def test_cigar(spark):
    ops = [(4, 5), (0, 3), (1, 1), (0, 2), (2, 2), (0, 4), (3, 10), (0, 1)]
    row = spark.createDataFrame([(10, [{"op": o, "len": n} for o, n in ops])], "pos long, cigar array<struct<op:int,len:int>>")
    out = row.select(E.aligned_blocks(F.col("pos"), F.col("cigar")).alias("b"), E.reference_span(F.col("cigar")).alias("n")).first()
    assert [(x.s, x.e) for x in out.b] == [(10, 13), (13, 15), (17, 21), (31, 32)]
    assert out.n == 22


def test_flags(spark):
    rows = spark.createDataFrame([(f, 0) for f in (0, 4, 256, 512, 1024)], "flag int, tid int")
    assert [r.flag for r in rows.where(E.strict_filter()).collect()] == [0]
    assert sorted(r.flag for r in rows.where(E.lax_filter()).collect()) == [0, 256, 512, 1024]


def test_quantile(spark):
    rows = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 7)] * 40 + [("b", 9)] * 2 + [("c", 3)], "chrom string, x long")
    assert sorted(tuple(r) for r in C.depth_quantiles(rows, "x", 0.95).collect()) == [("a", 19), ("b", 7), ("c", 3)]
    assert sorted(tuple(r) for r in C.depth_quantiles(rows, "x", 1.0).collect()) == [("a", 19), ("b", 9), ("c", 3)]


def test_regions():
    assert C.parse_region("c") == ("c", 0, None)
    assert C.parse_region("c:1,001-2,000") == ("c", 1000, 2000)
    assert C.parse_region("c:5") == ("c", 4, None)


def test_overlaps(spark):
    rng = random.Random(4)
    some = lambda n: [("c", s, s + rng.randint(1, 60)) for s in (rng.randint(0, 3000) for _ in range(n))]
    left, right = some(60) + [("c", 5, 9)] * 2, some(8)
    got = C.overlapping(spark.createDataFrame(left, BLOCK), spark.createDataFrame(right, BLOCK), 50).collect()
    assert sorted((r.s, r.e) for r in got) == sorted((s, e) for _, s, e in left if any(s < b and a < e for _, a, b in right))


def test_trimmed_mean(spark):
    rows = spark.createDataFrame([(float(x),) for x in [10] * 50 + [11] * 50 + [1000]], "x double")
    out = C.trimmed_mean(rows, "x").first()
    assert out.n == 100 and abs(out["mean"] - 10.5) < 1e-9
