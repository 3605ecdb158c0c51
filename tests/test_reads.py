import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import exprs as E
from strandlake.operators import qc
from strandlake.operators import reads as R

FIELDS = "ordinal long, name string, seq string, qual string"


def frame(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FIELDS)


def test_best_copy_is_the_first_of_equals(spark):
    out = R.collapse_best(frame(spark, ("a", "ACGT", "FFFF"), ("b", "ACGT", "FFFF"), ("c", "ACGT", "BBBB"))).collect()
    assert [tuple(r) for r in out] == [("ACGT", 3, "a", "FFFF")]


def test_best_copy_may_come_later(spark):
    rows = frame(spark, ("a", "ACGT", "BBBB"), ("b", "ACGT", "FFFF"))
    assert [tuple(r) for r in R.collapse_best(rows).collect()] == [("ACGT", 2, "b", "FFFF")]
    assert [tuple(r) for r in R.collapse_first(rows).collect()] == [("ACGT", 2, "a", "BBBB")]


def test_all_qualities_are_last_first(spark):
    out = R.collapse_all_qualities(frame(spark, ("a", "ACGT", "FFFF"), ("b", "ACGT", "FFFF"), ("c", "ACGT", "BBBB"))).first()
    assert (out.name, out.quals) == ("c", "BBBB\nFFFF\nFFFF")


def test_pair_key(spark):
    a = frame(spark, ("x 1", "AC", "FF"), ("y 1", "ACG", "FFF"))
    b = frame(spark, ("x 2", "GT", "FF"), ("y 2", "T", "F"))
    pairs = R.zip_pairs(a, b)
    assert R.collapse_best_pairs(pairs).count() == 2
    assert R.collapse_best_pairs(pairs, compat_pair_key=True).count() == 1


def test_unequal_mates_are_an_error(spark):
    with pytest.raises(Exception, match="unequal mates"):
        R.zip_pairs(frame(spark, ("x 1", "A", "F")), frame(spark, ("z 2", "A", "F"))).collect()


def test_shortlex(spark):
    rows = frame(spark, *((s, s, "F" * len(s)) for s in ("T", "AAAA", "CC", "AC")))
    assert [r.seq for r in R.sort_reads(rows).collect()] == ["T", "AC", "CC", "AAAA"]
    assert {r.seq: r["rank"] for r in R.sorted_rank(rows).collect()} == {"T": 1, "AC": 2, "CC": 3, "AAAA": 4}
    assert R.sorted_rank(rows.limit(0)).count() == 0


def test_pairing(spark):
    make = lambda names, i: frame(spark, *((f"{n} {i}", "A", "F") for n in names))
    a, b = make("124", 1), make("234", 2)
    assert sorted(r.key for r in R.paired(R.pair_reads(a, b)).collect()) == ["2", "4"]
    assert [r.name for r in R.unpaired(a, b).collect()] == ["1 1"]
    assert [r.name for r in R.unpaired(b, a).collect()] == ["3 2"]


def test_trim(spark):
    rows = frame(spark, ("a", "ACGTACGT", "FFFFBBBB"))
    assert R.trim(rows, 2, 5).first().seq == "GTA"
    assert R.trim(rows, 9, 12).first().seq == ""


def test_name_hash(spark):
    one = spark.createDataFrame([("@R1 1:N:0",)], "name string").select(E.x31(F.col("name")).alias("h"), E.sample_fraction_of(F.col("name")).alias("f")).first()
    assert one.h == 2964755514
    assert abs(one.f - 0.7131992) < 1e-6


def test_sample_n(spark):
    rows = frame(spark, *((f"r{i}", "A", "F") for i in range(20)))
    got = [r.ordinal for r in R.sample_n(rows, 7, 3).collect()]
    assert len(set(got)) == 7 and got == sorted(got)
    assert got == [r.ordinal for r in R.sample_n(rows.repartition(3), 7, 3).collect()]
    with pytest.raises(ValueError):
        R.sample_n(rows, 21)


def test_ranks_of_equal_keys(spark):
    rows = frame(spark, *((s, s, s) for s in ("C", "A", "C", "B")))
    assert {r.ordinal: r["rank"] for r in R.rank_reads(rows).collect()} == {1: 1, 3: 2, 2: 3, 0: 4}
    assert {r.seq: r["rank"] for r in R.key_ranks(rows).collect()} == {"A": 1, "B": 2, "C": 3}


def test_quality_shares(spark):
    rows = frame(spark, ("a", "ACGT", "45>?")).withColumn("file", F.lit("f"))
    out = qc.qc_summary(rows).first()
    assert (out.q20, out.q30) == (75.0, 25.0)
    matrix = qc.quality_matrix(rows)
    assert tuple(qc.quality_shares(matrix).first()) == (0.75, 0.25)
    assert qc.quality_table(matrix, 4).count() == 128


def test_empty_reads(spark):
    rows = frame(spark, ("a", "", ""), ("b", "ACG", "FFF")).withColumn("file", F.lit("f"))
    out = qc.qc_summary(rows).first()
    assert (out.reads, out.min_length, out.max_length) == (2, 3, 3)
    assert qc.quality_matrix(rows).count() == 3
    assert [tuple(r) for r in qc.length_histogram(rows).orderBy("length").collect()] == [(0, 1), (1, 0), (2, 0), (3, 1)]


def test_gc_density(spark):
    shares = [(b, int(10_000 * np.exp(-0.5 * (((b + 0.5) / 50 - 0.46) / 0.07) ** 2))) for b in range(50)]
    out = qc.gc_density(spark.createDataFrame([(b, n) for b, n in shares if n], "bin long, n long"))
    assert abs(out["mean"] - 0.46) < 1e-3 and abs(out["sd"] - 0.07) < 0.005 and abs(out["height"] * out["sd"] * np.sqrt(2 * np.pi) - 1) < 0.01
    two = qc.gc_density(spark.createDataFrame([(15, 900), (16, 1000), (17, 900), (45, 60)], "bin long, n long"))
    assert abs(two["mean"] - 0.33) < 0.02  # the fit follows the peak, the mean of all would not
    assert qc.gc_density(spark.createDataFrame([], "bin long, n long"))["mean"] is None
    assert set(qc.qc_report(frame(spark, ("a", "AC", "FF")))) == {"gc_1", "quality_1", "bases_1", "lengths_1", "duplicates"}


def test_ranks_leave_other_columns(spark):
    from strandlake.plans.tables import with_global_rank

    rows = spark.createDataFrame([(3, "a", 1, 2, 3), (1, "b", 4, 5, 6)], "x int, rank string, _part int, _k0 int, _0k0 int")
    got = with_global_rank(rows, ["x"]).orderBy("rank").collect()
    assert [(r["x"], r["rank"], r["_part"], r["_k0"], r["_0k0"]) for r in got] == [(1, 1, 4, 5, 6), (3, 2, 1, 2, 3)]
