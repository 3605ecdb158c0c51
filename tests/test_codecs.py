import itertools
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlake.functions import codecs as C
from strandlake.functions import documents as D
from strandlake.functions import sequences as S
from strandlake.functions import statistics as T


@pytest.mark.parametrize(("seq", "code"), [("ACGT", "9c"), ("ACGTA", "9c80"), ("N", "00")])
def test_two_bits(seq, code):
    assert C.pack(seq).hex() == code


@given(st.text("ACGT", max_size=40), st.integers(0, 40), st.integers(0, 40))
def test_two_bits_and_three_bases_come_back(seq, a, b):
    a, b = min(a, b, len(seq)), min(max(a, b), len(seq))
    assert C.unpack(C.pack(seq), a, b) == seq[a:b] == C.unpack3(C.pack3(seq), a, b)


@pytest.mark.parametrize(("qual", "code"), [("FFFFFFFF", "204607"), ("FF", "004646"), ("#/#/", "00232f232f"), ("BBBB<FFFFFF", "3042033c4605"), ("F" * 255, "2046fe"), ("F" * 256, "2046ff00")])
def test_quality_codes(qual, code):
    assert C.encode_quality(qual).hex() == code


@given(st.lists(st.tuples(st.sampled_from(C.SYMBOLS), st.sampled_from([1, 2, 3, 254, 255, 256, 511])), max_size=6))
def test_quality_codes_come_back(runs):
    qual = "".join(c * n for c, n in runs)
    assert C.decode_quality(C.encode_quality(qual), len(qual)) == qual


def test_foreign_symbols_are_an_error():
    with pytest.raises(ValueError):
        C.encode_quality("FFI")


def brute_local(q, t, match=2, mismatch=3, go=5, ge=2):
    h, e, f = ({} for _ in range(3))
    best = 0
    for i, j in itertools.product(range(len(q)), range(len(t))):
        e[i, j] = max(h.get((i, j - 1), 0) - go, e.get((i, j - 1), -99)) - ge
        f[i, j] = max(h.get((i - 1, j), 0) - go, f.get((i - 1, j), -99)) - ge
        h[i, j] = max(0, h.get((i - 1, j - 1), 0) + (match if q[i] == t[j] else -mismatch), e[i, j], f[i, j])
        best = max(best, h[i, j])
    return best


@given(st.text("AC", min_size=1, max_size=9), st.text("AC", min_size=1, max_size=9))
def test_local_alignment(q, t):
    score, te, qe, _, _, tb, qb = S.align_local(q, t)
    assert score == brute_local(q, t)
    if score:
        assert S.align_global(q[qb : qe + 1], t[tb : te + 1])[0] == score


def test_global_alignment():
    assert S.align_global("ACGT", "ACGT") == (8, "4M")
    assert S.align_global("ACGT", "ACTTGT") == (8 - 9, "2M2D2M")
    assert S.extend("ACGTTT", "ACGTAA") == (8, 4, 4)


def test_hidden_markov():
    model = S.HiddenMarkov([0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], [[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]])
    seen = np.array([0, 1, 2, 2])
    weight = lambda p: model.start[p[0]] * model.emit[p[0], seen[0]] * math.prod(model.step[a, b] * model.emit[b, s] for a, b, s in zip(p, p[1:], seen[1:]))
    paths = list(itertools.product((0, 1), repeat=4))
    path, logp = model.best_path(seen)
    assert tuple(path) == max(paths, key=weight) and abs(logp - math.log(max(map(weight, paths)))) < 1e-9
    total = sum(map(weight, paths))
    assert abs(np.log(model.forward(seen)[1]).sum() - math.log(total)) < 1e-9
    assert abs(model.posterior(seen)[1, 0] - sum(weight(p) for p in paths if p[1] == 0) / total) < 1e-9
    better = model.updated(*model.expect(seen))
    assert np.log(better.forward(seen)[1]).sum() >= math.log(total)
    assert len(model.simulate(5)[0]) == 5


@given(st.text("abn", max_size=30))
def test_suffixes(text):
    order = S.suffix_array(text).tolist()
    assert order == sorted(range(len(text)), key=lambda i: text[i:])


def test_burrows_wheeler():
    assert S.burrows_wheeler("banana") == ("annbaa", 4)


def test_newick():
    tree = D.parse_newick("((a:1,b:2)x:0.5,c)r;")
    assert [n[2] for n in tree] == ["a", "b", "x", "c", "r"]
    assert D.format_newick(tree) == "((a:1,b:2)x:0.5,c)r;"


def test_documents_in_spark(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([('{"a": [{"b": 7}]}',)], "j string")
    assert row.select(D.json_at(F.col("j"), "a", 0, "b")).first()[0] == "7"
    spark.udtf.register("newick_nodes", D.NewickNodes)
    assert spark.sql("select * from newick_nodes('(a,b)r;')").count() == 3
    arcs = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    nodes = spark.range(1, 4)
    left = D.without_vertices(nodes, arcs, spark.range(2, 3))
    assert (left[0].count(), left[1].count()) == (2, 0)
    assert [tuple(r) for r in D.degrees(nodes, arcs).orderBy("id").collect()] == [(1, 1, 0), (2, 1, 1), (3, 0, 1)]
    pair = spark.createDataFrame([("ACGT", "TACGTT"), (None, "A")], "q string, t string")
    assert [r[0] and r[0].score for r in pair.select(S.local_alignment(F.col("q"), F.col("t"))).collect()][0] == 8


def test_special_functions():
    assert abs(T.gamma_p(2.5, 1.3) - 0.238634732) < 1e-8
    assert abs(T.gamma_q(1, 3) - math.exp(-3)) < 1e-12
    assert abs(T.beta_i(2, 3, 0.4) - 0.5248) < 1e-12
    assert abs(T.fisher_exact(8, 2, 1, 5)[2] - 0.03496503) < 1e-7


def test_minimisers():
    assert abs(T.minimise_line(lambda x: (x - 1.3) ** 2 + 1, -4, 9) - 1.3) < 1e-6
    x, y = T.minimise_patterns(lambda p: (p[0] - 1) ** 2 + (p[1] + 2) ** 2, [5, 5])
    assert abs(x - 1) < 1e-4 and abs(y + 2) < 1e-4
