import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.llm import _fit, quality, toxicity
from strandlake.llm.queries import op3_toxicity, op7_quality

TEXTS = ["Fine words of a usual kind, with some sense and stops.", "%%% ### BAD!! BAD!! BAD!! BAD!!", None, "", "a " * 5000]


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_queries(spark, sf_dir, documents):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for query, name, least in ((op7_quality, "quality", 0.85), (op3_toxicity, "toxic", 0.75)):
        rows = query(spark, sf_dir).collect()
        assert sorted(r.doc_id for r in rows) == sorted(documents)
        assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)
        mine = [r for r in rows if r.doc_id in labels and r.held_out]
        assert np.mean([r.predicted == labels[r.doc_id][name] for r in mine]) >= least


def learnt(sf_dir, spark, documents, name):
    labels = {r.doc_id: r[name] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = sorted(d for d, y in labels.items() if y is not None and d in documents and not held(d))
    return [documents[d] for d in ids], np.array([labels[d] for d in ids])


def test_toxicity_equals_brute_force(spark, sf_dir, documents):
    texts, y = learnt(sf_dir, spark, documents, "toxic")
    terms = lambda t: toxicity.term_ids(pa.array([t], pa.string()))[0]
    machine = toxicity.fit_machine([terms(t) for t in texts], y)
    for r in op3_toxicity(spark, sf_dir).collect():
        at = [int(x) for x in machine.slot[terms(documents[r.doc_id])] if x >= 0]
        z = machine.bias + machine.w[at].sum() + sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.predicted == (r.score >= 0.5)


def test_quality_equals_brute_force(spark, sf_dir, documents):
    texts, y = learnt(sf_dir, spark, documents, "quality")
    x = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    centre, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1)
    model = quality.fit_discriminant(x, y)
    assert np.allclose(model.centre, centre) and np.allclose(model.scale, scale, atol=1e-6)
    a, b = model.curve
    for r in op7_quality(spark, sf_dir).collect():
        z = (quality.statistics(pa.array([documents[r.doc_id]], pa.string()))[0] - model.centre) / model.scale
        gap = 0.0
        for c, sign in ((0, -1), (1, 1)):
            cov = np.linalg.inv(model.factors[c].T @ model.factors[c])
            d = z - model.means[c]
            gap += sign * (-0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((y == c).sum()))
        raw = np.sign(gap) * np.log1p(abs(gap))
        assert abs(r.score - 1 / (1 + np.exp(-(a * raw + b)))) < 1e-6 and r.predicted == (r.score >= 0.3)


def test_repeated_ids_count_once(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    rows = [(i, f"text {i} {j}") for i in range(12) for j in range(9)]
    got = [_fit.vectors_of(_fit.training_rows(docs(*rows).repartition(n), labels, "toxic", 5), lambda t: [x.encode() for x in t.to_pylist()]).collect() for n in (1, 3)]
    assert sorted(got[0]) == sorted(got[1]) and len(got[0]) == 5


def test_clashing_columns(spark, docs):
    frame = docs("a", None).withColumn("toxicity_score", F.lit("x")).withColumn("quality_score", F.lit(1))
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for made, name in ((toxicity.toxicity_scores(frame, toxicity.fit_toxicity(frame, nothing)), "toxicity_score"), (quality.quality_scores(frame, quality.fit_quality(frame, nothing)), "quality_score")):
        assert made.columns.count(name) == 1 and all(0 <= r[name] <= 1 for r in made.collect())


def test_training_rows_leave_the_fold_out(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = _fit.training_rows(docs(*["t"] * 40), labels, "quality", 12).collect()
    assert len(got) == 12 and not any(held(r.doc_id) for r in got)


def test_edges(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = docs(*(TEXTS[i % 2] for i in range(40)))
    model = quality.fit_quality(rows, labels)
    scored = quality.quality_scores(docs(*TEXTS, (None, "x")), model).collect()
    assert len(scored) == 6 and all(0 <= r.quality_score <= 1 for r in scored) and scored[0].label == "x"
    machine = toxicity.fit_toxicity(rows, labels)
    scored = toxicity.toxicity_scores(docs(*TEXTS), machine, ["doc_id"]).collect()
    assert scored[1].toxicity_score > 0.5 > scored[0].toxicity_score
    assert quality.quality_scores(docs("a").limit(0), model).count() == 0
    nothing = labels.limit(0)
    assert {r.quality_score for r in quality.quality_scores(rows, quality.fit_quality(rows, nothing)).collect()} == {0.5}
    assert len({r.toxicity_score for r in toxicity.toxicity_scores(rows, toxicity.fit_toxicity(rows, nothing)).collect()}) == 1


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], [200, 300])
    m = quality.fit_discriminant(x, y)
    z = (x[:5] - m.centre) / m.scale
    gap = np.zeros(5)
    for c, sign in ((0, -1), (1, 1)):
        cov = np.linalg.inv(m.factors[c].T @ m.factors[c])
        d = z - m.means[c]
        gap += sign * (-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((y == c).sum()))
    assert np.allclose(m.raw(x[:5]), np.sign(gap) * np.log1p(np.abs(gap)))


def test_pairs_that_matter_only_together():
    rng = np.random.default_rng(2)
    a, b = rng.random(2000) < 0.5, rng.random(2000) < 0.5
    rows = [np.array([i for i, on in ((3, p), (9, q)) if on], int) for p, q in zip(a, b, strict=True)]
    machine = toxicity.fit_machine(rows, (a & b).astype(int))
    z = machine.bias + np.array([0, machine.w[machine.slot[3]], machine.w[machine.slot[9]], machine.w.sum() + machine.v[0] @ machine.v[1]])
    assert (z > 0).tolist() == [False, False, False, True]


def test_machine_scores_the_pairwise_sum():
    texts = pa.array(["alpha beta gamma", "beta", None])
    ids, rows = toxicity.term_ids(texts)
    machine = toxicity.fit_machine([ids[rows == 0]] * 20 + [ids[rows == 1]] * 20, np.repeat([1, 0], 20))
    at = machine.slot[np.unique(ids[rows == 0])]
    at = at[at >= 0]
    z = machine.bias + machine.w[at].sum() + sum(machine.v[i] @ machine.v[j] for k, i in enumerate(at) for j in at[k + 1 :])
    assert abs(machine.score(texts)[0] - 1 / (1 + np.exp(-z))) < 1e-9
