import re

import pytest

import corpus_pipeline as P
from strandlake.llm import pii, quality
from strandlake.llm.queries import EXAMPLE_KEY, QUALITY_PASSING, tokenizer_path
from test_decontaminate import brute as leaks
from test_jaccard import brute as near
from test_packing import check


def test_run_equals_brute_force(spark, sf_dir, documents):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    good = {r.doc_id: documents[r.doc_id] for r in quality.quality_scores(docs, model).where(f"quality_score >= {QUALITY_PASSING}").collect()}
    assert 0 < len(good) < len(documents)
    groups, _ = near(good, 5, 8, 10)
    kept = {d: t for d, t in good.items() if groups[d][1] == d}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    clean = {d: t for d, t in kept.items() if leaks(t, items, P.SPAN)[1] == 0}
    assert len(clean) < len(kept)
    s = pii.Surrogates(EXAMPLE_KEY)
    final = {d: pii.replace(t, s)[0] for d, t in clean.items()}
    rows = [r.asDict() for r in P.run(spark, sf_dir).collect()]
    assert check(rows, final.items(), 4096) < 0.02


@pytest.mark.parametrize("stage", range(4))
def test_stages_return_the_columns_of_documents(spark, sf_dir, docs, stage):
    name, run = P.STAGES[stage]
    frame = docs((1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (2, ""), (None, "x"), (None, None), (3, "mail a.b@c.org"))
    out = run(spark, frame, sf_dir)
    assert out.columns == frame.columns and re.match("[a-z_]+$", name)
    rows = out.collect()
    if name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "None", "None"]
    if name in ("decontamination", "pii"):
        assert len(rows) == 7
    assert run(spark, frame.limit(0), sf_dir).count() == 0


def test_null_ids_and_different_texts_of_one_id_stay(spark, sf_dir, docs):
    text = " ".join(f"word{i}" for i in range(30))
    frame = docs((None, text), (5, text), (5, "quite another text of the same id"), (6, text + " near"))
    rows = sorted((str(r.doc_id), r.text) for r in P.near_duplicate_stage(spark, frame, sf_dir).collect())
    assert rows == [("5", "quite another text of the same id"), ("5", text), ("None", text)]


def test_packing_has_no_labels(spark):
    assert tokenizer_path().endswith(".json") and P.ORACLE_SQL is None
