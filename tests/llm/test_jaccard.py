import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import jaccard
from strandlake.llm.queries import op2_jaccard_join


def sets_of(texts, k):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for doc, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        out[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute(texts, k, num, den):
    sets = sets_of(texts, k)
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for doc, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(doc)
    near = {p for ds in where.values() if len(ds) < 300 for p in itertools.combinations(sorted(ds), 2)}
    links = set()
    for a, b in near:
        if len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b]):
            links.add((a, b))
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in texts}, links


def test_whole_table(spark, sf_dir, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_jaccard_join(spark, sf_dir).collect()}
    assert got == brute(documents, 3, 90, 100)[0]


@pytest.mark.parametrize("block", [4, 1024])
def test_near_copies_in_blocks(spark, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BUCKET", 200)
    rng = random.Random(block)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    texts = []
    for _ in range(45):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(40)) + " common words that all of these documents share" for _ in range(45)]
    texts += ["", None, " ", "one", "One", "one two", "a b c", "a b c", "a b d"]
    rows = dict(enumerate(texts))
    joined = jaccard.jaccard_join(docs(*texts).repartition(2), 3, (8, 10))
    want, links = brute(rows, 3, 8, 10)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in joined.components().collect()} == want
    cls = {r.doc_id: r.class_id for r in joined.classes.collect()}
    assert {(r.a, r.b) for r in joined.links.collect()} == {tuple(sorted((cls[a], cls[b]))) for a, b in links if cls[a] != cls[b]}


def test_edges(docs):
    out = jaccard.jaccard_join(docs((5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (7, None))).components()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out.collect()) == [("3", "3"), ("5", "3"), ("5", "3"), ("7", "7"), ("None", "None")]
    assert jaccard.jaccard_join(docs((1, "a")).limit(0)).components().count() == 0


def test_null_and_negative_ids(docs):
    text = "a b c d e f g h i j k l m n o p q r s t"
    near, far = text + " u", "some other words that are of a negative id and of its copy too"
    out = jaccard.jaccard_join(docs((None, text), (5, text), (6, near), (-1, far), (-7, far + " x"), (9, far)).coalesce(1)).components()
    assert sorted((str(r.doc_id), str(r.component_id), r.n_links) for r in out.collect()) == [("-1", "-7", 1), ("-7", "-7", 1), ("5", "5", 1), ("6", "5", 1), ("9", "-7", 1), ("None", "None", 0)]


def test_table_with_itself(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 200)
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randrange(2000)}" for _ in range(90)]
        texts += [" ".join(w[:60]), " ".join(w[30:]), " ".join([*w[:60], "end"])]  # a third, and nearly all, in common
    frame = docs(*texts).repartition(3)
    joined = jaccard.jaccard_join(frame.union(frame).union(frame.limit(20)), 3, (8, 10))
    want, links = brute(dict(enumerate(texts)), 3, 8, 10)
    assert {(r.a, r.b, r.shared) for r in joined.links.collect()} == {(a, b, 58) for a, b in links} and len(links) == 12
    rows = joined.components().collect()
    assert len(rows) == 92 and {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_different_texts_of_one_id(docs):
    one, two = ("".join(f"{c}{i} " for i in range(30)) for c in "xy")
    rows = [(5, one), (5, two), (7, one + "more"), (3, two + "more"), (9, "z " + two), (5, one), (11, "alone")]
    joined = jaccard.jaccard_join(docs(*rows).repartition(4), 3, (8, 10))
    assert sorted((r.a, r.b, r.shared, r.size_a, r.size_b) for r in joined.links.collect()) == [(3, 5, 28, 29, 28), (3, 9, 28, 29, 29), (5, 7, 28, 28, 29), (5, 9, 28, 28, 29)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in joined.components().collect())
    assert got == [(3, 29, 3, 2), (5, 28, 3, 2), (5, 28, 5, 1), (5, 28, 5, 1), (7, 29, 5, 1), (9, 29, 3, 2), (11, 1, 11, 0)]


def test_one_row_of_each_group_stays(docs):
    one, two, far = ("".join(f"{c}{i} " for i in range(30)) for c in "xyz")
    rows = [(5, one), (5, two), (7, one + "more"), (3, two + "more"), (9, "z " + two), (5, one), (11, "alone"), (6, one + "b"), (6, one + "c"), (8, ""), (8, far), (8, None), (2, None), (2, ""), (None, one), (None, far), (12, far)]
    for parts in (1, 4):
        got = jaccard.deduplicated(docs(*rows).repartition(parts), 3, (8, 10))
        kept = sorted((str(r.doc_id), (r.text or "").strip()) for r in got.collect())
        assert got.columns == docs("a").columns
        assert kept == sorted([("5", one.strip()), ("3", two + "more"), ("11", "alone"), ("8", ""), ("8", far.strip()), ("2", ""), ("None", one.strip()), ("None", far.strip())])


def test_twins_that_link_with_each_other(docs):
    one = "".join(f"x{i} " for i in range(40))
    rows = [(4, one + "a"), (4, one + "b"), (9, one)]
    assert len(jaccard.deduplicated(docs(*rows), 3, (8, 10)).collect()) == 1


def test_frequent_grams_go_to_their_bucket_once_a_block():
    batches = [pa.record_batch({"doc_id": [10 * i + j for j in range(4)], "text": [f"the same words u{i}-{j} v{i} w" for j in range(4)]}) for i in range(60)]
    common = int(jaccard.shingle_sets(jaccard.scan(pa.array(["the same words"])), 3)[0][0])
    home, sent, last = jaccard._bucket(np.array([common], np.uint64), 16)[0], 0, []
    for out in jaccard._blocks_of(iter(batches), 3, 16):
        for bucket, raw in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            _, _, _, tok, weight = jaccard._unpack(raw)
            at = weight[tok == np.uint64(common)]
            sent += len(at)
            if bucket == home and len(at):
                last.append((int((at > 0).sum()), int(at.max())))
    assert sent == 240  # none is lost
    assert [n for n, _ in last[:7]] == [4] * 7 and last[0][1] == 1 and all(x == (1, jaccard.CAP) for x in last[7:]) and len(last) == 60


def test_links_of_a_group():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(20)]
    pairs = np.array(sorted({tuple(sorted(p)) for p in rng.integers(0, 20, (60, 2)).tolist() if p[0] != p[1]}))
    for values in (1, 50, 1 << 21):
        jaccard.VALUES, kept = values, jaccard.VALUES
        shared = jaccard._intersections(sets, pairs[:, 0], pairs[:, 1])
        jaccard.VALUES = kept
        assert shared.tolist() == [len(set(sets[a]) & set(sets[b])) for a, b in pairs.tolist()]
    ids, chain = np.arange(20) * 3 - 7, np.array([(i, i + 1) for i in range(3, 12)] + [(14, 19)])
    rows = jaccard._links(ids, np.full(20, 5), chain[:, 0], chain[:, 1], np.full(len(chain), 4)).to_pylist()
    assert [(r["a"], r["root"], r["degree"], [x["b"] for x in r["links"]]) for r in rows] == [
        (int(ids[i]), int(ids[3 if i < 14 else 14]), 1 if i in (3, 12, 14, 19) else 2, [int(ids[j]) for a, j in chain.tolist() if a == i]) for i in [*range(3, 13), 14, 19]
    ]
