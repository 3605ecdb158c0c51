import hashlib
import re

import pytest
from compare import assert_same

from strandlake.llm import decontaminate
from strandlake.llm.queries import ORACLE_SQL, QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(text, items, span):
    w, hit, found = words(text), set(), set()
    for item, t in items.items():
        i = words(t)
        n = min(len(i), span)
        windows = {tuple(i[s : s + n]) for s in range(len(i) - n + 1)} if n else set()
        for s in range(len(w) - n + 1 if n else 0):
            if tuple(w[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("name", ["op4_decontamination", "op6_url_filter", "op10_chat", "op5_topk"])
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_hits_everywhere(spark, docs):
    long = " ".join(f"w{i}" for i in range(30))
    items = {1: long, 2: "alpha Beta gamma", 3: "é É x", 4: "", 5: None, 6: "...", 7: long, 8: " ".join(f"w{i}" for i in range(5, 17)), 9: "solo", 10: "q " * 25}
    texts = [long, " ".join(f"w{i}" for i in range(3, 13)), " ".join(f"w{i}" for i in range(3, 12)), "ALPHA-beta, gamma! alpha", "é É X é é x", "é é x", "Solo solo SOLO", None, "", "q " * 40,
             "pre " * 7 + long.upper() + " post" * 30, "w0 w1 " + " ".join(f"w{i}" for i in range(20, 30)) + " w5", long + " " + long, "\u212a " + long]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs(*texts), bench).collect()}
    assert got == {i: brute(t, items, 10) for i, t in enumerate(texts)}


def test_letters_whose_lower_case_hangs_on_others(spark, docs):
    words = ["\u039f\u0394\u039f\u03a3", "\u03a3", "a\u03a3", "\u03a3b", "\u212a", "\u0130x", "\u00c9", "w8", "w9", "w10", "w11"]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, ".".join(words[:3]))], "item_id long, text string")
    texts = [".".join(words), "x'" + "'".join(words) + "'\u03a3", " ".join(words[:4]), ":".join(words[1:])]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs(*texts), bench).collect()}
    items = {1: " ".join(words), 2: ".".join(words[:3])}
    assert got == {i: brute(t, items, 10) for i, t in enumerate(texts)} and got[0][1] == 11


def test_repeated_ids_and_an_empty_benchmark(spark, docs):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = docs((1, "one two three"), (1, "other"), (1, "one two three"), (None, "x one two three"))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in decontaminate.contamination(rows, bench).collect())
    assert got == [("1", 1, 0), ("1", 3, 3), ("1", 3, 3), ("None", 4, 3)]
    assert [r.n_hit for r in decontaminate.contamination(docs("a"), bench.limit(0)).collect()] == [0]
    assert decontaminate.contamination(docs("a").limit(0), bench).count() == 0


def test_digest_of_nothing(spark, sf_dir):
    row = QUERIES["op4_decontamination"](spark, sf_dir).where("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
