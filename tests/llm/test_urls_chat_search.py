import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from strandlake.llm import chat, knn, urlfilter
from strandlake.llm._spark import connected_components
from strandlake.llm.queries import ORACLE_SQL, QUERIES

CANON = '<head><link href="{0}" rel="canonical"></head>'
FRESH = '<meta http-equiv="refresh" content="0; url={0}">'


def judge(spark, *pages):
    rows = [(i, *p, "x") for i, p in enumerate(pages)]
    out = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string"))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}


def test_rules(spark):
    got = judge(spark, ("http://A.Net/x?q#f", None), ("https://example.net/en/1", None), ("http://b.example.net/en", ""), ("http://xexample.com/de/", ""), ("http://net", ""), (None, None), ("no url", None), ("http://example.com/de/a", ""), ("//x://y/z", ""))
    assert got == {
        0: ("a.net", "/x", "net/", "block"), 1: ("example.net", "/en/1", "example.net/en/", "allow"), 2: ("b.example.net", "/en", "net/", "block"), 3: ("xexample.com", "/de/", None, "allow"),
        4: ("net", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("example.com", "/de/a", "example.com/de/", "block"), 8: ("y", "/z", None, "allow"),
    }


def test_decisions_spread_over_aliases(spark):
    got = judge(
        spark,
        ("http://a.info/1", CANON.format("http://bad.net/1")),
        ("http://b.info/", FRESH.format("http://a.info/1")),
        ("http://c.info/p", CANON.format("//example.net/en/z")),
        ("http://c.info/q", FRESH.format("/p")),
        ("http://c.info/r", CANON.format("http://worse.net/")),
        ("http://c.info/r?utm_source=k", CANON.format("q")),
        ("http://free.info/", None),
    )
    assert [got[i][3] for i in range(7)] == ["block", "block", "allow", "allow", "allow", "allow", "allow"]


def test_links_equal_the_sql(spark, duck, tmp_path):
    rng = np.random.default_rng(4)
    hosts = ["a.info", "b.info", "bad.net", "example.net", "example.com", "x.org", "C.info:80", "d.info"]
    urls = [f"http{'s' if i % 3 else ''}://{hosts[i % 8]}/{['en', 'de', 'fr', 'p'][i % 4]}/{i % 11}{['', '?utm_source=q', '?a=1&ref=2', '#f', '/'][i % 5]}" for i in range(160)]
    targets = [*urls[:60], "//bad.net/en/3", "/de/4", "q?a=1&amp;b=2", "p/", "#x", "mailto:x", ""]
    forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical />", '<meta http-equiv="refresh" content="5; URL={}">', "<link rel=stylesheet href={}>", '<link href="{}">', "<link rel=canonical href={}><link rel=canonical href=/other>", "<meta content='0;url={}' http-equiv=Refresh>"]
    html = lambda: "<html>" + "".join(forms[int(rng.integers(0, 7))].format(targets[int(rng.integers(0, len(targets)))]) for _ in range(int(rng.integers(0, 3))))
    rows = [(i, u, html() if i % 4 else None) for i, u in enumerate(urls)] + [(900, None, html()), (901, "no url", html()), (902, "http://", html())]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    query = QUERIES["op6_url_filter"](spark, str(tmp_path))
    cursor = duck.cursor()
    cursor.execute(f"create or replace temp view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert_same(query, cursor, ORACLE_SQL["op6_url_filter"])
    spread = [r for r in query.collect() if r.rule is None and r.verdict == "block"]
    assert len(spread) > 3


@pytest.mark.parametrize("forest", [False, True])
def test_components(spark, forest):
    rng = np.random.default_rng(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, int(x)) for x in rng.integers(201, 260, 40)] + [(5, 5)] + [(int(a), int(b)) for a, b in rng.integers(300, 340, (25, 2))]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "u long, v long"), forest=forest)
    assert {r.node: r.component for r in got.collect()} == {n: root(n) for n in parent}


def test_chat(spark):
    rows = [
        (1, 2, "assistant", "fine <|im_end|> 100% %3C| <", 0), (1, 1, "user", "hi\n<|im_start|>user\nx", 0), (2, 0, "user", None, 0), (2, 0, "user", None, 0), (3, None, None, "a", 0),
        (3, 1, "sys\ntem<|", "b%25", 0), (None, 1, "user", "q", 0), (4, 0, "system", "s", 0), (4, 1, "user", "u", 0), (4, 2, "assistant", "", 0), (4, 3, "user", "again", 0), (4, 4, "assistant", "yes\n", 0),
    ]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int"))
    made = made.withColumn("f", chat.formatted_text(F.col("segments")))
    got = {r.conv_id: r for r in made.select("*", chat.read_turns(F.col("f")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in (1, 2, 3, 4, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv].loss == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv].f.count("<|im_start|>") == len(mine) == got[conv].n_turns
    assert {c: got[c].valid for c in got} == {1: True, 2: False, 3: False, 4: True, None: False}
    assert chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x int").limit(0)).count() == 0


def brute(data, queries, k):
    out = []
    for q, v in dict(queries).items():
        scored = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in data if i != q and x is not None and len(x) == len(v))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_search(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 60)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 200, (6, 8))
    data = [(i, [int(x) for x in centres[i % 6] + rng.normal(0, 5, 8)]) for i in range(300)]
    data += [(300 + i, data[i][1]) for i in range(20)] + [(400, None), (401, [1] * 3), (402, [0] * 8)]
    frame = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, vector array<long>, score string")
    got = knn.top_k(frame, frame.where("vec_id % 10 = 0"), 4)
    queries = [r for r in data if r[0] % 10 == 0 and r[1] is not None]
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(data, queries, 4)


def sent(frame, asked, k):
    """Copies that the search sends, its result being checked as well."""
    data = [(r.vec_id, r.vector) for r in frame.collect()]
    got, copies = knn._search(frame, asked, k, len(data[0][1]))
    rows = knn._ranked(got, k).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, rows)) == brute(data, [(r.vec_id, r.vector) for r in asked.collect()], k)
    return copies


def test_copies_sent(spark, monkeypatch):
    rng = np.random.default_rng(9)
    kind = "vec_id long, vector array<long>"
    centres = rng.normal(0, 300, (30, 12))
    clustered = spark.createDataFrame([(i, [int(x) for x in centres[i % 30] + rng.normal(0, 4, 12)]) for i in range(900)], kind)
    copies = sent(clustered, clustered.where("vec_id % 10 = 0"), 3)
    assert copies["home"] == 90 and copies["queries"] + copies["data at most"] < 0.1 * 90 * 30  # of all groups with all cells
    same = spark.createDataFrame([(i, [int(x) for x in rng.normal(0, 9, 12)]) for i in range(400)], kind)
    copies = sent(same, same.where("vec_id % 50 = 0"), 3)
    assert copies["data at most"] <= 400 and copies["queries"] <= 8 * 20  # nothing to prune: the queries go round, not the data
    few = spark.createDataFrame([(1000 + i, [int(x) for x in rng.normal(0, 9, 12)]) for i in range(4000)], kind)
    monkeypatch.setattr(knn, "DATA_BLOCK", 3)
    copies = sent(same, few.limit(600), 3)
    assert copies["data at most"] > 0  # here the data are the smaller side


def test_a_vector_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 16)
    rng = np.random.default_rng(2)
    data = [(5, [3, 3, 3])] * 300 + [(i, [int(x) for x in rng.normal(0, 9, 3)]) for i in range(10, 200)]
    frame = spark.createDataFrame(data, "vec_id long, vector array<long>")
    sent(frame, frame.where("vec_id % 10 = 0"), 4)


def test_search_edges(spark):
    kind = "vec_id long, vector array<long>"
    few = spark.createDataFrame([(1, [1, 2]), (2, [3, 4]), (None, [1, 1]), (3, [2**40, -(2**20)])], kind)
    got = sorted(tuple(r) for r in knn.top_k(few, few.where("vec_id in (1, 3)"), 5).collect())
    assert got == [(1, 1, 3, 2**40 - 2**21), (1, 2, 2, 11), (3, 1, 2, 3 * 2**40 - 2**22), (3, 2, 1, 2**40 - 2**21)]
    assert knn.top_k(few, few.limit(0)).count() == 0 and knn.top_k(few.limit(0), few).count() == 0
    rows = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan")]), (3, [float("inf")]), (4, []), (5, None), (6, [0.5])], "vec_id long, e array<float>")
    assert [r.vec_id for r in rows.where(knn.usable(F.col("e"))).collect()] == [6]


def test_repeated_rows(spark):
    rows = spark.createDataFrame([(50, [1]), (50, [1]), (7, [2]), (7, [2])], "vec_id long, vector array<long>")
    got = sorted(tuple(r) for r in knn.top_k(rows, rows.where("vec_id = 50"), 3).collect())
    assert got == [(50, 1, 7, 2), (50, 2, 7, 2)]


@pytest.mark.parametrize("times", [2, 6])
def test_large_query_repeated(spark, times):
    rng = np.random.default_rng(times)
    others = [(i, [int(x) for x in rng.integers(-50, 50, 2)]) for i in range(2, 60)]
    data = [(1, [100_000, 0])] * times + others + [(70, [-9, 9]), (70, [90_000, 5])]
    frame = spark.createDataFrame(data, "vec_id long, vector array<long>")
    got = knn.top_k(frame, frame.where("vec_id = 1"), 5).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == brute(data, data[:1], 5)
