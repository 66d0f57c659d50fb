import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec.operators import chunking, hybrid, ivf, search

SCHEMA = "id bigint, vector array<float>, text string, ts string"


def rows(spark, n=20, dim=8, seed=1, ts=lambda i: ""):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v[i].tolist(), f"row {i}", ts(i)) for i in range(n)], SCHEMA), v


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_topk(spark):
    c, v = rows(spark)
    s = v @ v[3]
    assert ids(search.topk(c, v[3].tolist(), 5)) == np.lexsort((range(20), -s))[:5].tolist()
    assert len(ids(search.topk(c, v[3].tolist(), 99))) == 20
    assert ids(search.topk(c.limit(0), v[3].tolist(), 3)) == []
    for k in (0, -1, 1.5):
        with pytest.raises(ValueError):
            search.topk(c, v[0].tolist(), k)


def test_ties_go_to_the_smaller_id(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0], "", "") for i in (5, 2, 9, 1)], SCHEMA)
    assert ids(search.topk(c, [1.0, 0.0], 3)) == [1, 2, 5]


def test_batch_agrees_with_single_and_gemm(spark):
    c, v = rows(spark, 50)
    for metric in ("ip", "cosine", "l2"):
        a = {(r["query_id"], r["rank"]): r["id"] for r in search.batch_topk(c, c.where("id < 4"), 6, metric).collect()}
        b = {(r["query_id"], r["rank"]): r["id"] for r in search.batch_topk_gemm(c, v[:4], range(4), 6, metric).collect()}
        assert a == b and len(a) == 24
        assert [a[2, i] for i in range(1, 7)] == ids(search.topk_by_id(c, 2, 6, metric))


def test_windows_of_time(spark):
    times = ["2025-01-15T08:00:00Z", "2025-01-15T10:00:00Z", "2025-01-15T14:00:00Z", "2025-01-15T20:00:00Z"]
    c, v = rows(spark, 4, ts=lambda i: times[i])
    n = lambda a, b, m="post": search.topk_in_window(c, v[0].tolist(), 4, a, b, mode=m).count()
    for m in ("pre", "post"):
        assert (n("2025-01-15T09:00:00Z", "2025-01-15T15:00:00Z", m), n("2025-01-15T14:00:00Z", "", m), n("", "", m), n("2026", "2027", m)) == (2, 2, 4, 0)
    c, v = rows(spark, 4)
    assert search.topk_in_window(c, v[0].tolist(), 4, "2026", "2027").count() == 4
    c, v = rows(spark, 100, ts=lambda i: f"2025-01-{i // 2 % 27 + 1:02}T{'08' if i % 2 else '20'}:00:00Z")
    assert search.topk_in_window(c, v[0].tolist(), 10, "2025-01-01T00", "2025-02", 1).count() == 10


def test_shards_and_namespaces(spark):
    c, v = rows(spark, 30)
    whole = ids(search.topk(c, v[1].tolist(), 7))
    assert ids(search.shard_topk([c.where(f"id % 3 = {i}") for i in range(3)], v[1].tolist(), 7)) == whole
    n = search.namespace_topk(c.withColumn("ns", F.when(F.col("id") % 2 == 0, "a").otherwise("b")), v[1].tolist(), {"a": 3, "b": 5})
    assert {r["ns"]: r["count"] for r in n.groupBy("ns").count().collect()} == {"a": 3, "b": 5}


def test_plans(spark):
    c, v = rows(spark)
    plan = search.topk(c, v[0].tolist(), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = search.batch_topk(c, c.where("id < 3"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_inverted_lists(spark):
    c, v = rows(spark, 400, 16)
    r = dict(ivf.sweep(c, c.where("id < 20"), 8, [2, 8], 10))
    assert r[8] == 1.0 and r[2] <= r[8]


POOL = [(1, 0.95, "stock market crash today", 1), (2, 0.80, "python async programming", 2)]


def test_hybrid(spark):
    texts = ["alpha beta gamma delta", "python async programming", "python async io tutorial guide", "cooking pasta dinner", "green garden plants", "blue ocean waves"]
    hits = spark.createDataFrame([(i + 1, s, t, i + 1) for i, (s, t) in enumerate(zip([0.95, 0.8, 0.65, 0.5, 0.4, 0.3], texts))], "id bigint, score double, text string, rank int")
    r = {x["id"]: x for x in hybrid.rerank(hits, "python async").collect()}
    assert [r[i]["lexical_score"] for i in range(1, 7)] == [0, 1, 0.9797, 0, 0, 0] or r[2]["lexical_score"] == 1
    assert sorted(r, key=lambda i: r[i]["hybrid_rank"])[0] == 2
    w = {x["id"]: x["hybrid_score"] for x in hybrid.rerank(hits, "python async", fusion="weighted").collect()}
    assert w[1] == 0.475 and w[2] == 0.9 and w[6] == 0.15
    same = hybrid.rerank(hits, "the and of").orderBy("hybrid_rank").collect()
    assert [x["id"] for x in same] == [1, 2, 3, 4, 5, 6] and same[0]["hybrid_score"] == 0.95


TEXTS = ["", "  \n ", "one", "# A\n\ntext\n\n## B\nmore\n\nTitle\n=====\nbody " + "word " * 300, "para one\n\npara two\n\n" + "x y " * 500, "\n".join(f"line {i}" if i % 7 else "" for i in range(200))]


@pytest.mark.parametrize("mode", ["line", "section", "paragraph", "tail"])
def test_chunks(mode):
    for t in TEXTS:
        got = chunking.chunks_of(t, mode)
        assert got and got[0][0] == 0
        assert set(" ".join(c for _, c in got).split()) >= set(t.split()) or mode == "paragraph" and "x" in t
        if mode != "tail":
            assert all(a[0] <= b[0] for a, b in zip(got, got[1:])) or mode == "paragraph"


def test_chunk_windows_and_modes(spark):
    d = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip(TEXTS, ["a.py", "b.MD", "c.txt", "d.rst", "noext", "e.ts"]))], "id int, text string, path string")
    modes = [r["m"] for r in d.orderBy("id").select(chunking.mode_of(F.col("path")).alias("m")).collect()]
    assert modes == ["line", "section", "paragraph", "section", "paragraph", "line"]
    c = chunking.chunk(d, chunking.mode_of(F.col("path")), keep=["id"])
    assert c.where("chunk_index = 0").count() == len(TEXTS)
    w = d.select("id", F.explode(chunking.char_windows(F.col("text"), 100, 20)).alias("w")).where("id = 4").collect()
    assert [r["w"]["offset"] for r in w] == list(range(0, 80 * len(w), 80))
    assert chunking.clamp_size(1) == 128 and chunking.clamp_size(10**9) == 65536 and chunking.clamp_size(None) == 800


def test_ivf_recall_asks_the_whole_query_set(spark):
    from lodevec.plans import registry
    from tests.conftest import SF

    n = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0").count()
    r = registry.ivf_recall(spark, SF).first()
    assert r["n_queries"] == n and r["good"]
