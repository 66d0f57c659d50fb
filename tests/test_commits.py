"""Commits hold all or nothing; an index beside them; plans that cut before they join."""

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevec import __main__ as cli
from lodevec.functions import text as T
from lodevec.operators import chunking, search, store
from lodevec.plans import registry
from lodevec.sources import embed, files, ndjson
from lodevec.streaming import ingest
from tests.conftest import SF


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist(), f"row {first + i}") for i, x in enumerate(v)], "n bigint, vector array<float>, text string")


def broken(monkeypatch):
    def fail(*_):
        raise OSError("lost before publishing")

    monkeypatch.setattr(store.Collection, "_publish", fail)


def test_ids_follow_the_order_over_partitions(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "c"), 4)
    v = np.arange(400, dtype=float).reshape(100, 4)
    assert c.put_batch(table(spark, v).repartition(7), "n") == range(0, 100)
    assert c.put_batch(table(spark, v, 100).repartition(5).orderBy(F.desc("n"))) == range(100, 200)
    got = {r["id"]: r["text"] for r in c.rows().collect()}
    assert got == {i: f"row {i}" for i in range(100)} | {100 + i: f"row {199 - i}" for i in range(100)}
    with pytest.raises(ValueError):
        c.put_batch(spark.createDataFrame([([1.0, 2.0],)], "vector array<float>"))
    s = c.stats().first()
    assert (c.count(), s["n_put_batch_failed"], s["n_put_failed"]) == (200, 1, 0) and not c.files.list("_staging")
    assert c.put_batch(table(spark, v).limit(0)) == range(200, 200)


def test_an_index_honours_deletes_and_later_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)]
    c = store.Collection(spark, str(tmp_path / "c"), 16, "cosine")
    c.put_batch(table(spark, v[:1200]), "n")
    with pytest.raises(ValueError):
        c.search(v[0].tolist(), 5, nprobe=2)
    c.build_index(12)
    c.delete(spark.range(0, 1200, 3).select("id"))
    c.put_batch(table(spark, v[1200:], 1200), "n")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 1500, 50)], "id bigint, vector array<float>")
    exact = {(r["query_id"], r["rank"]): r["id"] for r in c.batch_search(q, 10).collect()}
    every = {(r["query_id"], r["rank"]): r["id"] for r in c.batch_search(q, 10, nprobe=12).collect()}
    assert every == exact and len(exact) == 300 and all(i >= 1200 or i % 3 for i in exact.values())
    assert search.recall_at_k(c.batch_search(q, 10, nprobe=4), c.batch_search(q, 10), 10).first()["recall"] >= 0.9
    again = store.Collection(spark, str(tmp_path / "c"))
    one = [(r["id"], r["text"]) for r in again.search(v[50].tolist(), 10, nprobe=12).orderBy("rank").collect()]
    assert one == [(exact[50, i], f"row {exact[50, i]}") for i in range(1, 11)]
    plan = again._indexed()[0].where(F.col("cell").isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert again.stats().first()["index_elements"] == 1200
    c.snapshot(str(tmp_path / "s"))
    assert store.Collection.restore(spark, str(tmp_path / "s"), str(tmp_path / "r")).rows().count() == c.count_live()


def test_small_commits_merge(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "c"), 4, dtype="int8")
    for i in range(3):
        c.put([float(i), 0.0, 0.0, 1.0], f"t{i}")
    before = sorted(map(tuple, c.rows().select("id", "text").collect()))
    assert c.merge() == 1 and c.merge() == 0  # two commits share a scale
    assert sorted(map(tuple, store.Collection(spark, str(tmp_path / "c")).rows().select("id", "text").collect())) == before


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    c, e = store.Collection(spark, str(tmp_path / "c"), 32, "cosine"), embed.hashing_embedder(32)
    read = lambda names: spark.createDataFrame([(n, 1, len(t), t) for n, t in names.items()], "path string, mtime_ms bigint, size bigint, text string")
    m, _ = files.index_files(c, read({"a.py": "alpha", "b.py": "beta"}), spark.createDataFrame([], files.MANIFEST), e)
    m = spark.createDataFrame(m.collect(), files.MANIFEST)
    x = store.ExternalIds(c)
    ext = spark.createDataFrame([("k", [1.0] * 32, "one"), ("l", [2.0] * 32, "two")], "external string, vector array<float>, text string")
    x.upsert(ext)
    rows = sorted(map(tuple, c.rows().select("id", "text").collect()))
    with monkeypatch.context() as lost:
        broken(lost)
        with pytest.raises(OSError):
            files.index_files(c, read({"a.py": "alpha new"}), m, e)
        with pytest.raises(OSError):
            x.upsert(ext.withColumn("text", F.lit("changed")))
    c = store.Collection(spark, str(tmp_path / "c"))
    x = store.ExternalIds(c)
    assert sorted(map(tuple, c.rows().select("id", "text").collect())) == rows
    commits = c.state["commit"]
    files.index_files(c, read({"a.py": "alpha new"}), m, e)[0].collect()  # the same again, and both at once
    assert x.upsert(ext.withColumn("text", F.lit("changed"))) == 2
    assert c.state["commit"] == commits + 2
    assert sorted(r["text"] for r in c.rows().collect()) == ["[file:a.py][chunk:1/1] alpha new", "changed", "changed"]
    assert {r["external"]: r["id"] for r in x.table().collect()}.keys() == {"k", "l"}


def test_streams_lose_no_line_and_repeat_none(spark, tmp_path, monkeypatch):
    c = store.Collection(spark, str(tmp_path / "c"), 4)
    c.put_batch(table(spark, np.eye(4)), "n")
    ndjson.write_ndjson(c.rows(), str(tmp_path / "in" / "a"))
    to = store.Collection(spark, str(tmp_path / "d"), 4)
    where = (spark, str(tmp_path / "in" / "*"), to, str(tmp_path / "checkpoint"))
    bad = tmp_path / "in" / "b" / "part"
    bad.parent.mkdir()
    bad.write_text('{"id":9,"vector":"broken","text":"x","timestamp":""}\n')
    with pytest.raises(Exception, match="short vector|malformed"):
        ingest.ingest(*where)
    assert to.rows().count() == 0
    bad.write_text("")
    ingest.ingest(*where)
    to.put([0.0, 0.0, 0.0, 2.0], "by another writer")
    again = store.Collection(spark, str(tmp_path / "d"))
    assert again.state["streams"] == {"ingest": 0} and again.rows().count() == 5
    import shutil

    shutil.rmtree(tmp_path / "checkpoint")  # the batch is replayed under its number, after another commit
    ingest.ingest(spark, str(tmp_path / "in" / "*"), again, str(tmp_path / "checkpoint"))
    assert again.rows().count() == 5


def test_one_writer_wins(spark, tmp_path):
    f = store.Files(spark, str(tmp_path / "x"))
    f.publish("first", "a", "1.json")
    with pytest.raises(store.ConflictError):
        f.publish("second", "a", "1.json")
    assert f.read("a", "1.json") == "first" and f.list("a") == ["1.json"]


def test_a_broken_snapshot_leaves_the_target(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path / "c"), 4)
    c.put([1.0, 0, 0, 0], "kept")
    c.snapshot(str(tmp_path / "s"))
    state = json.loads((tmp_path / "s" / "_commits" / "0.json").read_text())
    state["rows"].append({"dir": "missing", "scale": 1.0})
    (tmp_path / "s" / "_commits" / ".0.json.crc").unlink(missing_ok=True)
    (tmp_path / "s" / "_commits" / "0.json").write_text(json.dumps(state))
    with pytest.raises(Exception):
        store.Collection.restore(spark, str(tmp_path / "s"), str(tmp_path / "c"), force=True)
    assert store.Collection(spark, str(tmp_path / "c")).rows().first()["text"] == "kept"


def test_the_command_line_imports_its_own_export(spark, tmp_path, monkeypatch, capsys):
    c = store.Collection(spark, str(tmp_path / "c"), 4)
    texts = ['"q"', "a\nb\t", "\\", "漢字", ""]
    c.put_batch(spark.createDataFrame([([1.0, 0.0, 0.0, float(i)], t, "") for i, t in enumerate(texts)], "vector array<float>, text string, ts string"))
    for args in (["export", "c", "out"], ["import", "d", "out", "--dim", "4"]):
        monkeypatch.setattr("sys.argv", ["lodevec", args[0], *(str(tmp_path / a) for a in args[1:3]), *args[3:]])
        cli.main()
    assert capsys.readouterr().out.strip().endswith("5")
    assert [r["text"] for r in store.Collection(spark, str(tmp_path / "d")).rows().orderBy("id").collect()] == texts


@pytest.mark.parametrize("name", ["topk_ip", "topk_cosine", "topk_l2", "match_rank_hit", "ts_range_post", "hybrid_rrf", "shard_merge_topk"])
def test_nothing_joins_below_the_cut(spark, name, monkeypatch):
    plans, real = [], search.settled
    monkeypatch.setattr(search, "settled", lambda d: plans.append(d) or real(d))
    df = registry.QUERIES[name](spark, SF)
    plan = (plans[0] if plans else df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


def test_windows_of_time_reach_the_scan(spark):
    out = search.topk_in_window(registry.plain(spark, SF), [1.0] * 64, 5, "2024-01-01T06:00:00Z", mode="pre", times=spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("ts")))
    assert out.count() == 5


def test_bm25_by_join_is_that_of_pools(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["python async io", "python python tutorial", "", None, "garden plants", "io of io in io"])], "id bigint, text string")
    qs = spark.createDataFrame([(0, "python python io"), (1, "the of"), (2, "garden")], "query_id bigint, text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in T.bm25_scores(docs, qs).collect()}
    d = docs.select("id", T.tokens(F.coalesce("text", F.lit(""))).alias("d"))
    a = d.agg(F.avg(F.size("d"))).first()[0]
    want = d.crossJoin(qs.select("query_id", T.tokens(F.col("text")).alias("q"))).select("query_id", "id", T.bm25(F.col("q"), F.col("d"), F.lit(a)).alias("s")).where("s > 0").collect()
    assert got.keys() == {(r["query_id"], r["id"]) for r in want} and all(abs(got[r["query_id"], r["id"]] - r["s"]) < 1e-12 for r in want)


@pytest.mark.parametrize("target,overlap", [(100, 20), (100, 70), (10, 0), (7, 6)])
def test_character_windows_are_those_of_a_loop(spark, target, overlap):
    texts = ["", "  ", "short", "日本語 " * 90, "word  " * 100, "x" * target, "x" * (target + 1), "\n" * 50 + "end", "a\U0001f600b" * 60]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", chunking.char_windows(F.col("text"), target, overlap).alias("w"))
    got = {r["id"]: [tuple(w) for w in r["w"]] for r in d.collect()}
    assert got == {i: chunking._windows(t, target, overlap, 0) for i, t in enumerate(texts)}


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_blocks_of_queries(spark, metric, monkeypatch):
    """Ties, zero and null vectors, and queries in several blocks."""
    monkeypatch.setattr(search, "QUERY_BYTES", 200)
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(300, 4)), 1)
    v[7] = v[9] = v[250]
    v[11] = 0
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id bigint, vector array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in search.batch_topk(c, c.where("id % 10 = 0 OR id = 999"), 5, metric).collect():
        got[r["query_id"]].append((r["rank"], r["id"]))
    f = v.astype(np.float32).astype(float)
    unit = np.divide(f, np.linalg.norm(f, axis=1, keepdims=True), out=np.zeros_like(f), where=np.linalg.norm(f, axis=1, keepdims=True) > 0)
    assert set(got) == set(range(0, 300, 10))
    for q, hits in got.items():
        s = f @ f[q] if metric == "ip" else unit @ unit[q] if metric == "cosine" else 1 / (1 + ((f - f[q]) ** 2).sum(1))
        own = [i for _, i in sorted(hits)]
        assert np.allclose(s[own], np.sort(s)[::-1][:5], atol=1e-12)
        assert all(a < b for a, b in zip(own, own[1:]) if (f[a] == f[b]).all())


def test_tag_keys_with_quotes(spark):
    d = spark.createDataFrame([('{"it\'s": 1, "a.b": 2}',)], "j string").select(F.parse_json("j").alias("v"))
    assert d.where(T.matches(F.col("v"), {"it's": 1, "a.b": {"$gte": 2}})).count() == 1
    with pytest.raises(ValueError):
        T.matches(F.col("v"), {"both ' and \"": 1})
