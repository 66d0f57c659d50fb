import json
import os

import pytest
from pyspark.sql import functions as F

from lodevec.operators import store
from lodevec.sources import embed, files, ndjson
from lodevec.streaming import ingest


def filled(spark, path, n=10, **how):
    c = store.Collection(spark, str(path), 4, **how)
    c.put_batch(spark.createDataFrame([([float(i == j) + 0.1 * i for j in range(4)], f"t{i}", "") for i in range(n)], "vector array<float>, text string, ts string"))
    return c


def test_ids_deletes_updates(spark, tmp_path):
    c = filled(spark, tmp_path / "c", 3)
    assert (c.count(), c.count_live()) == (3, 3)
    c.delete(1)
    assert (c.count(), c.count_live()) == (3, 2)
    assert {r["id"] for r in c.rows().collect()} == {0, 2}
    for bad in (1, 99, -1):
        with pytest.raises(KeyError):
            c.delete(bad)
    assert c.update(0, [1, 0, 0, 0], "new") == 3
    assert (c.count(), c.count_live()) == (4, 2)
    with pytest.raises(ValueError):
        c.put([1.0])
    assert c.put([0, 0, 0, 1.0], "last") == 4
    again = store.Collection(spark, str(tmp_path / "c"))
    assert sorted(r["id"] for r in again.rows().collect()) == [2, 3, 4]
    assert again.delete_match([0, 0, 0, 1.0]) in (2, 3, 4)
    assert again.forget([1, 0, 0, 0], 2) == 2 and again.count_live() == 0
    assert again.search([1, 0, 0, 0]).count() == 0


def test_crash_leaves_nothing(spark, tmp_path):
    c = filled(spark, tmp_path / "c", 3)
    spark.range(5).write.parquet(str(tmp_path / "c" / "data" / "unpublished"))
    again = store.Collection(spark, str(tmp_path / "c"))
    assert again.rows().count() == 3 and again.staged() == 1
    assert again.doctor().where("NOT ok").count() == 0
    c.put([1, 0, 0, 0])
    with pytest.raises(store.ConflictError):
        again.put([1, 0, 0, 0])


@pytest.mark.parametrize("dtype,least", [("float16", 0.99), ("int8", 0.9)])
def test_reduced_precision(spark, tmp_path, dtype, least):
    c = store.Collection(spark, str(tmp_path / dtype), 4, "cosine", dtype)
    c.put([0.5, 0.5, 0.5, 0.5], "a")
    c.put([8, 0, 0, 1.0], "b")
    hit = c.search([0.5, 0.5, 0.5, 0.5], 1).first()
    assert hit["id"] == 0 and hit["score"] > least
    assert c.raw_vectors().count() == 0


def test_compact_snapshot_restore_quota(spark, tmp_path):
    c = filled(spark, tmp_path / "c", 10)
    c.delete(spark.createDataFrame([(2,), (5,)], "id bigint"))
    d = c.compact(str(tmp_path / "d"))
    assert [r["text"] for r in d.rows().orderBy("id").collect()] == [f"t{i}" for i in range(10) if i not in (2, 5)]
    with pytest.raises(ValueError):
        c.compact(str(tmp_path / "d"))
    c.snapshot(str(tmp_path / "s"))
    r = store.Collection.restore(spark, str(tmp_path / "s"), str(tmp_path / "r"))
    assert r.count_live() == 8 and r.rows().count() == 8
    with pytest.raises(ValueError):
        store.Collection.restore(spark, str(tmp_path / "s"), str(tmp_path / "r"))
    store.Collection.restore(spark, str(tmp_path / "s"), str(tmp_path / "r"), force=True)
    q = store.Catalog(spark, str(tmp_path / "root"), max_namespaces=1, max_vectors=2, dim=4)
    one = q.open("one")
    one.put([1, 0, 0, 0]), one.put([1, 0, 0, 0])
    with pytest.raises(store.QuotaError) as e:
        one.put([1, 0, 0, 0])
    assert e.value.kind == "vectors"
    with pytest.raises(store.QuotaError):
        q.open("two")
    assert q.names() == ["one"] and q.stats().first()["count"] == 2


def test_upgrade(spark, tmp_path):
    c = tmp_path / "c" / "_commits"
    c.mkdir(parents=True)
    (c / "0.json").write_text(json.dumps({"dim": 4, "metric": "ip", "next_id": 0, "rows": []}))
    changes = store.Collection.upgrade(spark, str(tmp_path / "c"))
    assert any("format_version" in x for x in changes)
    store.Collection.upgrade(spark, str(tmp_path / "c"), apply=True)
    assert store.Collection(spark, str(tmp_path / "c")).dtype == "float32"


def test_ndjson(spark, tmp_path):
    texts = ['"q"', "a\nb\t", "\\", "漢字", "é", "http://x/?a=b"]
    c = store.Collection(spark, str(tmp_path / "c"), 4)
    c.put_batch(spark.createDataFrame([([1.0, 0.0, 0.0, float(i)], t, "") for i, t in enumerate(texts * 5)], "vector array<float>, text string, ts string"))
    ndjson.write_ndjson(c.rows(), str(tmp_path / "out"), single=True)
    path = next(str(p) for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    to, mark = store.Collection(spark, str(tmp_path / "d"), 4), str(tmp_path / "mark")
    lines = open(path).read().splitlines()
    (tmp_path / "ten").write_text("\n".join(lines[:10]) + "\n")
    assert ndjson.import_ndjson(to, str(tmp_path / "ten"), 4, mark) == 10
    assert ndjson.import_ndjson(to, path, 8, mark, resume=True) == 20
    assert ndjson.import_ndjson(to, path, 8, mark, resume=True) == 0
    assert [r["text"] for r in to.rows().orderBy("id").collect()] == texts * 5
    (tmp_path / "bad").write_text(lines[0] + "\n\n{bad\n")
    assert ndjson.read_ndjson(spark, str(tmp_path / "bad"), 4, strict=False).count() == 1
    with pytest.raises(Exception):
        ndjson.read_ndjson(spark, str(tmp_path / "bad"), 4).collect()
    with pytest.raises(ValueError):
        ndjson.export_range(c.rows(), 5, 3)


def test_streaming_is_exactly_once(spark, tmp_path):
    c = filled(spark, tmp_path / "c", 6)
    ndjson.write_ndjson(c.rows(), str(tmp_path / "in"))
    to = store.Collection(spark, str(tmp_path / "d"), 4)
    ingest.ingest(spark, str(tmp_path / "in"), to, str(tmp_path / "checkpoint"))
    import shutil

    shutil.rmtree(tmp_path / "checkpoint")  # all progress lost: the batch is replayed under its number
    ingest.ingest(spark, str(tmp_path / "in"), to, str(tmp_path / "checkpoint"))
    assert to.rows().count() == 6


def test_file_index(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"a.py": "print(1)\n", "b.md": "# B\n\ntext", "skip.log": "x", "sub/c.py": "c = 1", "sub/secret.py": "s", "node_modules/d.py": "d", ".git/info/exclude": "", ".gitignore": "*.tmp.py\n/sub/secret.py\n", "z.tmp.py": "z"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    found = [os.path.relpath(p, root) for p, _, _ in files.walk(str(root))]
    assert found == ["a.py", "b.md", "sub/c.py"]
    c = store.Collection(spark, str(tmp_path / "c"), 32, "cosine")
    read = lambda names: spark.createDataFrame([(n, 1, len(t), t) for n, t in names.items()], "path string, mtime_ms bigint, size bigint, text string")
    empty = spark.createDataFrame([], files.MANIFEST)
    e = embed.hashing_embedder(32)
    m, s = files.index_files(c, read({"a.py": "alpha", "b.md": "# beta\n\ntext"}), empty, e)
    m = spark.createDataFrame(m.collect(), files.MANIFEST)
    assert c.count_live() == 2 and {r["status"]: r["n_files"] for r in s.collect()} == {"new": 2}
    m2, s = files.index_files(c, read({"a.py": "alpha changed", "b.md": "# beta\n\ntext"}), m, e)
    m2 = spark.createDataFrame(m2.collect(), files.MANIFEST)
    assert c.count_live() == 2 and c.count() == 3
    files.index_files(c, read({"b.md": "# beta\n\ntext"}), m2, e)[0].collect()
    assert [r["text"] for r in c.rows().collect()] == ["[file:b.md][chunk:1/1] # beta\n\ntext"]
    assert files.Ignore("*.log\n!keep.log\nbuild/\n").ignores("a/b.log", False)
    assert not files.Ignore("*.log\n!keep.log\n").ignores("keep.log", False)
    assert files.Ignore("build/").ignores("build/x/y", False) and not files.Ignore("build/").ignores("build", False)
    with pytest.raises(ValueError):
        files.confined("/etc/passwd", [str(root)])


def test_windows_on_a_stream(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 01:10:00", "b", 4.0)], "event_id bigint, ts string, event_type string, value double")
    w = ingest.tumbling(d).orderBy("window_start").collect()
    assert [(r["n"], r["total"]) for r in w] == [(2, 3.0), (1, 4.0)]
    assert ingest.dedup_stream(d.unionByName(d), "event_id").count() == 3
    assert d.select(F.col("ts")).count() == 3


@pytest.mark.parametrize("name", ["ndjson_roundtrip", "stream_ingest"])
def test_queries_write_whole_texts(spark, tmp_path, monkeypatch, name):
    from lodevec.plans import registry
    from lodevec.sources import ndjson
    from tests.conftest import SF

    monkeypatch.setattr(registry, "_folder", lambda spark: f"file://{tmp_path}/{name}")
    registry.QUERIES[name](spark, SF).count()
    at = f"file://{tmp_path}/{name}"
    got = store.Collection(spark, at + "/collection", 64).rows() if name == "stream_ingest" else ndjson.read_ndjson(spark, at, 64)
    texts = [r["text"] for r in registry.corpus(spark, SF).select("text").collect()]
    assert sorted(r["text"] for r in got.select("text").collect()) == sorted(texts) and max(map(len, texts)) > 100
