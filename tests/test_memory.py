import gc
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodevec import __main__ as cli
from lodevec.functions import text as T
from lodevec.plans.memory import Memory
from lodevec.sources import embed


def test_memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "root"), dim=128)
    m.index("the cat sat on the mat", "pets", tags={"kind": "cat", "n": 1})
    m.index(spark.createDataFrame([("a dog barks loudly",), ("python async programming",)], "text string"), "pets")
    hit = m.search("cat on a mat", "pets", 1).first()
    assert hit["text"] == "the cat sat on the mat" and hit["rank"] == 1
    assert m.search("dog", "pets", 3, wanted={"kind": "cat"}).count() == 1
    assert m.search("python async", "pets", 3, hybrid=True).first()["text"] == "python async programming"
    m.index("other", "notes")
    assert m.namespaces() == ["notes", "pets"]
    assert {r["ns"] for r in m.recall("cat", {"pets": 2, "notes": 1}).collect()} == {"pets", "notes"}
    assert m.forget("pets", query="cat on the mat") == 1 and m.info("pets").first()["count_live"] == 2
    with pytest.raises(ValueError):
        m.forget("pets")
    with pytest.raises(Exception):
        m.index("bad\x00text", "pets")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def alpha(): pass\n")
    (tmp_path / "src" / "b.md").write_text("# Beta\n\nsome text")
    assert {r["status"]: r["n_files"] for r in m.index_files(str(tmp_path / "src"), "code").collect()} == {"new": 2}
    assert {r["status"]: r["n_files"] for r in m.index_files(str(tmp_path / "src"), "code").collect()} == {"unchanged": 2}
    (tmp_path / "src" / "b.md").unlink()
    assert {r["status"]: r["n_files"] for r in m.index_files(str(tmp_path / "src"), "code").collect()} == {"unchanged": 1, "removed": 1}
    assert m.info("code").first()["count_live"] == 1 and m.namespaces() == ["code", "notes", "pets"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    v = tmp_path / "v.bin"
    np.array([1, 0, 0, 0.5, 9], "<f4").tofile(v)
    c = str(tmp_path / "c")

    def run(*args):
        monkeypatch.setattr("sys.argv", ["lodevec", *map(str, args)])
        code = cli.main()
        return code, capsys.readouterr().out

    assert run("put", c, v, "--dim", 4, "--text", "hello", "--metric", "cosine")[1].strip() == "0"
    assert '"text":"hello"' in run("search", c, v)[1]
    assert '"metric":"cosine"' in run("info", c)[1]
    assert run("doctor", c)[0] == 0
    assert "collection-snapshot" in run("snapshot", c, tmp_path / "s")[1]
    assert '"count":1' in run("restore", tmp_path / "s", tmp_path / "r")[1]
    run("export", c, tmp_path / "out")
    assert '"count_live":1' in run("compact", c, tmp_path / "d")[1]
    assert run("delete", c, 0)[1].strip() == "1"
    assert '"changes": []' in run("upgrade", c)[1]


def _most_python(f, *args):
    """MB of Python objects at most while f runs, and what it returns; Arrow's memory isn't among them."""
    gc.collect()
    tracemalloc.start()
    try:
        out = f(*args)
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


def test_an_arrow_batch_is_not_python_objects_at_once(spark):
    """Texts of 20 MB come in one Arrow batch; an embedder and the normal form take a few at a time."""
    words = ["x" * 2000 + str(i) for i in range(10_000)]
    most, got = _most_python(embed.provider(lambda t: [[float(len(x)), 1.0] for x in t], 2).func, pa.array([*words, None]))
    assert most < 4 and got.to_pylist() == [*([float(len(w)), 1.0] for w in words), [0.0, 1.0]]
    texts = pa.array([None, *words, "e" + chr(0x301)] * 2)
    most, got = _most_python(T.normal, texts)
    assert most < 4 and got.equals(pa.array([None, *words, chr(0xE9)] * 2))
    assert T.normal(texts[:0]).to_pylist() == []


def test_ascii_texts_stay_out_of_python(spark):
    texts = [None, "", "plain", "e" + chr(0x301), "plain too", chr(0xE9), "line\n"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2).select("id", T.nfc(F.col("t")).alias("n"))
    assert [r["n"] for r in d.orderBy("id").collect()] == [None, "", "plain", chr(0xE9), "plain too", chr(0xE9), "line\n"]
    asked = next(x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in x)
    assert asked.split("udf(", 1)[1].startswith("CASE WHEN NOT RLIKE(")
