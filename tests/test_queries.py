"""Every registered query of the library runs and agrees with its SQL at sf0.001."""

import collections

import duckdb
import pytest

import __spark_entry__
from lodevec.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = collections.Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in registry.ORACLES:
        rel = con.execute(registry.ORACLES[name])
        cols = [x[0] for x in rel.description]
        assert sorted(cols) == sorted(df.columns)
        at = [cols.index(c) for c in sorted(cols)]
        assert got == collections.Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["chunk_chars", "chunk_clamped"])
def test_windows_of_odd_texts(spark, tmp_path, name):
    """No text, blank texts, and blanks that SQL's \\s doesn't name agree with the SQL, too."""
    blanks = "".join(map(chr, [0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0xFEFF, 0x85, 11, 28, 31, 0]))
    texts = [None, "", " ", "\t\r\n\f ", *blanks, blanks, f" {blanks} ", *(f"{b} x{b}" for b in blanks), *(f" {b}x {b} " for b in blanks)]
    texts += [" " * 2000, " " * 799 + "x" + " " * 900, " " * 900 + chr(0xA0) + " " * 900, " " * 700 + "y" * 101, "é " * 900, "\U0001f469" + chr(0x200D) + "\U0001f680e" + chr(0x301) + " x" * 900]
    texts += ["a b " * n for n in (27, 32, 33, 59, 175, 200, 201, 375, 376)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.execute(registry.ORACLES[name]).fetchall())
    got = sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == want
