"""Every opN_ query on the whole of sf0.001: columns, types, and rows against brute force."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodevec.llm import pii, queries
from tests.llm.test_small_operators import pairs_by_force, repeats_by_force

SF = "/root/testdata/sf0.001"
FIRST = {
    "op1_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_collision_knn": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_repeated_substrings": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_line_dedup": "doc_id bigint, n_lines int, n_removed int, kept_text string",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_pii": "doc_id bigint, text string",
    "op10_ngram_jaccard": "doc_id bigint, class_id bigint",
}


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    return [(int(k), t or "") for k, t in zip(d.doc_id, d.text)]


@pytest.fixture(scope="module")
def run(spark):
    done = {}

    def rows(name):
        if name not in done:
            df = queries.QUERIES[name](spark, SF)
            kinds = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]
            want = FIRST[name].split(", ")
            assert kinds[: len(want)] == want
            done[name] = df.toPandas()
        return done[name]

    return rows


def test_every_query_is_here():
    assert set(FIRST) == set(queries.QUERIES)


def test_op1(run, docs):
    got = {r.doc_id: r for r in run("op1_fingerprints").itertuples()}
    assert len(got) == len(docs) == len(run("op1_fingerprints"))
    grams = lambda t: {t[i : i + 12] for i in range(max(1, len(t) - 11))} if t else set()
    off = []
    for i, (k, t) in enumerate(docs):
        n = docs[(i + 1) % len(docs)][1]
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        for x, near in ((e, r.near_edited), (n, r.near_next)):
            a, b = grams(t), grams(x)
            off.append(near - (len(a & b) / len(a | b) if a and b else float(not a and not b)))
    assert np.abs(off).max() < 0.25 and abs(np.mean(off)) < 0.01 and np.std(off) < 0.05
    by = collections.defaultdict(set)
    for k, t in docs:
        by[t].add(got[k].fingerprint)
    assert all(len(f) == 1 for f in by.values())


def test_op2(run):
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    got = run("op2_collision_knn")
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        i = int(np.flatnonzero(ids == q)[0])
        s = x @ x[i]
        s[i] = -np.inf
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, [s[np.flatnonzero(ids == v)[0]] for v in g.vec_id], atol=1e-12)
        assert all(a > b or a == b and v < w for a, b, v, w in zip(g.score, g.score[1:], g.vec_id, g.vec_id[1:]))
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(g.vec_id))
    assert hit / len(got) >= 0.9


@pytest.mark.parametrize("name,label,least", [("op3_toxicity", "toxic", 0.5), ("op6_quality", "quality", 0.3)])
def test_op3_op6(run, docs, name, label, least):
    got = run(name).set_index("doc_id")
    assert sorted(got.index) == [k for k, _ in docs]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == int(r.score >= least) and 0 <= r.score <= 1 for k, r in got.iterrows())
    by = collections.defaultdict(set)  # nothing but the text decides
    for k, t in docs:
        by[t].add(got.score[k])
    assert all(len(s) == 1 for s in by.values())
    y = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")[label]
    held = [k for k in y.index if k in got.index and got.held_out[k]]
    assert np.mean([got.predicted[k] == y[k] for k in held]) >= 0.85


def test_op4(run, docs):
    truth = repeats_by_force(docs, 100)
    text = dict(docs)
    got = run("op4_repeated_substrings")
    assert len(got) == len(docs)
    assert all(tuple(r)[1:] == truth[r.doc_id, text[r.doc_id]] for r in got.itertuples(index=False))


def test_op5_op8(run):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name in ("op5_line_dedup", "op8_source_mix"):
        got = run(name)
        want = con.execute(queries.ORACLES[name]).df()[list(got.columns)]
        key = lambda d: collections.Counter(tuple(None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in d.itertuples(index=False))
        assert key(got) == key(want)


def test_op7(run, docs):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for k, x in docs:
        ids = t.encode(x, add_special_tokens=False).ids + [0]
        cut = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        ends = [*range(cut, len(ids), 2048), len(ids)]
        for j, (a, b) in enumerate(zip([0, *ends], ends)):
            want[k, j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = run("op7_best_fit_packing")
    assert collections.Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.02 + 1


def test_op9(run, docs):
    got = run("op9_pii").set_index("doc_id")
    assert sorted(got.index) == [k for k, _ in docs]
    changed = 0
    for k, t in docs:
        assert pii.restore(got.text[k]) == t
        changed += got.text[k] != t
        assert (got.text[k] != t) == (got.n_found[k] > 0) and len(re.findall("@", got.text[k])) == len(re.findall("@", t))
    assert changed > 0


def test_op10(run, docs):
    texts = sorted({t for _, t in docs})
    up = {t: t for t in texts}

    def find(t):
        while up[t] != t:
            t = up[t]
        return t

    links = collections.Counter()
    for i, j in pairs_by_force(texts):
        links[texts[i]] += 1
        links[texts[j]] += 1
        up[find(texts[i])] = find(texts[j])
    least = {}
    for k, t in docs:
        least.setdefault(find(t), k)
    got = run("op10_ngram_jaccard")
    assert sorted(got.doc_id) == [k for k, _ in docs]
    text = dict(docs)
    assert all(r.class_id == least[find(text[r.doc_id])] and r.n_links == links[text[r.doc_id]] for r in got.itertuples())
