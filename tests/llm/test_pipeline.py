"""The pipeline's stages at sf0.001, each against brute force on its own input."""

import collections
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodevec.llm import neardup, toxicity
from tests.llm.test_forest import batches_of_60, blobs, exact, hub_and_outsider  # noqa: F401
from tests.llm.test_small_operators import lines_by_force, pairs_by_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.toPandas())
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(at / str(i)))
        docs = spark.read.parquet(str(at / str(i)))
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    for s in stages[1:-1]:
        assert list(s.columns) == list(stages[0].columns)
        assert (s.n_chars == s.text.str.len()).all()


def test_toxic_go(spark, stages):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    of = toxicity.scorer(*toxicity.train(docs, labels))
    keep = {i for i, t in zip(stages[0].doc_id, stages[0].text) if of(t)[0] < 0.5}
    assert set(stages[1].doc_id) == keep
    y = pd.read_parquet(f"{SF}/labels.parquet")
    assert (y[y.toxic == 0].doc_id.isin(keep)).mean() > 0.95


def test_lines(stages):
    rows = sorted(zip(stages[1].doc_id, stages[1].text))
    want = {k: t for k, (_, n, t) in lines_by_force(rows).items() if not n or t.strip()}
    assert dict(zip(stages[2].doc_id, stages[2].text)) == want


def test_near_copies(stages):
    rows = sorted(zip(stages[2].doc_id, stages[2].text))
    texts = list(dict.fromkeys(t for _, t in rows))
    up = {t: t for t in texts}

    def find(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, j in pairs_by_force(texts):
        up[find(texts[i])] = find(texts[j])
    want = {}
    for k, t in rows:
        want.setdefault(find(t), k)
    assert sorted(stages[3].doc_id) == sorted(want.values())


def test_a_copy_of_one_that_does_not_lead_its_batch_goes(spark, batches_of_60, monkeypatch):  # noqa: F811
    """60 copies of a page in one batch and one of the next, which is near one of them only; labels and sketches as unlucky as can be."""
    page = [f"w{i}" for i in range(42)]
    near = [f"a{i}" for i in range(6)] + page[6:]
    texts = [page, near, *(page[:20] + [f"x{i}"] + page[21:] for i in range(58)), near[:32] + [f"b{i}" for i in range(10)]]
    texts = [" ".join(t) for t in texts]
    link = exact(texts)
    assert link[0, 1:60].all() and np.flatnonzero(link[60]).tolist() == [1]
    sig = spark.createDataFrame(list(enumerate(blobs(np.full((61, neardup.TREES), 5, np.uint64), hub_and_outsider(60)))), "doc_id bigint, sig binary")
    classes = neardup.classes

    def crafted(*args):
        d = classes(*args)
        d = d.drop("sig", "node").join(sig, "doc_id").orderBy("doc_id").coalesce(1)
        return d.withColumn("node", F.monotonically_increasing_id())

    monkeypatch.setattr(neardup, "classes", crafted)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()] == [(0, texts[0], "en", "s", len(texts[0]))]


def test_a_copy_that_meets_its_like_in_no_subtree_goes(spark, monkeypatch):
    """Two pages much alike, with labels that share no prefix in any tree, and one unlike both."""
    page = [f"w{i}" for i in range(60)]
    texts = [" ".join(t) for t in (page, [*page[:30], "x", *page[31:]], [f"y{i}" for i in range(60)])]
    assert exact(texts).sum() == 2
    apart = np.arange(3, dtype=np.uint64)[:, None] << np.uint64(neardup.BITS * (neardup.DEPTH - 1))
    sig = spark.createDataFrame(list(enumerate(blobs(np.repeat(apart, neardup.TREES, axis=1), np.zeros((3, 4), np.uint64)))), "doc_id bigint, sig binary")
    classes = neardup.classes
    monkeypatch.setattr(neardup, "classes", lambda *args: classes(*args).drop("sig").join(sig, "doc_id"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 2]


def test_mix(stages):
    import re

    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    before, after = stages[3], stages[4]
    size = before.groupby("source").text.apply(lambda s: sum(map(n, s)))
    took = after.groupby("source").text.apply(lambda s: sum(map(n, s)))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size.index))}
    target, left, free = {}, 1.5 * size.sum(), set(size.index)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= over
    assert all(abs(took.get(s, 0) - target[s]) <= 0.5 for s in target)
    original = dict(zip(before.doc_id, before.text))
    copies = collections.Counter(after.doc_id)
    assert max(copies.values()) <= 2
    assert all(original[i].startswith(t) for i, t in zip(after.doc_id, after.text))
    assert sum(original[i] != t for i, t in zip(after.doc_id, after.text)) <= len(size)


def test_packed(stages):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs, got = stages[4], stages[5]
    want = collections.Counter()
    for k, x in zip(docs.doc_id, docs.text):
        ids = t.encode(x, add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[k, j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_run_gives_the_last_stage(spark, stages):
    r = corpus_pipeline.run(spark, SF)
    assert r.count() == len(stages[-1]) and corpus_pipeline.ORACLE_SQL is None
