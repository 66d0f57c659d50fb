"""The forest of the n-gram Jaccard join: prefixes, hot subtrees, recall against brute force."""

import collections
import random

import numpy as np
import pytest

from lodevec.llm import neardup
from lodevec.llm.common import byte_codes


def exact(texts, n=3, threshold=0.5):
    """Matrix of links between texts, by shingle sets."""
    sets, number = [], {}
    for t in texts:
        w = t.lower().split()
        sets.append(sorted({number.setdefault(tuple(w[i : i + n]), len(number)) for i in range(max(1, len(w) - n + 1))}))
    m = np.zeros((len(texts), len(number)), np.float32)
    for row, s in zip(m, sets):
        row[s] = 1
    both, own = m @ m.T, m.sum(axis=1)
    link = both >= threshold * (own[:, None] + own[None, :] - both) - 1e-9
    np.fill_diagonal(link, False)
    return link


def templated(n, seed=1, words=40, most=7):
    """Pages of one template: every one has some of its words replaced, so that many pairs lie just around the threshold."""
    rng = random.Random(seed)
    base, other = [f"w{i}" for i in range(words)], [f"x{i}" for i in range(60)]
    out = set()
    while len(out) < n:
        w = list(base)
        for i in rng.sample(range(words), rng.randint(2, most)):
            w[i] = rng.choice(other)
        out.add(" ".join(w))
    return sorted(out)


def test_depth_follows_what_was_measured():
    assert neardup.matched_depth({}) == 4  # theory alone
    assert neardup.matched_depth({6: 100_000}) == 6
    assert neardup.matched_depth({6: 50_000, 5: 46_000, 4: 4000}) == 5
    assert neardup.matched_depth({4: 90_000, 3: 10_000}) == 3
    assert neardup.matched_depth({0: 100_000}) == 1


def test_partners_lie_at_the_threshold_and_meet_as_often_as_theory_says():
    rng = random.Random(3)
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    met = collections.Counter()
    for k in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        a, b = grams(words), grams(neardup.partner(words, 3, 0.5, k))
        assert 0.5 <= len(a & b) / len(a | b) < 0.6
        met[neardup.measure(" ".join(words), k, byte_codes(True), 3, 0.5, neardup.TREES)] += 1
    assert 0.92 < sum(v for d, v in met.items() if d >= 4) / 400 <= 1
    assert sum(v for d, v in met.items() if d >= 6) / 400 < 0.8
    assert neardup.measure("too short", 1, byte_codes(True), 3, 0.5, 8) is None


def test_labels_are_sorted_prefixes():
    sig = np.random.default_rng(2).integers(0, 1 << 32, (3, 4 * neardup.DEPTH), dtype=np.uint64).astype(np.uint32)
    sig[1], sig[2] = sig[0], sig[0]
    sig[1, 3], sig[2, neardup.DEPTH + 5] = 1, 1  # value 3 of tree 0, value 5 of tree 1
    x = neardup.labels(sig, 4)
    same = lambda t, i, d: x[0, t] >> np.uint64(neardup.BITS * (neardup.DEPTH - d)) == x[i, t] >> np.uint64(neardup.BITS * (neardup.DEPTH - d))
    assert same(0, 1, 3) and not same(0, 1, 4) and same(1, 2, 5) and not same(1, 2, 6) and same(2, 1, 6)


def groups(f, n):
    return [f.find(i) for i in range(n)]


@pytest.mark.parametrize("n", [40, 400])
@pytest.mark.parametrize("noise", [0.05, 0.3, 0.45])
def test_components_of_a_subtree_are_those_of_all_pairs(n, noise):
    rng = np.random.default_rng(n)
    cells = rng.integers(0, 4, (3, 128))[rng.integers(0, 3, n)]
    change = rng.random(cells.shape) < noise
    cells[change] = rng.integers(0, 4, change.sum())
    e = np.zeros(n, neardup.ENTRY)
    e["node"], e["key"] = np.arange(n), 5
    e["sketch"] = (cells.reshape(n, 4, 32).astype(np.uint64) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64)
    least = neardup.least_alike()
    got, want = neardup.Forest(), neardup.Forest()
    neardup.link_entries(e, got, least)
    u, v = np.nonzero(neardup.alike(e["sketch"][:, None, :], e["sketch"][None, :, :]) >= least)
    want.link(u, v)
    assert groups(got, n) == groups(want, n)
    lead = neardup.leaders(e, least)
    assert (neardup.alike(e["sketch"][:, None, :], e["sketch"][lead][None, :, :]) >= least).any(axis=1).all()


def test_the_gate_passes_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (20_000, 128))
    b = np.where(rng.random(a.shape) < 0.5, a, rng.integers(0, 4, a.shape))
    same = (a == b).sum(axis=1)
    assert (same >= neardup.least_alike()).all()


@pytest.mark.parametrize("parts,pages", [(1, 3000), (25, 10_000)])
def test_hot_subtrees_of_several_batches_lose_no_link(spark, parts, pages):
    """Thousands of pages of one template in one or many batches, and loose pairs beside them."""
    texts = templated(pages)
    link = exact(texts)
    assert 0.02 < link.mean() < 0.9
    rng = random.Random(8)
    loose = [[f"v{rng.randrange(9000)}" for _ in range(120)] for _ in range(300)]
    near = [" ".join(neardup.partner(w, 3, 0.5, i)) for i, w in enumerate(loose)]
    rows = texts + [" ".join(w) for w in loose] + near
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(parts)
    got = {r["doc_id"]: r for r in neardup.near_dups(d).collect()}
    assert len(got) == len(rows)
    links = np.array([got[i]["n_links"] for i in range(len(texts))])
    assert (links <= link.sum(axis=1)).all() and links.sum() >= 0.99 * link.sum()
    pairs = sum(got[pages + i]["n_links"] == 1 == got[pages + 300 + i]["n_links"] and got[pages + i]["class_id"] == got[pages + 300 + i]["class_id"] for i in range(300))
    assert pairs / 300 >= 0.93  # pairs at the threshold itself: 0.96 expected


def test_of_equal_rows_that_differ_elsewhere_one_stays_whole(spark):
    rows = [(1, "a b c d", "en", "x"), (1, "a b c d", "de", "y"), (1, "a b c d", "de", "x"), (2, None, "fr", "z"), (2, "", None, "z")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for k in (1, 4):
        got = [tuple(r) for r in neardup.drop_near_dups(d.repartition(k)).collect()]
        assert sorted(got) == [(1, "a b c d", "de", "x"), (2, "", None, "z")]


def hub_and_outsider(n):
    """Sketches as cells: 0 is like all up to n - 1, which are unlike one another; the last, n, is like 1 only."""
    rng = np.random.default_rng(4)
    cells = rng.integers(0, 4, (n + 1, neardup.CELLS))
    cells[1:n, :60] = cells[0, :60]
    cells[n, 60:], cells[n, :60] = cells[1, 60:], (cells[0, :60] + 1) % 4
    return packed(cells)


def packed(cells):
    return (cells.reshape(len(cells), 4, 32).astype(np.uint64) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64)


def blobs(labels, sketches):
    return [r.astype("<u8").tobytes() for r in np.hstack([labels, sketches])]


def small_batches(spark, rows):
    """One partition, read in batches of so many rows while the generator is open."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    yield
    spark.conf.set(key, before)


@pytest.fixture
def batches_of_60(spark):
    yield from small_batches(spark, 60)


def roots(edges, n):
    f = neardup.Forest()
    got = edges.toPandas()
    f.link(got.a.to_numpy(), got.b.to_numpy())
    return groups(f, n)


@pytest.mark.parametrize("bounds", [{}, {"most": 10, "look": 1}])
def test_an_entry_like_one_that_does_not_lead_its_batch_is_linked(spark, batches_of_60, bounds):
    """60 texts of one batch share all labels with one of the next batch, which is like a single one of them."""
    s = hub_and_outsider(60)
    like = neardup.alike(s[:, None, :], s[None, :, :]) >= neardup.least_alike()
    assert like[0, :60].all() and np.flatnonzero(like[60]).tolist() == [1, 60]
    rows = list(enumerate(blobs(np.full((61, 2), 5, np.uint64), s)))
    one = spark.createDataFrame(rows, "node bigint, sig binary").coalesce(1)
    assert roots(neardup.candidates(one, 4, 2, **bounds), 61) == [0] * 61


@pytest.mark.parametrize("bounds", [{}, {"most": 10, "look": 1}, {"most": 100, "look": 2}])
def test_candidates_are_linked_like_all_pairs_that_share_a_prefix(spark, batches_of_60, bounds):
    """Loosely like texts, most on one label of a tree, in batches and blocks: components are those of all pairs."""
    rng = np.random.default_rng(6)
    cells = rng.integers(0, 4, (40, neardup.CELLS))[rng.integers(0, 40, 500)]
    change = rng.random(cells.shape) < 0.45
    cells[change] = rng.integers(0, 4, change.sum())
    s, labels = packed(cells), (rng.random((500, 3)) < 0.1).astype(np.uint64) << np.uint64(neardup.BITS * 2)
    share = (labels[:, None, :] == labels[None, :, :]).any(axis=2)
    u, v = np.nonzero(share & (neardup.alike(s[:, None, :], s[None, :, :]) >= neardup.least_alike()))
    want = neardup.Forest()
    want.link(u, v)
    assert 10 < len(set(groups(want, 500))) < 490
    one = spark.createDataFrame(list(enumerate(blobs(labels, s))), "node bigint, sig binary").coalesce(1)
    assert roots(neardup.candidates(one, 4, 3, **bounds), 500) == groups(want, 500)


def at_the_threshold(n=300):
    loose = [[f"v{random.Random(k).randrange(9000)}{k % 7}.{i}" for i in range(120)] for k in range(n)]
    return [" ".join(w) for w in loose], [" ".join(neardup.partner(w, 3, 0.5, i)) for i, w in enumerate(loose)]


@pytest.mark.parametrize("forest", ["as it is", "meets nothing"])
def test_no_link_is_lost_that_the_forest_misses(spark, forest, monkeypatch):
    """Pairs at the threshold, pages of a template, and texts of stock sentences, of few words or of none: links are those of brute force."""
    if forest == "meets nothing":
        monkeypatch.setattr(neardup, "candidates", lambda one, *_: spark.createDataFrame([], "a long, b long"))
    rng = random.Random(2)
    stock = [" ".join(f"s{k}.{i}" for i in range(9)) for k in range(12)]
    texts = [*templated(300), *(" ".join(rng.sample(stock, 6)) for _ in range(200)), "a", "a b", "A  b", "b a", "a b c", "a b c d", " ", ""]
    texts = list(dict.fromkeys([x for pair in zip(*at_the_threshold()) for x in pair] + texts))
    link = exact(texts)
    link[[not t.strip() for t in texts]] = False
    link[:, [not t.strip() for t in texts]] = False
    got = {r["doc_id"]: r for r in neardup.near_dups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == link.sum(axis=1).tolist()
    f = neardup.Forest()
    f.link(*np.nonzero(link))
    assert [got[i]["class_id"] for i in range(len(texts))] == groups(f, len(texts))


@pytest.mark.parametrize("bounds", [{}, {"most": 5, "look": 1}, {"look": 3}])
def test_pairs_across_groups_hold_all_at_the_threshold(spark, bounds, monkeypatch):
    """Hot shingles cut into blocks, orders from samples, pairs counted few at a time."""
    monkeypatch.setattr(neardup, "PAIRS", 100)
    texts = templated(120) + [x for t in at_the_threshold(40) for x in t]
    u, v = np.nonzero(np.triu(exact(texts)))
    root = [i % 50 for i in range(len(texts))]
    d = spark.createDataFrame([(r, i, t) for i, (r, t) in enumerate(zip(root, texts))], "root bigint, node bigint, text string").repartition(3)
    got = [(r["a"], r["b"]) for r in neardup.across(d, **bounds).collect()]
    assert len(got) == len(set(got)) and all(root[a] != root[b] for a, b in got)
    assert {(a, b) for a, b in zip(u.tolist(), v.tolist()) if root[a] != root[b]} <= {(min(p), max(p)) for p in got}


@pytest.mark.parametrize("sizes", [(1, 1), (5, 9), (300, 310), (300, 599), (40, 700)])
def test_outlines_bound_what_two_sets_share(sizes):
    rng = np.random.default_rng(sum(sizes))
    for both in range(0, min(sizes) + 1, max(1, min(sizes) // 10)):
        h = np.unique(rng.integers(0, 1 << 64, 2 * sum(sizes), dtype=np.uint64))
        rng.shuffle(h)
        a, b = h[: sizes[0]], np.append(h[:both], h[sizes[0] : sizes[0] + sizes[1] - both])
        most = neardup.most_shared(len(a), neardup.outline(a), len(b), neardup.outline(b))
        assert most == neardup.most_shared(len(b), neardup.outline(b), len(a), neardup.outline(a))
        assert both <= most
        assert most <= both + 0.25 * (min(sizes) - both) + 3 or max(sizes) > 2 * min(sizes)  # sizes that the threshold allows


def test_rows_among_nodes_are_found_by_bits(spark):
    some = [0, 7, 32767, 32768, 5 << 33, (5 << 33) + 40_000]
    d = spark.createDataFrame([(x + y,) for x in some for y in (0, 1)], "node long")
    for nodes in (some, []):
        held = neardup.among(spark.createDataFrame([(x,) for x in nodes], "node long"))
        got = sorted(r["node"] for r in d.distinct().mapInArrow(held, "node long").collect())
        assert got == sorted(nodes)


def shuffled(spark, work):
    """Bytes that the stages of some work write to be shuffled, and its result."""
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    sc.setJobGroup("shuffled", "")
    before = set(sc.statusTracker().getJobIdsForGroup("shuffled"))
    got = work()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in set(sc.statusTracker().getJobIdsForGroup("shuffled")) - before for s in sc.statusTracker().getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages), got


def test_texts_are_shuffled_once_and_unlike_pairs_are_not_verified(spark, monkeypatch, tmp_path):
    """Long texts with stock passages: many meet in their prefixes, few are at the threshold, none by the forest."""
    monkeypatch.setattr(neardup, "candidates", lambda one, *_: spark.createDataFrame([], "a long, b long"))
    rng = random.Random(5)
    stock = [[f"s{k}.{i}" for i in range(500)] for k in range(6)]
    own = [stock[k % 6] + [f"{rng.randrange(1 << 40):x}" for _ in range(600)] for k in range(240)]
    texts = [" ".join(w) for w in own] + [" ".join(neardup.partner(own[0], 3, 0.5, 1))]
    link, verified, verify = exact(texts), [], neardup.verify
    monkeypatch.setattr(neardup, "verify", lambda m, *how: verified.append(m) or verify(m, *how))
    path = f"file://{tmp_path}/in"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).write.parquet(path)
    size, keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(neardup, "unstage", keep.append)
    try:
        moved, got = shuffled(spark, lambda: {r["doc_id"]: r["n_links"] for r in neardup.near_dups(spark.read.parquet(path)).collect()})
        pairs = verified[1].count() // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert [got[i] for i in range(len(texts))] == link.sum(axis=1).tolist() and link.any()
    assert moved < 2 * sum(map(len, texts)) and pairs <= link.sum()
