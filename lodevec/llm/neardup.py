"""Operator 10, n-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts that are equal make a class, and only one of each class goes on. Its word 3-gram shingles
give a MinHash signature, which makes TREES labels of DEPTH values (BITS bits each, most
significant first). Sorted, a tree's labels are the leaves of a prefix trie; those that share the
first d values are a subtree, and their texts meet. d is shortened from DEPTH until the measured
recall at the threshold reaches TARGET (`matched_depth`): while signatures are made, every text
whose hash falls on 1 in SAMPLE gets a partner of known Jaccard index, just above the threshold,
and the longest prefix at which the two meet in some tree is counted.

Texts that meet by chance are kept apart by a sketch of 128 cells, which a pair at the threshold
passes with probability 1 - 1e-6 and unlike texts with 4e-6. Within a subtree the components of
all pairs that pass are found exactly (`link_entries`), whatever its size. What is linked there is
only joined into candidate groups, never listed as pairs. Within a candidate group every pair of
different texts is verified exactly by its shingle sets; groups too large for a task are cut into
blocks and every pair of blocks is a task, as the number of links of each text is wanted.

What the forest misses is found exactly (`across`): shingles are put in one order, those frequent
in a sample last, and two texts at the threshold share shingles within the prefixes of their sets.
Of texts of different candidate groups that meet there often enough for the threshold, bitmaps of
their shingles bound what they share (`possible`); the pairs that may still be at the threshold are
verified, too, so that no link is lost. The verified links' components are the near-duplicate groups; each
document gets its group, its class and how many other texts it links to.

Scale: all texts are shuffled once, to one row a class, and those of candidate groups again, for
verification; of pairs across groups, bitmaps of 1 to 2 bytes a shingle are shuffled, and the texts
of those pairs only that the bitmaps let pass. Which texts that takes is told to the tasks by bits
of their nodes, 4 KB for up to 32,768 texts. A forest entry is 48 bytes, sent in packed
blocks. All entries of a subtree go to its task, so that whatever shares a prefix meets, in whatever
batch it lies. A subtree of more than about BLOCK_ENTRIES entries is cut into blocks of so many by a
hash of the node, and every pair of blocks is linked for itself: a task is bounded and no pair is
left out. Which subtrees those are is counted over one text in LOOK; that decides only how the
work is cut, never what is linked. An entry of such a subtree is sent once per block. A prefix
entry is 4 bytes and its share of 24 a text and task; shingles of more than about BLOCK_ENTRIES
entries are cut into blocks likewise. Work there is quadratic in the texts of different groups that
share a shingle of their prefixes.

Cases: null text counts as empty; all empty or blank texts have no shingle and only equal texts of
them group; a text of fewer than 3 words is one shingle; a null doc_id may be in any group and is
never its id unless all are null; repeated rows are copies; other columns are ignored (near_dups)
or kept (drop_near_dups, where rows of one id and text that differ elsewhere are ordered by those
columns' JSON, and the first stays as it is).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import U64, byte_codes, components, mix, partitions, runs, shingle_hashes, stage, text_id, trimmed, unstage, utf8, word_hashes

N, THRESHOLD, TARGET, TREES, DEPTH, BITS = 3, 0.5, 0.95, 50, 6, 10
BLOCK_DOCS, BLOCK_CHARS, HOT = 1000, 8_000_000, 48
BLOCK_ENTRIES, LOOK, SENT = 50_000, 64, 500_000  # entries a block of a hot subtree, one text in LOOK shows which are hot, entries sent at once
CELLS = 128  # 2-bit cells of the sketch
SAMPLE, PRIOR = 64, 1000  # one text in SAMPLE is measured; PRIOR measurements' weight has the depth that theory gives
PAIR_WORDS = (20, 2000)  # lengths of the texts that measure
ORDERED, FREQUENT = 65_536, 1_000_000  # about so many texts at least show which shingles are frequent; at most so many of these are told apart
PAIRS = 500_000  # pairs counted at once


def least_alike(threshold: float = THRESHOLD) -> int:
    """Equal cells of the sketch that all but one in a million pairs at the threshold have (4.75 standard deviations below the mean)."""
    p = threshold + (1 - threshold) / 4
    return int(CELLS * p - 4.75 * (CELLS * p * (1 - p)) ** 0.5)


def matched_depth(met: dict[int, int], threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES) -> int:
    """The longest prefix with recall of the target: met[d] measured pairs met at a prefix of d values and no longer one."""
    n = sum(met.values())
    for d in range(DEPTH, 1, -1):
        hits = sum(c for k, c in met.items() if k >= d)
        if (hits + PRIOR * (1 - (1 - threshold**d) ** trees)) / (n + PRIOR) >= target:
            return d
    return 1


def _permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint64) | U64(1)).astype(np.uint32), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def signatures(raw: np.ndarray, offsets: np.ndarray, k: int, codes: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures (rows of k uint32) and which rows have any shingle."""
    a, b = _permutations(k)
    out = np.full((len(offsets) - 1, k), 0xFFFFFFFF, np.uint32)
    for i, j in runs(offsets, 1 << 18):
        words, counts = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], codes)
        h, have = shingle_hashes(words, counts, n)
        own = np.flatnonzero(have)
        if not len(own):
            continue
        h = (h >> U64(32)).astype(np.uint32)
        at = (np.cumsum(have) - have)[own]
        buffer = np.empty_like(h)
        for t in range(k):
            np.multiply(h, a[t], out=buffer)
            buffer += b[t]
            out[i + own, t] = np.minimum.reduceat(buffer, at)
    return out, (out != 0xFFFFFFFF).any(axis=1)


def labels(sig: np.ndarray, trees: int) -> np.ndarray:
    """Rows of `trees` labels: DEPTH values of BITS bits, the first most significant."""
    out = np.zeros((len(sig), trees), U64)
    for d in range(DEPTH):
        out = (out << U64(BITS)) | (mix(sig[:, d : trees * DEPTH : DEPTH].astype(U64) + U64(d + 1)) >> U64(64 - BITS))
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """Rows of 4 uint64: CELLS cells of 2 bits."""
    step = max(1, sig.shape[1] // CELLS)
    cells = mix(sig[:, : CELLS * step : step].astype(U64)) & U64(3)
    shift = (np.arange(32, dtype=U64) * U64(2))[None, None, :]
    return (cells.reshape(len(sig), 4, 32) << shift).sum(axis=2, dtype=U64)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal cells of sketches (rows of 4 uint64)."""
    x = a ^ b
    return np.bitwise_count(~(x | (x >> U64(1))) & U64(0x5555555555555555)).sum(axis=-1)


def partner(words: list[str], n: int, threshold: float, seed: int) -> list[str]:
    """The words with as many replaced as leave a Jaccard index of at least the threshold."""
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    own, order = grams(words), np.random.default_rng(seed).permutation(len(words))
    lo, hi, best = 0, len(words), words
    while hi - lo > 1:
        k = (lo + hi) // 2
        new = list(words)
        for i in order[:k]:
            new[i] = f"~{seed}.{i}"
        other = grams(new)
        if len(own & other) >= threshold * len(own | other):
            lo, best = k, new
        else:
            hi = k
    return best


def measure(text: str, seed: int, codes: np.ndarray, n: int, threshold: float, trees: int) -> int | None:
    """The longest prefix at which a text and its partner meet in some tree; None for a text too short or long to measure."""
    words = text.lower().split()
    if not PAIR_WORDS[0] <= len(words) <= PAIR_WORDS[1]:
        return None
    pair = [" ".join(words).encode(), " ".join(partner(words, n, threshold, seed)).encode()]
    sig, _ = signatures(np.frombuffer(b"".join(pair), np.uint8), np.array([0, len(pair[0]), len(pair[0]) + len(pair[1])]), trees * DEPTH, codes, n)
    a, b = labels(sig, trees)
    return max(sum(1 for d in range(1, DEPTH + 1) if x >> (BITS * (DEPTH - d)) == 0) for x in (a ^ b).tolist())


class Forest:
    """Union-find over arbitrary int64 labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def link(self, us, vs) -> None:
        for u, v in zip(us.tolist(), vs.tolist()):
            a, b = self.find(u), self.find(v)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        us = [u for u in self.up if self.find(u) != u]
        return us, [self.find(u) for u in us]


ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("sketch", "<u8", 4)])


def _groups(key: np.ndarray):
    """(start, size) of runs of equal keys."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


def link_entries(e: np.ndarray, found: Forest, least: int) -> None:
    """Links entries of equal key: the components of all pairs whose sketches are alike, exactly.

    Runs of up to HOT entries are compared all with all. In longer ones the component of an entry
    is grown: those not reached yet are compared with the newly reached, in blocks, so that a run
    of texts much alike takes few comparisons an entry.
    """
    if not len(e):
        return
    e = e[np.argsort(e["key"], kind="stable")]
    s = e["sketch"]
    start, size = _groups(e["key"])
    end = np.repeat(start + size, size)
    where = np.flatnonzero(np.repeat((size > 1) & (size <= HOT), size))
    lag = 1
    while len(where):
        where = where[where + lag < end[where]]
        hit = where[alike(s[where], s[where + lag]) >= least]
        found.link(e["node"][hit], e["node"][hit + lag])
        lag += 1
    for a, n in zip(start[size > HOT].tolist(), size[size > HOT].tolist()):
        left, nodes, run = np.arange(1, n), e["node"][a : a + n], s[a : a + n]
        edge, head = np.array([0]), 0
        while len(left):
            if not len(edge):
                head, left = left[0], left[1:]
                edge = np.array([head])
                continue
            now, edge = edge[: max(1, (1 << 17) // len(left))], edge[max(1, (1 << 17) // len(left)) :]
            hit = (alike(run[left][None, :, :], run[now][:, None, :]) >= least).any(axis=0)
            found.link(np.full(int(hit.sum()), nodes[head]), nodes[left[hit]])
            edge, left = np.append(edge, left[hit]), left[~hit]


def leaders(e: np.ndarray, least: int) -> np.ndarray:
    """Which entries of a run lead: every other one is alike to one of them."""
    free, lead = np.full(len(e), True), np.zeros(len(e), bool)
    while free.any():
        i = int(np.argmax(free))
        lead[i] = True
        free &= alike(e["sketch"], e["sketch"][i]) < least
        free[i] = False
    return lead


def keys(label: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    """What the labels of a subtree share: a hash of the tree and of the first `depth` values."""
    return mix((label >> U64(BITS * (DEPTH - depth))) + mix(tree + U64(64 * depth)))


def spread(e: np.ndarray, hot: np.ndarray, blocks: np.ndarray):
    """The entries of a batch as they are sent, in runs: those of the i-th hot key (sorted) lie in blocks[i] blocks by
    their nodes, and go to every pair of blocks with their own, which has a key of its own."""
    at = np.searchsorted(hot, e["key"])
    at[at == len(hot)] = 0
    n = np.where(hot[at] == e["key"], blocks[at], 1) if len(hot) else np.ones(len(e), np.int64)
    for i, j in runs(np.append(0, np.cumsum(n)), SENT):
        own, of = np.repeat(e[i:j], n[i:j]), np.repeat(n[i:j], n[i:j]).astype(U64)
        ends = np.cumsum(n[i:j])
        other = np.arange(len(own)) - np.repeat(ends - n[i:j], n[i:j])
        mine, other = mix(own["node"].astype(U64)) % of, other.astype(U64)
        pair = np.minimum(mine, other) * of + np.maximum(mine, other)
        own["key"] = np.where(of > 1, mix(own["key"] + mix(pair + U64(1))), own["key"])
        yield own


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, trees: int = TREES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per different text: node long, doc_id (least), copies, a, b (text id), sig binary (null without
    shingles), met int (of the texts that measure the forest's recall: see `measure`)."""
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("id", text_id(F.col("text"))).select("doc_id", "text", "id.a", "id.b")
    kind = d.select("doc_id", "a", "b").withColumns({"sig": F.lit(None).cast("binary"), "met": F.lit(None).cast("int")}).schema

    def run(batches):
        codes = byte_codes(True)
        for b in batches:
            raw, off = utf8(b.column("text"))
            sig, some = signatures(raw, off, trees * DEPTH, codes, n)
            rows = np.hstack([labels(sig, trees), sketches(sig)]).astype("<u8")
            blobs = pa.array([r.tobytes() if x else None for r, x in zip(rows, some)], pa.binary())
            hashes = b.column("b").to_numpy()
            met = [None] * b.num_rows
            for i in np.flatnonzero(hashes % SAMPLE == 0).tolist():
                met[i] = measure(b.column("text")[i].as_py(), abs(int(hashes[i])), codes, n, threshold, trees)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("a"), b.column("b"), blobs, pa.array(met, pa.int32())], ["doc_id", "a", "b", "sig", "met"])

    one = d.mapInArrow(trimmed(run), kind).groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("sig").alias("sig"), F.max("met").alias("met"))
    return one.withColumn("node", F.monotonically_increasing_id())


def _rows(b: pa.RecordBatch, trees: int) -> np.ndarray:
    """Labels and sketches of a batch's texts."""
    return utf8(b.column("sig"))[0].view("<u8").reshape(b.num_rows, trees + 4)


def hot_keys(some: DataFrame, depth: int, trees: int, most: int, look: int) -> list[tuple[int, int]]:
    """(key, entries) of keys with more than about `most` entries, counted over one text in `look`."""

    def count(batches):
        for b in batches:
            k = keys(_rows(b, trees)[:, :trees].ravel(), np.tile(np.arange(trees, dtype=U64), b.num_rows), depth)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64))], ["key"])

    seen = some.where(F.pmod(F.xxhash64("node"), F.lit(look)) == 0).mapInArrow(count, "key long")
    seen = seen.groupBy("key").agg((F.count("*") * look).alias("n")).where(F.col("n") > most).collect()  # at most entries / most rows
    return [(r["key"] % (1 << 64), r["n"]) for r in seen]


def candidates(one: DataFrame, depth: int, trees: int = TREES, threshold: float = THRESHOLD, most: int = BLOCK_ENTRIES, look: int = LOOK) -> DataFrame:
    """Edges (a, b) between nodes whose components hold all candidate pairs."""
    spark, least, n = one.sparkSession, least_alike(threshold), one.count()
    some = one.where("sig IS NOT NULL").select("node", "sig")
    hot = sorted(hot_keys(some, depth, trees, most, look)) if n > most else []
    blocks = np.array([-(-k // most) for _, k in hot], np.int64)
    sent_entries = n * trees + sum(k * (-(-k // most) - 1) for _, k in hot)
    hot = np.array([k for k, _ in hot], U64)
    parts = max(partitions(spark), sent_entries // 2_000_000)

    def send(batches):
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            rows = _rows(b, trees)
            e = np.empty(m * trees, ENTRY)
            e["node"], e["sketch"] = np.repeat(b.column("node").to_numpy(), trees), np.repeat(rows[:, trees:], trees, axis=0)
            e["key"] = keys(rows[:, :trees].ravel(), np.tile(np.arange(trees, dtype=U64), m), depth)
            for out in spread(e, hot, blocks):
                part = (out["key"] % U64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                out, part = out[order], part[order]
                cut, size = _groups(part)
                yield pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array([out[i : i + k].tobytes() for i, k in zip(cut, size)], pa.binary())], ["part", "entries"])

    def join(table):
        found = Forest()
        link_entries(np.concatenate([np.frombuffer(x, ENTRY) for x in table.column("entries").to_pylist()]), found, least)
        us, vs = found.edges()
        return pa.table({"a": pa.array(us, pa.int64()), "b": pa.array(vs, pa.int64())})

    sent = some.mapInArrow(trimmed(send), "part int, entries binary")
    return sent.repartition(min(parts, partitions(spark) * 4), "part").groupBy("part").applyInArrow(join, "a long, b long")


def _sets(texts: pa.ChunkedArray, n: int, codes: np.ndarray) -> list[np.ndarray]:
    out = []
    for chunk in texts.chunks:
        raw, off = utf8(chunk)
        for i, j in runs(off, 1 << 20):
            h, have = shingle_hashes(*word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i], codes), n)
            out += [np.unique(x) for x in np.split(h, np.cumsum(have)[:-1])]
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes."""
    g = len(sets)
    if g == 2:
        x = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), x], [x, len(sets[1])]], float)
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(g), [len(s) for s in sets])
    shared = n > 1
    to = np.cumsum(shared) - 1
    inside = shared[col]
    row, col = row[inside], to[col[inside]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total, width = np.zeros((g, g)), 4096
    for c in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(col, [c, c + width])
        m = np.zeros((g, width), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        total += m @ m.T
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def _verified(sets: list[np.ndarray], nodes: np.ndarray, side: np.ndarray | None, threshold: float):
    """(node, least node of its linked group here, number of links here) of each text."""
    both = overlaps(sets)
    own = np.diag(both)
    link = both >= threshold * (own[:, None] + own[None, :] - both) - 1e-9
    np.fill_diagonal(link, False)
    link[own == 0, :] = False
    link[:, own == 0] = False
    if side is not None:  # two blocks: only pairs across
        link &= side[:, None] != side[None, :]
    f = Forest()
    u, v = np.nonzero(np.triu(link))
    f.link(nodes[u], nodes[v])
    return [f.find(x) for x in nodes.tolist()], link.sum(axis=1)


def verify(members: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, bool]:
    """members (root, node, text): rows (node, to, links), and whether any group was cut into blocks.

    Every pair of different texts of a candidate group is compared, in one task for a group that
    fits; a larger one is cut into blocks, and each pair of blocks is a task.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    sizes = stage(sizes.withColumn("nb", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("chars") / BLOCK_CHARS), F.lit(1))), "sizes")
    t = sizes.agg(F.max("nb").alias("nb"), F.sum("chars").alias("chars")).first()
    cut = (t["nb"] or 1) > 1
    bundles = max(1, (t["chars"] or 0) // 2_000_000)
    m = members.join(sizes.select("root", "nb"), "root")
    block = F.pmod(F.xxhash64("node"), F.col("nb"))
    tasks = F.when(F.col("nb") == 1, F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(bundles)).alias("g"), F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"))))
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), lambda o: F.struct(F.col("root").alias("g"), F.least(block, o).alias("i"), F.greatest(block, o).alias("j")))
    m = m.withColumn("side", block).withColumn("t", F.explode(tasks.otherwise(across))).select("t.g", "t.i", "t.j", "root", "node", "side", "text")

    def task(table):
        codes = byte_codes(True)
        table = table.sort_by([("root", "ascending"), ("node", "ascending")])
        roots, nodes, side = (table.column(c).to_numpy() for c in ("root", "node", "side"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sets = _sets(table.column("text"), n, codes)
        out: tuple[list, list, list] = ([], [], [])
        cuts = np.flatnonzero(np.append(True, roots[1:] != roots[:-1]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(roots)]):
            if b - a > 1:
                to, links = _verified(sets[a:b], nodes[a:b], side[a:b] if i != j else None, threshold)
                for o, x in zip(out, (nodes[a:b].tolist(), to, links.tolist())):
                    o.extend(x)
        return pa.table({"node": pa.array(out[0], pa.int64()), "to": pa.array(out[1], pa.int64()), "links": pa.array(out[2], pa.int64())})

    return m.groupBy("g", "i", "j").applyInArrow(task, "node long, to long, links long"), cut


def needed(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """How many shingles of both prefixes two sets of these sizes share at least, if they are at the threshold.

    Of the shared ones, all that lie before the end of the prefix that ends first are in both
    prefixes; behind it that set has at most ceil(threshold * its size) - 1.
    """
    shared = np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)
    return (shared - np.ceil(threshold * np.maximum(a, b) - 1e-9) + 1).astype(np.int64)


def prefixes(sets: list[np.ndarray], often: np.ndarray, count: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(which set, shingle) of each set's first size - ceil(threshold * size) + 1 shingles: those of `often` (sorted) come last, by count."""
    size = np.array([len(x) for x in sets], np.int64)
    h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    if len(often):
        at = np.searchsorted(often, h)
        at[at == len(often)] = 0
        order = np.lexsort((np.where(often[at] == h, count[at], 0), of))  # stable: shingles of a set are sorted
        h = h[order]
    place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    keep = place <= (size - np.ceil(threshold * size - 1e-9))[of]
    return of[keep], h[keep]


def _small(batches, n: int, codes: np.ndarray):
    """Batches in runs of bounded texts, with their shingle sets."""
    pa.default_memory_pool().release_unused()  # of tasks before in this worker
    for b in batches:
        for i, j in runs(utf8(b.column("text"))[1], 1 << 18):
            part = b.slice(i, j - i)
            yield part, _sets(pa.chunked_array([part.column("text")]), n, codes)
    pa.default_memory_pool().release_unused()


def frequent(members: DataFrame, n: int, look: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that are in more than one text of 1 in `look`, and in how many; at most `most`, the most frequent."""

    def run(batches):
        for _, sets in _small(batches, n, byte_codes(True)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    some = members.where(F.pmod(F.xxhash64("node"), F.lit(look)) == 0).select("text").mapInArrow(run, "h long")
    some = stage(some.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "frequent")
    least, total = 1 << 62, 0
    for r in sorted(some.groupBy("n").agg(F.count("*").alias("m")).collect(), reverse=True):  # a row per number of texts
        total += r["m"]
        if total > most:
            break
        least = r["n"]
    got = some.where(F.col("n") >= least).toArrow()
    unstage(some)
    h, count = got.column("h").to_numpy().view(U64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


PREFIX = np.dtype([("key", "<u8"), ("node", "<i8"), ("root", "<i8"), ("size", "<u4")])


def _packed(e: np.ndarray) -> bytes:
    """Entries of one task, those of a node side by side, in 4 bytes each (what the key has beyond the task) and 24 a node."""
    start, n = _groups(e["node"])
    first = e[start]
    parts = (np.array([len(first)], "<u4"), first["node"], first["root"] ^ first["node"], first["size"], n.astype("<u4"), (e["key"] >> U64(32)).astype("<u4"))
    return b"".join(x.tobytes() for x in parts)


def _unpacked(batches):
    """node, root and size of the texts of a task's blobs, and which text has each entry and its key."""
    heads, ns, keys = [], [], []
    for b in batches:
        for blob in b.column("entries"):
            raw = blob.as_buffer()
            m = int(np.frombuffer(raw, "<u4", 1)[0])
            heads.append((*np.frombuffer(raw, "<i8", 2 * m, 4).reshape(2, m).copy(), np.frombuffer(raw, "<u4", m, 4 + 16 * m).copy()))
            ns.append(np.frombuffer(raw, "<u4", m, 4 + 20 * m).copy())
            keys.append(np.frombuffer(raw, "<u4", -1, 4 + 24 * m).copy())
    if not heads:
        return None
    node, other, size = (np.concatenate(c) for c in zip(*heads))
    return node, node ^ other, size.astype(np.int64), np.repeat(np.arange(len(node), dtype=np.uint32), np.concatenate(ns)), np.concatenate(keys)


def meetings(batches, threshold: float):
    """Record batches (a, b, n, need) of a task: nodes of different roots and of sizes within the threshold that share
    keys here, how many (a pair may come more than once), and `needed`."""
    got = _unpacked(batches)
    if got is None:
        return
    node, root, size, of, key = got
    del got
    order = np.argsort(key, kind="stable")
    key = key[order]
    again = key[1:] == key[:-1]
    again = np.append(again, False) | np.append(False, again)
    key, of = key[again], of[order[again]].astype(np.int64)
    del order, again
    order = np.lexsort((root[of], key))
    key, of = key[order], of[order]
    del order
    start, n = _groups(key)
    end = np.repeat(start + n, n)
    own = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (root[of[1:]] != root[of[:-1]]))) if len(key) else start
    n = np.diff(np.append(own, len(key)))
    to = np.repeat(own + n, n)  # the first of the next root
    at = np.flatnonzero(to < end)
    to, kept, held = to[at], [], 0

    def out():
        pair, times = np.unique(np.concatenate(kept), return_counts=True)
        a, b = pair // len(node), pair % len(node)
        x, y = node[a], node[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(times), pa.array(needed(size[a], size[b], threshold))], ["a", "b", "n", "need"])

    while len(at):
        a, b = of[at], of[to]
        fit = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[fit], b[fit]
        kept.append(np.minimum(a, b) * len(node) + np.maximum(a, b))
        held += len(a)
        if held > PAIRS:
            yield out()
            kept, held = [], 0
        to = to + 1
        more = to < end[at]
        at, to = at[more], to[more]
    if held:
        yield out()


def across(members: DataFrame, n: int = N, threshold: float = THRESHOLD, most: int = BLOCK_ENTRIES, look: int | None = None) -> DataFrame:
    """Pairs (a, b) of nodes of different roots, of members (root, node, text), among which are all at the threshold."""
    spark = members.sparkSession
    t = members.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    look = look or max(1, min(16, t["n"] // 1000), t["n"] // ORDERED)
    often, count = frequent(members, n, look)
    hot, blocks = often[count * look > most], -(-(count * look)[count * look > most] // most)
    parts = max(partitions(spark), (t["chars"] or 0) // 16_000_000)

    def entries(batches):
        held, n_held = [], 0
        for b, sets in _small(batches, n, byte_codes(True)):
            of, h = prefixes(sets, often, count, threshold)
            e = np.empty(len(h), PREFIX)
            e["key"], e["size"] = h, np.array([len(x) for x in sets], np.uint32)[of]
            e["node"], e["root"] = b.column("node").to_numpy()[of], b.column("root").to_numpy()[of]
            held.append(e)
            n_held += len(e)
            if n_held > SENT // 2:
                yield np.concatenate(held)
                held, n_held = [], 0
        if held:
            yield np.concatenate(held)

    def send(batches):
        for e in entries(batches):
            for x in spread(e, hot, blocks):
                part = (x["key"] % U64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                x, part = x[order], part[order]
                cut, size = _groups(part)
                yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array([_packed(x[i : i + k]) for i, k in zip(cut, size)], pa.binary())], ["part", "entries"])

    sent = members.select("root", "node", "text").mapInArrow(trimmed(send), "part int, entries binary").repartitionById(parts, "part")
    pairs = sent.select("entries").mapInArrow(trimmed(lambda batches: meetings(batches, threshold)), "a long, b long, n long, need long")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")


def outline(s: np.ndarray) -> bytes:
    """A bitmap of a set of hashes: bits of their remainders by the least power of two that is at least 8 bits a hash."""
    bits = np.zeros(max(64, 1 << (8 * len(s) - 1).bit_length()), bool)
    bits[(s & U64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(size_a: int, a: bytes, size_b: int, b: bytes) -> int:
    """At most so many hashes are in both of two sets of these sizes and outlines: a bit that only one has set takes one off it."""
    x, y = (int.from_bytes(o, "little") for o in (a, b))
    wide = 8 * max(len(a), len(b))
    while wide > 8 * min(len(a), len(b)):  # halves of the wider one are laid upon each other
        wide //= 2
        x, y = ((o | o >> wide) & ((1 << wide) - 1) for o in (x, y))
    return min(size_a - (x & ~y).bit_count(), size_b - (y & ~x).bit_count())


def among(nodes: DataFrame):
    """A filter of record batches that keeps the rows whose node is one of `nodes` (node); the driver gets 4 KB for each
    run of 32,768 numbers in which there is one, and no table is shuffled for it."""
    got = nodes.groupBy(F.shiftright("node", 15).alias("run")).agg(F.bitmap_construct_agg(F.col("node").bitwiseAND(F.lit(32767))).alias("bits")).toArrow().sort_by("run")
    run, bits = got.column("run").to_numpy(), utf8(got.column("bits"))[0].reshape(-1, 4096)

    def held(batches):
        for b in batches:
            node = b.column("node").to_numpy()
            at = np.searchsorted(run, node >> 15)
            at[at == len(run)] = 0
            inside = np.zeros(len(node), bool)
            if len(run):
                inside = (run[at] == node >> 15) & ((bits[at, (node & 32767) >> 3] >> (node & 7).astype(np.uint8)) & 1 == 1)
            if inside.any():
                yield b.filter(pa.array(inside))

    return held


def possible(pairs: DataFrame, members: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Those of pairs (a, b) of nodes of members (node, text) whose outlines allow the threshold: all that are at it, and few others."""
    held = among(pairs.select(F.explode(F.array("a", "b")).alias("node")))

    def outlines(batches):
        for b, sets in _small(held(batches), n, byte_codes(True)):
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([len(s) for s in sets], pa.int32()), pa.array([outline(s) for s in sets], pa.binary())], ["node", "size", "bits"])

    def allowed(batches):
        for b in batches:
            size_a, a, size_b, o = (b.column(c).to_pylist() for c in ("size_a", "bits_a", "size_b", "bits_b"))
            least = np.ceil(threshold / (1 + threshold) * (np.array(size_a) + np.array(size_b)) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(np.array([most_shared(*x) for x in zip(size_a, a, size_b, o)], np.int64) >= least))

    own = members.select("node", "text").mapInArrow(outlines, "node long, size int, bits binary")
    both = pairs.join(own.toDF("a", "size_a", "bits_a"), "a").join(own.toDF("b", "size_b", "bits_b"), "b")
    return both.select("a", "b", "size_a", "bits_a", "size_b", "bits_b").mapInArrow(allowed, "a long, b long")


def near_dups(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES) -> DataFrame:
    """One row per row of docs: doc_id, a, b (text id), group (number of its near-duplicate group), class_id (least
    doc_id of the group), text_id (least doc_id of equal texts), copies (rows of this text), n_links (other texts
    with Jaccard >= threshold)."""
    one = stage(classes(docs, text, key, n, trees, threshold), "classes")
    met = {r["met"]: r["count"] for r in one.where("met IS NOT NULL").groupBy("met").count().collect()}  # a row per depth
    depth = matched_depth(met, threshold, target, trees)
    groups = stage(components(candidates(one, depth, trees, threshold), "candidates"), "groups")
    d = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("id", text_id(F.col("text"))).select("doc_id", "id.a", "id.b", "text")
    reps = one.where("sig IS NOT NULL").join(groups.withColumnRenamed("root", "group"), "node", "left")
    reps = reps.select("node", F.coalesce("group", "node").alias("root"), F.col("group").isNotNull().alias("met"), "a", "b")
    members = stage(d.groupBy("a", "b").agg(F.first("text").alias("text")).join(reps, ["a", "b"]).drop("a", "b"), "members")
    unstage(groups)
    seen, cut = verify(members.where("met").drop("met"), n, threshold)
    seen = stage(seen, "links")
    shared = stage(across(members, n, threshold), "across")
    pairs = stage(possible(shared, members, n, threshold).withColumn("root", F.monotonically_increasing_id()), "possible")
    unstage(shared)
    two = pairs.select("root", F.explode(F.array("a", "b")).alias("node"))
    texts = members.select("node", "text")
    texts = stage(texts.mapInArrow(among(two), texts.schema), "texts")
    unstage(members)
    more, _ = verify(two.join(texts, "node"), n, threshold)  # a group of two for each pair
    more = stage(more.where("links > 0"), "more")
    unstage(pairs)
    unstage(texts)
    cut = cut or not more.isEmpty()
    seen = seen.unionByName(more)
    links = seen.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("to").alias("root"))
    if cut:
        whole = components(seen.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")), "linked")
        links = links.drop("root").join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
    one = one.drop("sig", "met").join(links, "node", "left").withColumns({"root": F.coalesce("root", "node"), "n_links": F.coalesce("n_links", F.lit(0))})
    least = one.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    one = one.join(least, "root").select("a", "b", F.col("root").alias("group"), "class_id", F.col("doc_id").alias("text_id"), "copies", "n_links")
    return d.drop("text").join(one, ["a", "b"])


def drop_near_dups(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the least id (null first), then text hash."""
    got = near_dups(docs, text, key, **how)
    keep = got.groupBy("group").agg(F.min(F.struct(F.col("doc_id").alias("k"), "a", "b")).alias("r"))
    keep = keep.select(F.col("r.k").alias("__k"), F.col("r.a").alias("__a"), F.col("r.b").alias("__b"))
    d = docs.withColumn("__id", text_id(F.col(text)))
    d = d.join(keep, (F.col("__id.a") == F.col("__a")) & (F.col("__id.b") == F.col("__b")) & F.col(key).eqNullSafe(F.col("__k")))
    rest = [c for c in docs.columns if c not in (text, key)]  # rows of one id and text that differ elsewhere: one of them stays, whole
    row = F.struct(*docs.columns)
    return d.groupBy("__a", "__b").agg(F.min_by(row, F.to_json(F.struct(F.isnull(text).alias("__no_text"), *rest))).alias("__row")).select("__row.*")


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dups(docs).select("doc_id", "class_id", "text_id", "copies", "n_links")
