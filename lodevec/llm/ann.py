"""Operator 2, approximate nearest neighbours: collision-counting hashing with query-aware windows.

Nearness is the largest inner product. Vectors x become (x, sqrt(M**2 - |x|**2)) with M the
largest norm of the table, so that the nearest in Euclidean distance are those of largest inner
product. Each of PROJECTIONS random directions (orthonormal sets, so that together they keep
distances better than independent ones) is one sorted array of a block's vectors, cut into 256
buckets of equal size. A query opens a window around its own projection in every array and counts
for each vector in how many windows it lies. Virtual rehashing widens the windows by RATIO, and
only the buckets that they newly reach are walked and counted, until at least `need` vectors (8 * k
and VERIFY of the block) collide in SHARE of the arrays; those are verified by their exact inner
products. Windows too narrow for three in four of CALIBRATE vectors of the block are skipped: a query's first
windows are counted by comparing the vectors' bucket numbers, one byte each.

Scale: rows are staged with a number of their own and dealt to blocks by its hash, so that blocks
are of even size whatever the ids are; a block's task holds its vectors and arrays (about
block * (8 * d + 5 * PROJECTIONS) bytes) and reads a group of at most about QUERIES queries as a
stream, so neither memory nor a task's time grows with the table. Every query meets every block, as
the queries are a stated set against all rows: queries are replicated once a block, blocks once a
group, and k rows a query and block come back, of which the k best stay.

Cases: vectors that are null, zero, of another length than most rows', or hold null or non-finite
components take no part, as queries or as candidates; with fewer than k candidates all are
returned; equal scores go to the smaller id; rows of a null id are candidates of that id but no
queries; repeated rows are candidates each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm.common import stage

K, PROJECTIONS, WIDTH, RATIO, SHARE, VERIFY, BLOCK, QUERIES, SEED, CALIBRATE = 20, 128, 1.0, 1.02, 0.85, 0.013, 50_000, 50_000, 11, 16
BUCKETS = 256


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def directions(d: int, projections: int, seed: int = SEED) -> np.ndarray:
    """d rows, a column a direction: orthonormal bases side by side, of length sqrt(d)."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(-(-projections // d)):
        q, r = np.linalg.qr(rng.normal(size=(d, d)))
        out.append(q * np.sign(np.diag(r)) * np.sqrt(d))
    return np.hstack(out)[:, :projections]


class Block:
    """The index of one block of vectors: in each array the order of the vectors, their buckets and the buckets' first values."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, norm: float, k: int = K, projections: int = PROJECTIONS, seed: int = SEED, verify: float = VERIFY):
        first = np.argsort(ids, kind="stable")
        if projections > 255:
            raise ValueError("collisions are counted in a byte: at most 255 projections")
        self.x, self.ids, self.m, self.level = np.ascontiguousarray(x[first], np.float64), ids[first], projections, 0
        n = len(ids)
        self.need = min(n, 8 * k + int(np.ceil(verify * n)))
        self.least = int(np.ceil(SHARE * projections))
        self.a = directions(x.shape[1] + 1, projections, seed)  # the same for all blocks
        rest = np.sqrt(np.maximum(0.0, norm**2 - (self.x**2).sum(axis=1)))
        p = ((self.x @ self.a[:-1] + rest[:, None] * self.a[-1]) / norm).T
        order = np.argsort(p, axis=1, kind="stable")
        self.edge = -(-np.arange(BUCKETS + 1) * n // BUCKETS)  # a bucket's first rank
        heads = np.take_along_axis(p, order[:, np.minimum(self.edge[:-1], n - 1)], axis=1)
        self.heads = np.where(self.edge[:-1] < n, heads, np.inf)
        self.order = order.astype(np.uint32)
        self.bucket = np.empty((projections, n), np.uint8)
        np.put_along_axis(self.bucket, order, (np.arange(n) * BUCKETS // n).astype(np.uint8)[None, :], axis=1)
        if self.need < n:  # narrower windows than most of these need would be opened in vain
            levels = sorted(self.candidates(self.x[i])[1] for i in range(0, n, -(-n // CALIBRATE)))
            self.level = max(0, levels[len(levels) // 4] - 2)

    def _window(self, c: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that each array's window reaches: from, to."""
        half = WIDTH / 2 * RATIO**level
        lo = np.maximum(0, (self.heads <= (c - half)[:, None]).sum(axis=1) - 1)
        return lo, np.maximum(lo, (self.heads <= (c + half)[:, None]).sum(axis=1))

    def candidates(self, q: np.ndarray) -> tuple[np.ndarray, int]:
        """Vectors that collide with q in at least SHARE of the arrays, in the first window in which enough do; its level."""
        n, level, edge = len(self.ids), self.level, self.edge
        c = (q / np.sqrt((q * q).sum())) @ self.a[:-1]
        lo, hi = self._window(c, level)
        counts, inside, away = np.zeros(n, np.uint8), np.empty(n, bool), np.empty(n, np.uint8)
        for b, i, j in zip(self.bucket, lo.tolist(), hi.tolist()):
            if j - i == BUCKETS:
                counts += 1
            elif j > i:
                np.subtract(b, np.uint8(i), out=away)  # buckets before the window wrap around
                np.less(away, np.uint8(j - i), out=inside)
                np.add(counts, inside.view(np.uint8), out=counts)
        while True:
            hit = np.flatnonzero(counts >= self.least)
            if len(hit) >= self.need or (hi - lo).min() == BUCKETS:
                return hit, level
            level += 1
            before, (lo, hi) = (lo, hi), self._window(c, level)
            new = [o[edge[x] : edge[y]] for o, ends in zip(self.order, zip(lo, before[0], before[1], hi)) for x, y in (ends[:2], ends[2:]) if x < y]
            if new:
                counts += np.bincount(np.concatenate(new), minlength=n).astype(np.uint8)

    def search(self, q: np.ndarray, me: int | None, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact inner products of the k nearest found, without `me`, nearest first."""
        at = self.candidates(q)[0]
        if me is not None:
            at = at[self.ids[at] != me]
        rows = self.x[at]
        near = rows @ q
        if len(at) > 4 * k:  # ties at the end stay in: the product below decides
            cut = np.partition(near, len(near) - k)[len(near) - k]
            own = near >= cut - 1e-9 * max(1.0, abs(cut))
            at, rows = at[own], rows[own]
        score = (rows * q).sum(axis=1)  # summed alike for every row, so that equal vectors tie
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][best], score[best]


def search(table: DataFrame, is_query: Column, vector: str = "embedding", key: str = "vec_id", k: int = K, block: int = BLOCK, verify: float = VERIFY) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each row for which is_query holds."""
    t = table.where(usable(F.col(vector))).select(F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.coalesce(is_query, F.lit(False)) & F.col(key).isNotNull()).alias("q"))
    t = stage(t.withColumn("row", F.monotonically_increasing_id()), "vectors")
    facts = t.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("asked"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).orderBy(F.desc("n"), "d").first()
    out = "query_id long, vec_id long, score double"
    if facts is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, norm, blocks = facts["d"], float(np.sqrt(facts["m"])) * (1 + 1e-12), max(1, -(-facts["n"] // block))
    t = t.where(F.size("v") == d)
    groups = max(1, -(-facts["asked"] // QUERIES))  # a task is a block and a group of queries
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block_of, group_of = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int")
    rows = t.select(block_of.alias("i"), each(groups).alias("j"), F.lit(0).alias("kind"), "id", "v")
    asked = t.where("q").select(each(blocks).alias("i"), group_of.alias("j"), F.lit(1).alias("kind"), "id", "v")
    both = rows.unionByName(asked).select((F.col("i") * groups + F.col("j")).alias("b"), "kind", "id", "v")
    dealt = both.repartitionById(blocks * groups, F.col("b")).sortWithinPartitions("b", "kind")

    def run(batches):
        own: list[tuple[np.ndarray, np.ndarray]] = []
        index = None
        for b in batches:
            kind, ids = b.column("kind").to_numpy(), b.column("id").to_numpy()
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            asks = kind == 1
            if not asks.all():
                own.append((v[~asks], ids[~asks]))
            if not asks.any() or not own:
                continue
            if index is None:
                index = Block(np.concatenate([x for x, _ in own]), np.concatenate([i for _, i in own]), norm, k, verify=verify)
            cols: tuple[list, list, list] = ([], [], [])
            for i, q in zip(ids[asks].tolist(), v[asks]):
                near, score = index.search(q, i, k)
                for c, x in zip(cols, (np.full(len(near), i), near, score)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["query_id", "vec_id", "score"])

    got = dealt.mapInArrow(run, out)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    got = got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    real = F.when(F.col("vec_id") != -(1 << 63), F.col("vec_id"))
    return got.select("query_id", "rank", real.alias("vec_id"), "score")


def brute_force(table: DataFrame, is_query: Column, vector: str = "embedding", key: str = "vec_id", k: int = K) -> DataFrame:
    """The true answer, by the same steps with every vector verified; for measuring recall."""
    return search(table, is_query, vector, key, k, verify=2.0)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    n = truth.count()
    return truth.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0


def op2_collision_knn(spark, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(t, F.col("vec_id") % 20 == 0)
