"""Exact similarity search: score, filter, top-k.

Order is score descending, then id ascending, everywhere. Single queries plan as
TakeOrderedAndProject; per-query ranks plan as WindowGroupLimit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions import vectors

CANDIDATES = 10


def check_k(k: int, most: int | None = None) -> int:
    if not isinstance(k, int) or k <= 0 or most is not None and k > most:
        raise ValueError(f"top_k must be a positive integer{f' up to {most}' if most else ''}, not {k!r}")
    return k


def live(collection: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id has no tombstone; Spark broadcasts the tombstones if they are small."""
    return collection.join(tombstones.select(key).distinct(), key, "left_anti")


def in_window(ts: Column, start: str | None = None, end: str | None = None) -> Column:
    """Both bounds included and compared as text; a row without a timestamp passes."""
    hit = F.lit(True)
    if start:
        hit = hit & ((ts == "") | ts.isNull() | (ts >= start))
    if end:
        hit = hit & ((ts == "") | ts.isNull() | (ts <= end))
    return hit


def topk(collection: DataFrame, query: Sequence[float] | Column, k: int, metric: str = "cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """The k rows nearest to one query, with score and rank (from 1)."""
    check_k(k)
    q = query if isinstance(query, Column) else vectors.literal(query)
    hits = collection.withColumn("score", vectors.similarity(F.col(vector), q, metric)).orderBy(F.desc("score"), F.asc(key)).limit(k)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))))  # over k rows


def settled(hits: DataFrame) -> DataFrame:
    """The hits of one query (k rows) as a local table: what follows doesn't search again, and joins know their size."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def attach(hits: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """hits (k rows, settled) with the columns of table, null where it has no such row; the table is scanned, not shuffled."""
    own = table.join(F.broadcast(hits.select(key).distinct()), key, "left_semi")  # k ids
    return hits.join(own, key, "left")


def topk_in_window(collection: DataFrame, query: Sequence[float] | Column, k: int, start: str | None = None, end: str | None = None, candidate_k: int = 0, mode: str = "post", metric: str = "cosine", vector: str = "vector", key: str = "id", ts: str = "ts", times: DataFrame | None = None) -> DataFrame:
    """Top-k within a time window.

    post: the candidate_k nearest (0: ten times k) are filtered, so fewer than k may stay.
    pre: the window is applied first and reaches the scan; never returns fewer than it could.
    times (id, ts) may be a table of its own: it is joined after the cut, or rows outside the window
    are taken out by an anti join before it.
    """
    check_k(k)
    if mode not in ("pre", "post"):
        raise ValueError("mode must be 'pre' or 'post'")
    with_times = lambda hits: hits if times is None else attach(settled(hits), times, key).withColumn(ts, F.coalesce(ts, F.lit("")))
    if mode == "pre":
        if times is not None:
            outside = times.where(~in_window(F.col(ts), start, end)).select(key)
            return with_times(topk(collection.join(outside, key, "left_anti"), query, k, metric, vector, key))
        return topk(collection.where(in_window(F.col(ts), start, end)), query, k, metric, vector, key)
    pool = with_times(topk(collection, query, max(k, candidate_k if candidate_k > 0 else CANDIDATES * k), metric, vector, key))
    hits = pool.where(in_window(F.col(ts), start, end)).orderBy("rank").limit(k)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy("rank")))


def topk_by_id(collection: DataFrame, query_id: int, k: int, metric: str = "cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """Top-k around a stored row's vector; an unknown id gives no rows. The query side is one row."""
    q = collection.where(F.col(key) == query_id).select(F.col(vector).alias("__q")).limit(1)
    hits = collection.crossJoin(F.broadcast(q))
    return topk(hits, F.col("__q"), k, metric, vector, key).drop("__q")


QUERY_BYTES, SLICE = 16 << 20, 256


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


class Best:
    """The k best (score, id) of each query so far, over batches of vectors: a matrix product finds candidates, whose
    scores are then summed alike for every vector, so that equal vectors tie."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        q = np.ascontiguousarray(queries, np.float64)
        self.k, self.metric, self.q = k, metric, _unit(q) if metric == "cosine" else q
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, v: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Vectors for all queries, or for those of the numbers `rows`."""
        if not len(ids) or not len(self.q):
            return
        v = v.astype(np.float64)
        v = _unit(v) if self.metric == "cosine" else v
        rows = np.arange(len(self.q)) if rows is None else rows
        found = [(self.row, self.id, self.score)]
        square = (v * v).sum(axis=1)
        for i in range(0, len(rows), SLICE):
            own = rows[i : i + SLICE]
            s = self.q[own] @ v.T
            if self.metric == "l2":
                s = 2 * s - square
            if len(ids) > self.k:
                cut = np.partition(s, len(ids) - self.k, axis=1)[:, [len(ids) - self.k]]
                r, c = np.nonzero(s >= cut - 1e-9 * np.maximum(1.0, np.abs(cut)))
            else:
                r, c = (x.ravel() for x in np.indices(s.shape))
            a, b = self.q[own[r]], v[c]
            exact = 1.0 / (1.0 + ((a - b) * (a - b)).sum(axis=1)) if self.metric == "l2" else (a * b).sum(axis=1)
            found.append((own[r], ids[c], exact))
        row, id_, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((id_, -score, row))
        row, id_, score = row[order], id_[order], score[order]
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        keep = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row)))) < self.k
        self.row, self.id, self.score = row[keep], id_[keep], score[keep]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query_ids[self.row]), pa.array(self.id), pa.array(self.score)], ["query_id", "id", "score"])


HITS = "query_id long, id long, score double"


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, rank, id, score): the k best of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def query_blocks(queries: DataFrame, vector: str, key: str, most: int = QUERY_BYTES):
    """(ids, matrix) of blocks of queries of about `most` bytes, as many as their summed size asks for."""
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    size = q.agg(F.sum(F.size("v") * 8).alias("b")).first()["b"] or 0
    blocks = -(-size // most)
    for i in range(blocks):
        t = q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == i).toArrow() if blocks > 1 else q.toArrow()
        yield t.column("i").to_numpy(), vectors_of(t.column("v").combine_chunks())


def batch_topk(collection: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", vector: str = "vector", key: str = "id", query_vector: str = "vector", query_key: str = "id") -> DataFrame:
    """Top-k for every row of a query table: rows (query_id, rank, id, score).

    Queries go out in blocks of QUERY_BYTES, one pass over the collection for each; see batch_topk_gemm.
    """
    check_k(k)
    out = None
    for ids, q in query_blocks(queries, query_vector, query_key):
        hits = batch_topk_gemm(collection, q, ids, k, metric, vector, key)
        out = hits if out is None else out.unionByName(hits)
    return collection.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double") if out is None else out


def batch_topk_gemm(collection: DataFrame, queries: np.ndarray, query_ids: Sequence[int], k: int, metric: str = "cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """The same for query vectors on the driver: one matrix product per Arrow batch, k rows a query and partition sent on.

    The query matrix is broadcast; it must fit there (at most 64 MB here).
    """
    check_k(k)
    q = np.ascontiguousarray(queries, np.float64)
    if q.nbytes > 64 << 20:
        raise ValueError("too many query vectors for one pass; search them in blocks")
    sent = collection.sparkSession.sparkContext.broadcast((np.asarray(query_ids, np.int64), q))

    def run(batches):
        ids, q = sent.value
        best = Best(q, k, metric)
        for b in batches:
            best.add(b.column(0).to_numpy(), vectors_of(b.column(1)))
        yield best.batch(ids)

    own = collection.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return ranked(own.mapInArrow(run, HITS), k)


def shard_topk(shards: Sequence[DataFrame], query: Sequence[float] | Column, k: int, metric: str = "cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """Search each shard, then keep the k best of all; the rows say which shard they are from."""
    parts = [topk(s, query, k, metric, vector, key).withColumn("shard", F.lit(i)) for i, s in enumerate(shards)]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return _merged(hits, k, key)


def sharded_topk(collection: DataFrame, query: Sequence[float] | Column, k: int, shard: str = "shard", metric: str = "cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """The same for shards that are a column of one table: one scan, k rows a shard and partition sent on."""
    check_k(k)
    q = query if isinstance(query, Column) else vectors.literal(query)
    w = Window.partitionBy(shard).orderBy(F.desc("score"), F.asc(key))
    hits = collection.withColumn("score", vectors.similarity(F.col(vector), q, metric)).withColumn("rank", F.row_number().over(w))
    return _merged(hits.where(F.col("rank") <= k), k, key, shard)


def _merged(hits: DataFrame, k: int, key: str, shard: str = "shard") -> DataFrame:
    order = F.desc("score"), F.asc(key), F.asc(shard)
    return hits.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over k rows


def namespace_topk(collection: DataFrame, query: Sequence[float] | Column, limits: dict[str, int], metric: str = "cosine", namespace: str = "ns", vector: str = "vector", key: str = "id") -> DataFrame:
    """Each namespace's own top-k: limits gives k by namespace."""
    q = query if isinstance(query, Column) else vectors.literal(query)
    most = F.create_map(*(x for ns, k in limits.items() for x in (F.lit(ns), F.lit(check_k(k)))))
    hits = collection.where(F.col(namespace).isin(list(limits))).withColumn("score", vectors.similarity(F.col(vector), q, metric))
    w = Window.partitionBy(namespace).orderBy(F.desc("score"), F.asc(key))
    hits = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(limits.values()))
    return hits.where(F.col("rank") <= F.element_at(most, F.col(namespace)))


def hit_at(hits: DataFrame, match_rank: int) -> DataFrame:
    """The hit of 0-based rank match_rank."""
    return hits.where(F.col("rank") == match_rank + 1)


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: queries, and the mean share of each query's true top-k that was found."""
    a = truth.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias("t"))
    b = found.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("id").alias("f"))
    share = F.size(F.array_intersect("t", F.coalesce("f", F.array().cast("array<bigint>")))) / F.size("t")
    return a.join(b, "query_id", "left").agg(F.count("*").alias("n_queries"), F.avg(share).alias("recall"))
