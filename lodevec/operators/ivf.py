"""The collection's approximate index: inverted lists around k-means centres.

Stands in for a graph index, which has no distributed counterpart in Spark: vectors carry the
number of their nearest centre, tables are partitioned by it, and a query reads only the nprobe
lists nearest to it, which Parquet partition pruning turns into fewer files. Centres are fitted on
a bounded sample; every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.operators import search

SAMPLE, ROUNDS, SEED = 20_000, 12, 5


def fit(collection: DataFrame, lists: int, vector: str = "vector", key: str = "id", sample: int = SAMPLE) -> np.ndarray:
    """Unit centres of `lists` cells, from the `sample` rows of least id hash."""
    s = collection.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(sample).select("v").toArrow()
    x = np.array(s.column("v").to_pylist(), float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            own = x[at == i]
            if len(own) and (n := np.linalg.norm(own.sum(0))) > 0:
                c[i] = own.sum(0) / n
    return c


def _near(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]


def nearest_cells(centres: np.ndarray, query, nprobe: int) -> list[int]:
    return [int(i) for i in _near(np.asarray(query, float)[None, :], centres, nprobe)[0]]


def assign(collection: DataFrame, centres: np.ndarray, vector: str = "vector") -> DataFrame:
    """collection with cell int."""

    def run(v: pa.Array) -> pa.Array:
        return pa.array((search.vectors_of(v) @ centres.T).argmax(axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32))

    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return collection.withColumn("cell", F.arrow_udf(run, "int")(F.col(vector).cast("array<double>")))


def probe(indexed: DataFrame, centres: np.ndarray, query, k: int, nprobe: int, metric: str = "cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """Top-k within the nprobe cells nearest to a query."""
    return search.topk(indexed.where(F.col("cell").isin(nearest_cells(centres, query, nprobe))), query, k, metric, vector, key)


def batch_probe(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, nprobe: int, metric: str = "cosine", vector: str = "vector", key: str = "id") -> DataFrame:
    """Rows (query_id, rank, id, score): the k best within each query's nprobe cells.

    Queries are broadcast in blocks of bounded size, as in search.batch_topk; the index is scanned
    where it lies and not shuffled, so a cell of any size is split as its files are. Of a batch,
    each cell's vectors meet the queries that probe it in one matrix product.
    """
    sc, out = indexed.sparkSession.sparkContext, None
    for ids, q in search.query_blocks(queries, vector, key):
        near = _near(q, centres, nprobe)
        sent = sc.broadcast((ids.astype(np.int64), q, near))

        def run(batches, sent=sent):
            ids, q, near = sent.value
            best = search.Best(q, k, metric)
            asked = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
            for b in batches:
                cell, own, v = b.column(2).to_numpy(), b.column(0).to_numpy(), search.vectors_of(b.column(1))
                for c in np.unique(cell).tolist():
                    if c in asked:
                        best.add(own[cell == c], v[cell == c], asked[c])
            yield best.batch(ids)

        cells = [int(c) for c in np.unique(near)]
        own = indexed.where(F.col("cell").isin(cells)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), "cell")
        hits = search.ranked(own.mapInArrow(run, search.HITS), k)
        out = hits if out is None else out.unionByName(hits)
    return indexed.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double") if out is None else out


def sweep(collection: DataFrame, queries: DataFrame, lists: int, probes: list[int], k: int = 10, metric: str = "cosine") -> list[tuple[int, float]]:
    """(nprobe, recall@k) for each nprobe, against the exact answer."""
    c = fit(collection, lists)
    indexed = assign(collection, c).cache()
    truth = search.batch_topk(collection, queries, k, metric).cache()
    return [(n, search.recall_at_k(batch_probe(indexed, c, queries, k, n, metric), truth, k).first()["recall"]) for n in probes]
