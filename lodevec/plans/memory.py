"""Text in, text out: a catalog of namespaces with an embedder, as one small object."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions import text as T
from lodevec.operators import chunking, hybrid, store
from lodevec.sources import embed as E
from lodevec.sources import files

MANIFESTS = "_manifests"


class Memory:
    """index, index_files, search, forget, info and namespaces over collections of embedded texts."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[Column], Column] | None = None, dim: int = 384, max_vectors: int = 0, max_namespaces: int = 0):
        self.spark, self.embed = spark, embed or E.hashing_embedder(dim)
        self.catalog = store.Catalog(spark, root, max_namespaces, max_vectors, dim=dim, metric="cosine")

    def vector(self, text: str) -> list[float]:
        return self.spark.range(1).select(self.embed(F.lit(text)).alias("v")).first()["v"]

    def index(self, texts: DataFrame | str, namespace: str, metadata: str = "", tags: dict | None = None) -> range:
        """Append a text, or a table with a column text; metadata and tags become suffixes of each."""
        d = self.spark.createDataFrame([(texts,)], "text string") if isinstance(texts, str) else texts.select("text")
        t = F.concat(F.col("text"), F.lit(f"\n[{metadata}]")) if metadata else F.col("text")
        if tags is not None:
            t = T.add_tags(t, F.lit(json.dumps(T.validate_tags(tags))))
        bad = T.text_problem(F.col("text"))
        d = d.withColumn("text", F.when(bad.isNull(), T.nfc(F.col("text"))).otherwise(F.raise_error(F.concat(F.lit("text refused: "), bad))))
        return self.catalog.open(namespace).put_batch(d.select(self.embed(F.col("text")).alias("vector"), t.alias("text"), T.iso_now().alias("ts")))

    def index_files(self, root: str, namespace: str, chunk_size: int | None = None, mode: str = "auto", respect_gitignore: bool = True) -> DataFrame:
        """Bring a namespace up to date with a directory tree: rows (status, n_files)."""
        own = store.Files(self.spark, self.catalog.files.at(MANIFESTS, namespace))
        tables = [f for f in own.list() if not f.startswith((".", "_"))]
        last = max(map(int, tables), default=0)
        manifest = self.spark.read.parquet(own.at(str(last))) if tables else self.spark.createDataFrame([], files.MANIFEST)
        allowed = self.spark.createDataFrame(files.walk(root, respect_gitignore), "path string, mtime_ms bigint, size bigint")
        read = files.read_texts(self.spark, root).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
        found = read.drop("mtime_ms", "size").join(allowed, "path")
        new, summary = files.index_files(self.catalog.open(namespace), found, manifest, self.embed, chunking.clamp_size(chunk_size), mode)
        new.write.parquet(own.at(str(last + 1)))
        return summary

    def search(self, query: str, namespace: str, k: int = 5, **how) -> DataFrame:
        """See hybrid.retrieve for what how may name: start, end, candidate_k, hybrid, fusion, weight, wanted, mode."""
        c = self.catalog.open(namespace)
        rows = c.rows().withColumn("tags", T.parse_tags(F.col("text")))
        hits = hybrid.retrieve(rows, self.vector(query), query, k, metric=c.metric, **how)
        return hits.select("rank", "id", "score", T.strip_tags(F.col("text")).alias("text"), "ts", *(c for c in ("lexical_score", "hybrid_score") if c in hits.columns))

    def recall(self, query: str, limits: dict[str, int]) -> DataFrame:
        """Each namespace's own k best."""
        out = None
        for ns, k in limits.items():
            hits = self.search(query, ns, k).withColumn("ns", F.lit(ns))
            out = hits if out is None else out.unionByName(hits)
        return out

    def forget(self, namespace: str, id: int | None = None, query: str | None = None, k: int = 1) -> int:
        """Delete one id, or a query's k nearest."""
        c = self.catalog.open(namespace)
        if id is not None:
            return c.delete(id)
        if query is None:
            raise ValueError("an id or a query is needed")
        return c.forget(self.vector(query), k)

    def info(self, namespace: str) -> DataFrame:
        return self.catalog.open(namespace).stats()

    def namespaces(self) -> list[str]:
        return self.catalog.names()
