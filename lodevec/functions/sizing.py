"""Storage estimates as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BYTES = {"float32": 4, "float16": 2, "int8": 1}


def estimate(n_rows: Column, dim: Column, m: int = 16, dtype: str = "float32", text_bytes: int = 200) -> dict[str, Column]:
    """vector_bytes, index_bytes, metadata_bytes, total_bytes, total_gib of a collection."""
    if dtype not in BYTES:
        raise ValueError(f"dtype is one of {tuple(BYTES)}")
    n, d = n_rows.cast("bigint"), dim.cast("bigint")
    vector, index = F.lit(32) + n * d * BYTES[dtype], n * m * 9
    meta = F.floor(n.cast("double") * float(text_bytes) * 1.2).cast("bigint")
    total = vector + index + meta
    return {"vector_bytes": vector, "index_bytes": index, "metadata_bytes": meta, "total_bytes": total, "total_gib": total / float(1 << 30)}


def table(spark: SparkSession, rows: list[int], dims: list[int], **how) -> DataFrame:
    """The grid of rows and dims, a few constants each."""
    r = spark.createDataFrame([(x,) for x in rows], "n_rows bigint")
    d = spark.createDataFrame([(x,) for x in dims], "dim bigint")
    return r.crossJoin(d).withColumns(estimate(F.col("n_rows"), F.col("dim"), **how))


def report(spark: SparkSession, rows: list[int], dims: list[int], **how) -> DataFrame:
    """The same as text: numbers with separators, sizes in GiB to two places."""
    t = table(spark, rows, dims, **how)
    gib = [F.format_number(F.col(f"{c}_bytes") / float(1 << 30), 2).alias(f"{c}_gib") for c in ("vector", "index", "metadata", "total")]
    return t.select(F.format_number("n_rows", 0).alias("n_rows"), "dim", *gib)
