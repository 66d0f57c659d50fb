"""Vector expressions: everything stays inside the JVM, accumulated in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("ip", "cosine", "l2")


def literal(vector: Sequence[float]) -> Column:
    """A query vector as a constant array<double>; Catalyst folds what depends on it alone."""
    return F.array(*(F.lit(float(x)) for x in vector))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; a zero vector scores 0 with everything."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def similarity(a: Column, b: Column, metric: str) -> Column:
    """Larger is nearer: inner product, cosine, or 1 / (1 + squared distance)."""
    if metric == "ip":
        return dot(a, b)
    if metric == "cosine":
        return cosine(a, b)
    if metric == "l2":
        return 1.0 / (1.0 + squared_distance(a, b))
    raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")


def l2_normalize(a: Column) -> Column:
    """The unit vector as array<float>; null for a zero vector, which has none."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def normalize_or_keep(a: Column) -> Column:
    """The index's variant: a zero vector stays as it is."""
    return F.coalesce(l2_normalize(a), a)


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is not 0, as array<double>; null if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda z: z["m"] != 0), lambda z: z["v"])
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.transform(F.get(kept, 0), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def mean_pooled(rows: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """Rows (by, pos, mean) of the mean vectors of groups of any size; no group is gathered."""
    return rows.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def random_unit_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """Rows (id, vector): Gaussian unit vectors, the same for a seed on any number of partitions."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for b in batches:
            ids = b.column(0).to_numpy()
            v = np.array([np.random.default_rng([seed, i]).normal(size=dim) for i in ids]).reshape(-1, dim)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))], ["id", "vector"])

    return spark.range(n).mapInArrow(run, "id long, vector array<float>")


# ---------------------------------------------------------------- reduced precision


def int8_scale_of(vector: Column) -> Column:
    """Aggregate: the largest magnitude, at least 1."""
    return F.greatest(F.lit(1.0), F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))))


def quantize_int8(vector: Column, scale: Column) -> Column:
    """array<tinyint>: round half away from zero of x * (127 / scale) in float, clamped; scale 0 gives zeros."""
    factor = (F.lit(127.0).cast("float") / scale.cast("float")).cast("float")

    def one(x: Column) -> Column:
        q = F.round((x.cast("float") * factor).cast("float").cast("double"))
        return F.greatest(F.lit(-127.0), F.least(F.lit(127.0), q)).cast("tinyint")

    zero = F.transform(vector, lambda x: F.lit(0).cast("tinyint"))
    return F.when(scale == 0, zero).otherwise(F.transform(vector, one))


def dequantize_int8(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda q: (q.cast("float") * (scale.cast("float") / F.lit(127.0).cast("float")).cast("float")).cast("float"))


def _half_bits(values):
    """float32 -> float16 bits, truncating (NumPy's cast would round)."""
    import numpy as np

    bits = np.asarray(values, np.float32).view(np.uint32)
    sign, exponent, mantissa = (bits >> 16) & 0x8000, ((bits >> 23) & 0xFF).astype(np.int64) - 112, bits & 0x7FFFFF
    normal = (exponent.clip(0, 31).astype(np.uint32) << 10) | (mantissa >> 13)
    shift = (14 - exponent).clip(0, 31).astype(np.uint32)
    small = np.where(exponent >= -10, (mantissa | 0x800000) >> shift, 0)
    out = np.where(exponent <= 0, small, np.where(exponent >= 31, 0x7C00, normal))
    special = exponent == 143
    out = np.where(special, 0x7C00 | np.where(mantissa != 0, np.maximum(mantissa >> 13, 1), 0), out)
    return (sign | out).astype(np.uint16)


def to_float16(vector: Column) -> Column:
    """array<float> -> binary of little-endian halves."""
    return _to_half(vector)


def from_float16(codes: Column) -> Column:
    return _from_half(codes)


def encode_base64(vector: Column) -> Column:
    """array<float> -> base64 of its little-endian float32 bytes."""
    return F.base64(_to_bytes(vector))


def decode_base64(text: Column, dim: int) -> Column:
    """The first dim floats of base64 text; null if it holds fewer. A last incomplete group of four characters is ignored."""
    whole = F.substring(text, 1, (F.length(text) - F.length(text) % 4).cast("int"))
    raw = F.unbase64(whole)
    return _from_bytes(F.when(F.octet_length(raw) >= dim * 4, F.substring(raw, 1, dim * 4)))  # a Python function sees every row, whatever guards it


def _bytes_of(convert):
    def run(v):
        import numpy as np
        import pyarrow as pa

        return pa.array([None if x is None else convert(np.array(x, np.float32)).tobytes() for x in v.to_pylist()], pa.binary())

    return run


def _floats_of(kind: str):
    def run(v):
        import numpy as np
        import pyarrow as pa

        return pa.array([None if x is None else np.frombuffer(x, kind).astype(np.float32) for x in v.to_pylist()], pa.list_(pa.float32()))

    return run


def _to_half(c: Column) -> Column:
    return _scalar(_bytes_of(_half_bits), "binary", c)


def _from_half(c: Column) -> Column:
    return _scalar(_floats_of("<f2"), "array<float>", c)


def _to_bytes(c: Column) -> Column:
    return _scalar(_bytes_of(lambda x: x.astype("<f4")), "binary", c)


def _from_bytes(c: Column) -> Column:
    return _scalar(_floats_of("<f4"), "array<float>", c)


def _scalar(run, kind: str, column: Column) -> Column:
    import pyarrow as pa

    def udf(v: pa.Array) -> pa.Array:
        return run(v)

    udf.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(udf, kind)(column)
