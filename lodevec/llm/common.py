"""What the operators of this subpackage share: staging, Arrow text access, hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# ---------------------------------------------------------------- staging


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder is made and set on one machine (tests); a cluster has no
    folder that this could guess, so there it is an error.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodevec-")
        sc.setCheckpointDir(at)
    return at


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here.

    The table is deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodevec-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/lodevec-[^/]*-[0-9a-f]{32}$", path):
            _drop(df.sparkSession, path)


REPEATS = 64


def single(d: DataFrame, own: list[str], text: str = "text", most: int = REPEATS) -> DataFrame:
    """d (own, text) with rows long, where what occurs in more than `most` rows, alike in own, is one row.

    own names a row's text, too (by hashes). Counting shuffles own only; of what repeats much, each
    partition sends one row on, so that no task sees them all.
    """
    many = stage(d.groupBy(*own).agg(F.count("*").alias("rows")).where(F.col("rows") > most), "repeated")
    once = d.join(many, own, "left_anti").withColumn("rows", F.lit(1).cast("long"))
    more = d.join(many, own).groupBy(*own).agg(F.first(text).alias(text), F.first("rows").alias("rows"))
    return once.select(*own, text, "rows").unionByName(more.select(*own, text, "rows"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow


def trim() -> None:
    """Give back to the system what tasks before have freed in this worker: workers stay, and so would their memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(run):
    """run, a function of an iterator of record batches, that gives memory back before and after its task."""

    def whole(batches):
        trim()
        yield from run(batches)
        trim()

    return whole


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array as one uint8 array, and n + 1 offsets into it (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, most: int):
    """Cut rows into runs of about `most` bytes (a longer row is a run of its own): (first, end) pairs."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix64); a bijection."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n - 1) modulo 2**64, or of its inverse; kept for the next call."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), _INV if inverse else BASE, U64)
        out[0] = 1
        have = _powers[key] = np.cumprod(out)
    return have[:n]


def byte_codes(fold_case: bool) -> np.ndarray:
    """A 64-bit code for each byte; ASCII letters of either case share one if fold_case."""
    codes = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of bytes that are no ASCII white space, in order, and how many words each row has."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~WHITE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = solid[edge]  # a row's first word begins anew
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[edge - 1] = solid[edge - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, U64)
    np.cumsum(codes[raw] * powers(n), out=total[1:])
    words = mix((total[e] - total[s]) * powers(n, True)[s] + (e - s).astype(U64))
    return words, np.diff(np.searchsorted(s, offsets))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words in each row and how many each row has; fewer words make one shingle, none none."""
    ends = np.cumsum(counts)
    starts = ends - counts
    have = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    total = int(have.sum())
    if not total:
        return np.zeros(0, U64), have
    first = np.repeat(starts - (np.cumsum(have) - have), have) + np.arange(total)
    end = np.repeat(ends, have)
    out = np.zeros(total, U64)
    for k in range(n):
        at = first + k
        inside = at < end
        w = words[np.minimum(at, len(words) - 1)]
        out = (out + np.where(inside, w, U64(k + 1))) * U64(BASE)
        out ^= out >> U64(29)
    return mix(out), have


# ---------------------------------------------------------------- columns


def text_id(text: Column) -> Column:
    """128 bits that stand for a text (null: empty): equal texts have equal ids."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(1)).alias("b"))


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str = "cc", rounds: int = 40) -> DataFrame:
    """Connected components of undirected edges (a, b), any sortable type: rows (node, root), root the least node.

    Alternates large-star and small-star steps, each one shuffle of the edges; hot nodes need no
    list in memory, as each step only takes a minimum per node. Every round is written to the
    shared folder; it ends when a round changes nothing. Nodes without edges don't appear.
    """
    e = stage(edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before = None
    for k in range(1, rounds + 1):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, stage(small, f"{name}-{k}")
        unstage(last)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
