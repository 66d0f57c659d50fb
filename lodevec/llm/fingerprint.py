"""Operator 1, document fingerprints: bottom-k sketches of shingle hashes.

A shingle is WIDTH consecutive code points (a shorter text that isn't empty is one shingle). Its
hash is a polynomial over mixed code points modulo 2**64, mixed again and cut to 48 bits. The
sketch keeps the K least distinct hashes. Sketches of parts merge to the sketch of the union
(`merge`), and two sketches estimate resemblance, containment and the number of distinct shingles.
As text, a sketch is the base64 of its sorted big-endian 6-byte hashes: 8 characters a hash. A
sketch of fewer than K hashes holds all of them, and estimates from it are exact.

Cases: null text counts as empty and has the empty sketch, which resembles another empty one by 1
and any other by 0; equal texts have equal sketches; a null doc_id sorts first; rows of equal id
follow one another by text hash, so repeated rows give the same result on every run; a text of any
length is hashed in parts of PART code points, whose sketches are merged; columns of the table that
are named like a result are replaced.

Scale: see `in_order`. An id that many rows share, null too, is cut into slices by text hash; rows
that repeat much in id and text are one row until their results are written.
"""

import base64
import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import BASE, U64, mix, partitions, single

K, WIDTH, BITS, PART = 128, 12, 48, 1 << 20
SLICE_BYTES, MOST_SLICES = 32 << 20, 20_000
_EMPTY = np.zeros(0, U64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """48-bit hashes of all shingles of a text, repeats included."""
    if not text:
        return _EMPTY
    h = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1))
    width, power, have, out, done = min(width, len(h)), BASE, 1, None, 0
    # the hash of `width` codes from hashes of powers of two of them
    while True:
        if width & have:
            out, done = (h, have) if out is None else (out[: len(out) - have] * U64(power) + h[done:][: len(out) - have], done + have)
        if have * 2 > width:
            break
        h = h[:-have] * U64(power) + h[have:]
        power, have = power * power % (1 << 64), have * 2
    return mix(out) >> U64(64 - BITS)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct values, sorted."""
    n = len(hashes)
    if n > 8 * k:  # a value of this rank is likely beyond the k-th distinct one
        most = U64(int((1 << BITS) * min(1.0, 4 * k / n)))
        low = np.unique(hashes[hashes < most])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def sketch_of(text: str, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The sketch of a whole text, merged from those of its parts, which overlap by what a shingle spans."""
    out = bottom(shingles(text[: PART + width - 1], width), k)
    for i in range(PART, len(text) - width + 1, PART):
        out = merge(out, bottom(shingles(text[i : i + PART + width - 1], width), k), k)
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what two sketches were made of."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A or B|, exact where both sketches hold less than k hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, n = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((n[:k] == 2).sum() / len(n[:k]))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / float(a[k - 1] + U64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A|."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(U64)


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """docs with fingerprint string and distinct_shingles double."""
    @F.pandas_udf("fingerprint string, distinct_shingles double")
    def sketch(s: pd.Series) -> pd.DataFrame:
        own = [sketch_of(t or "", k, width) for t in s]
        return pd.DataFrame({"fingerprint": [encode(x) for x in own], "distinct_shingles": [distinct(x, k) for x in own]})

    at = sketch(F.coalesce(F.col(text), F.lit("")))
    return docs.drop("fingerprint", "distinct_shingles").withColumn("__s", at).select("*", "__s.fingerprint", "__s.distinct_shingles").drop("__s")


def compare(pairs: DataFrame, a: str = "a", b: str = "b", k: int = K) -> DataFrame:
    """pairs of fingerprint columns with resemblance, containment (of a in b) and merged string."""
    @F.pandas_udf("resemblance double, containment double, merged string")
    def both(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        z = [(decode(p or ""), decode(q or "")) for p, q in zip(x, y)]
        return pd.DataFrame({"resemblance": [resemblance(p, q, k) for p, q in z], "containment": [containment(p, q, k) for p, q in z], "merged": [encode(merge(p, q, k)) for p, q in z]})

    compared = pairs.withColumn("__c", both(a, b))
    taken = [c for c in pairs.columns if c.lower() in ("resemblance", "containment", "merged")]
    return compared.drop(*taken).select("*", "__c.*").drop("__c")


# ---------------------------------------------------------------- the query

FIRST = -(1 << 63)


def in_order(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows (slice, guest, k, t, rows, text), each slice of ids sorted in a partition of its own.

    Slices are ranges of (id, text hash) between quantiles of the ids, about SLICE_BYTES of text
    each, so one shuffle of the texts suffices; an id that spans several quantiles is cut further,
    by its rows' text hashes. The first row of a slice also goes, as a guest, to the slice before,
    where it comes last. What is sent to every task is one row per slice. rows is how many rows
    alike a row stands for.
    """
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(key), F.lit(FIRST)).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = min(MOST_SLICES, max(partitions(spark), -(-size // SLICE_BYTES)))
    d = single(d.select("k", F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit(1)).alias("u"), "text"), ["k", "t", "u"]).drop("u")
    cuts = [float(c) for c in d.stat.approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)]
    # a cut that comes m times: its id holds m slices' rows (where a double tells ids apart)
    wide = [1, *(m if abs(c) < 2**53 or c == FIRST else 1 for c, m in Counter(sorted(cuts)).items())]
    if cuts:
        by = Bucketizer(splits=[float("-inf"), *sorted(set(cuts)), float("inf")], inputCol="__x", outputCol="__y")
        d = by.transform(d.withColumn("__x", F.col("k").cast("double"))).withColumn("__y", F.col("__y").cast("int"))
        cut_ids = [None, *(FIRST if c <= FIRST else int(c) for c in sorted(set(cuts)))]
        base = np.cumsum([0, *(m + (m > 1) for m in wide)]).tolist()
        # one row a slice, so it may be broadcast
        table = spark.createDataFrame(list(zip(range(len(wide)), base, wide, cut_ids)), "__y int, __base int, __wide int, __cut bigint")
        own = F.least(F.col("__wide") - 1, F.floor((F.col("t") / 2.0**64 + 0.5) * F.col("__wide"))).cast("int")
        beyond = (F.col("__wide") > 1) & (F.col("k") > F.col("__cut"))  # the ids after a wide one have a slice of their own
        d = d.join(F.broadcast(table), "__y").withColumn("slice", F.col("__base") + F.when(beyond, F.col("__wide")).otherwise(F.when(F.col("__wide") > 1, own).otherwise(0))).drop("__x", "__y", "__base", "__wide", "__cut")
    else:
        d = d.withColumn("slice", F.lit(0))
    # the first row of every slice that isn't empty, by slice: at most n rows
    first = d.groupBy("slice").agg(F.min(F.struct("k", "t")).alias("f")).orderBy("slice").collect()
    own = F.struct(F.col("slice"), F.lit(False).alias("guest"))
    hosts = [(r["f"]["k"], r["f"]["t"], first[i - 1]["slice"]) for i, r in enumerate(first)]  # before the first: the last
    # one row a slice, so it may be broadcast
    d = d.join(F.broadcast(spark.createDataFrame(hosts, "k bigint, t bigint, host int")), ["k", "t"], "left")
    both = F.array(own, F.struct(F.col("host").alias("slice"), F.lit(True).alias("guest")))
    d = d.withColumn("to", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(both)))
    out = d.select("to.slice", "to.guest", "k", "t", "rows", "text")
    slices = sum(m + (m > 1) for m in wide) if cuts else 1
    return out.repartitionById(slices, F.col("slice").cast("int")).sortWithinPartitions("slice", "guest", "k", "t")


def _pairs(batches):
    """Each row with the row after it in its slice; the guest that ends a slice gets no result. Of rows alike, each but the last is followed by itself."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("distinct_shingles", pa.float64()), ("contained_in_edited", pa.float64())])
    last, lead, rows = None, None, []

    def result(row, after):
        key, text, sketch = row
        cut = len(text) - len(text) // 4
        edited = text[:cut] + after[1][: len(text) // 4]
        other = sketch_of(edited)
        return (key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(sketch), encode(other), resemblance(sketch, other), resemblance(sketch, after[2]), distinct(sketch), containment(sketch, other))

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    for b in batches:
        texts = b.column("text")
        for i, (key, slice_, guest, copies) in enumerate(zip(*(b.column(c).to_pylist() for c in ("k", "slice", "guest", "rows")))):
            text = texts[i].as_py()
            now = (None if key == FIRST else key, text, sketch_of(text))
            if last is not None and slice_ == lead:
                rows.append(result(last, now))
            if copies > 1 and not guest:
                same = result(now, now)
                for j in range(0, copies - 1, 2000):
                    yield flush(rows + [same] * min(2000, copies - 1 - j))
                    rows = []
            last, lead = (None if guest else now), slice_
            if len(rows) >= 2000:
                yield flush(rows)
                rows = []
    if rows:
        yield flush(rows)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, contained_in_edited double"
    return in_order(docs, "text", "doc_id").select("slice", "guest", "k", "rows", "text").mapInArrow(_pairs, kinds)
