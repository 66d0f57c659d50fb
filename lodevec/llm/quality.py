"""Operator 6, quality: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Each whole text becomes a vector of document statistics (STATS). Statistics are standardised with
sums over all training rows, mapped to D random Fourier features of a Gaussian kernel, and a ridge
score is fitted from the sums of Z'Z and Z'y that every partition makes of its own rows; what
reaches the driver is one such sum per partition. The raw score is then calibrated: training rows
are counted in equal-width bins of the score and pool-adjacent-violators makes the rate monotone;
between the blocks' centres it is interpolated, so that calibration keeps the order of the scores.

Cases: null text counts as empty, which has statistics like any other; without labels of both
kinds the score is the mean label (0.5 without any); null doc_id hashes as ''; repeated rows are
scored alike; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import stage
from lodevec.llm.toxicity import fold

D, RIDGE, WIDTH, SEED, BINS = 256, 1e-3, 4.0, 20240601, 512
STATS = ("log_chars", "log_words", "word_length", "upper", "digits", "exclaim", "symbols", "pipes", "full_stops", "commas", "code", "other_ascii", "non_ascii", "white", "distinct_words", "distinct_lines", "log_lines", "line_length", "top_word", "short_words", "long_words", "capital_words", "stopped_words", "hyphen_quote")
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?", b"$%&*#@^~", b"|", b".", b",", b"{}[]()<>=;\\/_`+", b":\"", None, b" \t\n\r\v\f", b"-'"]


def _table() -> np.ndarray:
    out = np.zeros((256, len(_GROUPS)))
    for j, g in enumerate(_GROUPS):
        if g is not None:
            out[list(g), j] = 1
    out[128:, 9] = 1
    return out


def statistics(text: str, table: np.ndarray) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    upper, digits, excl, symbols, pipes, stops, commas, code, other, non, white, hyphen = (np.bincount(raw, minlength=256) @ table / n).tolist()
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    short, long_ = (float((lengths <= 3).sum()) / m, float((lengths > 12).sum()) / m) if words else (0.0, 0.0)
    return [math.log1p(len(text)), math.log1p(len(words)), float(lengths.mean()) if words else 0.0, upper, digits, excl, symbols, pipes, stops, commas, code, other, non, white,
            len(seen) / m, len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)), math.log1p(len(text) / max(1, len(lines))), max(seen.values(), default=0) / m, short, long_,
            sum(map(str.istitle, words)) / m, sum(w[-1] in ".!?,;" for w in words) / m, hyphen]


def measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep` with stats array<double>; a column of that name is replaced."""
    keep = [c for c in keep if c.lower() != "stats"]
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = d.select(*keep).withColumn("stats", F.lit(None).cast("array<double>")).schema

    def run(batches):
        table = _table()
        for b in batches:
            x = np.array([statistics(t, table) for t in b.column("__text").to_pylist()]).reshape(-1, len(STATS))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATS)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), stats], [*keep, "stats"])

    return d.mapInArrow(run, out)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(df: DataFrame, f, size: int) -> np.ndarray:
    """Sum over all rows of f(batch) -> vector of `size`: each partition sends one vector, and those meet in a tree, 32 at a time."""

    def part(batches):
        total = np.zeros(size)
        for b in batches:
            total += f(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def add(batches):
        total = np.zeros(size)
        for b in batches:
            for v in b.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    some, n = df.mapInArrow(part, "v binary"), df.rdd.getNumPartitions()
    while n > 8:  # few partial sums go on to the driver, however many partitions there were
        n = max(8, -(-n // 32))
        some = some.repartition(n).mapInArrow(add, "v binary")
    got = some.collect()
    return np.sum([np.zeros(size), *(np.frombuffer(r["v"]) for r in got)], axis=0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and values of the blocks, for x sorted ascending."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Standardisation, random features, ridge weights and the calibration curve."""

    def __init__(self, mean, scale, omega, phase, beta, centres, values):
        self.mean, self.scale, self.omega, self.phase, self.beta, self.centres, self.values = mean, scale, omega, phase, beta, centres, values

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([math.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase), z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.centres):
            return np.full(len(x), self.values[0])
        r = self.raw(x)
        s = np.interp(r, self.centres, self.values)
        return np.clip(s + 1e-4 * np.tanh(r), 0.0, 1.0)  # beyond the outer centres too, order remains


def train(stats: DataFrame, label: str, d: int = D, ridge: float = RIDGE, width: float = WIDTH, seed: int = SEED) -> Model:
    """stats: rows (stats, label) to learn from, all of them."""
    p = len(STATS)
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(size=(p, d)) / width, rng.uniform(0, 2 * math.pi, d)
    y_of = lambda b: b.column(label).to_numpy(zero_copy_only=False).astype(float)

    def first(b):
        x, y = _matrix(b.column("stats"), p), y_of(b)
        return np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])

    t = _sums(stats, first, 2 + 2 * p)
    n, ones = t[0], t[1]
    if not n or not 0 < ones < n:
        return Model(np.zeros(p), np.ones(p), omega, phase, np.zeros(d + p + 1), np.zeros(0), np.array([ones / n if n else 0.5]))
    mean = t[2 : 2 + p] / n
    scale = np.sqrt(np.maximum(t[2 + p :] / n - mean**2, 1e-12))
    scale = np.where(scale < 1e-5, 1.0, scale)
    m = Model(mean, scale, omega, phase, None, None, None)
    q = d + p + 1

    def normal(b):
        z, y = m.lift(_matrix(b.column("stats"), p)), y_of(b)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    t = _sums(stats, normal, q * q + q)
    a = t[: q * q].reshape(q, q) / n
    m.beta = np.linalg.solve(a + ridge * np.diag(np.append(np.ones(q - 1), 1e-6)), t[q * q :] / n)
    lo, hi = -0.25, 1.25

    def bins(b):
        r, y = m.raw(_matrix(b.column("stats"), p)), y_of(b)
        at = np.clip(((r - lo) / (hi - lo) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, r, BINS)])

    t = _sums(stats, bins, 3 * BINS).reshape(3, BINS)
    own = t[0] > 0
    m.centres, m.values = isotonic(t[2][own] / t[0][own], t[1][own] / t[0][own], t[0][own])
    return m


def score(stats: DataFrame, model: Model) -> DataFrame:
    """stats with score double."""
    keep = [c for c in stats.columns if c.lower() != "score"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(model.score(_matrix(b.column("stats"), len(STATS))))], [*keep, "score"])

    return stats.select(*keep).mapInArrow(run, stats.select(*keep).withColumn("score", F.lit(0.0)).schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    stats = stage(measured(docs, "text", ["doc_id"]), "stats")
    learn = stage(stats.join(labels, "doc_id").where(~fold(F.col("doc_id"))).select("stats", "quality"), "learn")
    s = score(stats, train(learn, "quality"))
    return s.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
