"""Operator 3, toxicity: multiple-instance learning with noisy-or over sentences.

A document is a bag of sentences. A sentence's score is sigmoid(bias + sum of the weights of its
distinct words), a word's weight the sum over its features: the word in lower case and its
prefixes of 3 to 7 letters. The document's score is 1 - prod(1 - sentence score); bias and
weights are fitted to document labels by that likelihood, so training finds the sentences that
explain a label, and sentences of score >= 0.5 are the offending ones.

The model is fitted on a bounded sample of labelled rows outside the held-out fold: at most
TRAIN_DOCS of each label (least hash of the id), TRAIN_CHARS characters of each (a text that doesn't
fit is passed over for the next; where none fits, the shortest is taken), reweighted to the labels'
shares; features are the at most FEATURES most associated ones of those with
association above MIN_Z. The bounds make one task enough for training (it holds words and features
as numbers in flat arrays) and the model small enough to go with the scoring function. Scoring
takes every row and the whole of each text.

Cases: null or empty texts have no sentence and score 0; without labels of both kinds every score
is 0; a null doc_id hashes as ''; repeated rows are scored alike; other columns pass through,
those named like a result are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import runs, trim, trimmed

TRAIN_DOCS, TRAIN_CHARS, FEATURES, MIN_Z, STEPS, RIDGE = 4000, 20_000_000, 3000, 3.5, 250, 5e-5
SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")
SOME = re.compile(r"\w[^.!?\n]*")  # one match a sentence with a word
CACHE = 300_000


def fold(key: Column) -> Column:
    """True for the held-out fifth."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def features(word: str) -> list[str]:
    w = word.lower()
    return ["=" + w, *("^" + w[:k] for k in range(3, 8) if len(w) >= k)]


def sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """Rows (text, label, n): labelled documents outside the held-out fold; n is how many such labels there are of that kind.

    Of rows that share an id, the text of least hash stands for it. Which texts fit is decided on
    their lengths, at most 2 * `most` rows, before any text is moved.
    """
    spark = docs.sparkSession
    own = labels.where(~fold(F.col(key)) & F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).distinct()
    ids = None
    for y in (0, 1):
        one = own.where(F.col("label") == y)
        one = one.orderBy(F.xxhash64("k"), "k").limit(most).withColumn("n", F.lit(one.count()))
        ids = one if ids is None else ids.unionByName(one)
    d = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    of = d.join(F.broadcast(ids), "k")  # at most 2 * most rows
    least = of.groupBy("k", "label", "n").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("chars"))).alias("t"))
    rows = least.select("k", "label", "n", "t.h", "t.chars").orderBy(F.xxhash64("k"), "k").collect()
    taken = []
    for y in (0, 1):
        mine, left = [r for r in rows if r["label"] == y], chars
        before = len(taken)
        for r in mine:
            if r["chars"] <= left:
                taken.append(r)
                left -= r["chars"]
        if mine and len(taken) == before:
            taken.append(min(mine, key=lambda r: r["chars"]))
    chosen = spark.createDataFrame([(r["k"], r["label"], r["n"], r["h"]) for r in taken], ids.select("k", "label", "n").schema.add("h", "long"))
    got = d.join(F.broadcast(chosen), "k").where(F.xxhash64("text") == F.col("h"))
    return got.groupBy("k", "label", "n").agg(F.first("text").alias("text")).select("text", "label", "n")


def _known(words: Iterable[str], number: dict[str, int], new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each word's features that have one, and n + 1 offsets into them; words marked in new number theirs first."""
    of, ends = array("i"), array("q", [0])
    for i, w in enumerate(words):
        if new is None:
            of.extend([number[f] for f in features(w) if f in number])
        elif new[i]:
            of.extend([number.setdefault(f, len(number)) for f in features(w)])
        ends.append(len(of))
    return np.array(of, np.int32), np.array(ends, np.int64)


def _of_words(ids: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of some words one after the other, and how many each has."""
    of, ends = known
    n = ends[ids + 1] - ends[ids]
    return of[np.repeat(ends[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def fit(texts: Iterable[str], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> tuple[float, dict[str, float]]:
    """(bias, weight of each feature). Texts are read once; their words are kept as numbers in flat arrays."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return -30.0, {}
    number: dict[str, int] = {}
    flat, sizes, bags = array("i"), array("i"), array("i")  # distinct words of each sentence, their number, sentences of each text
    for t in texts:
        before = len(sizes)
        for m in SENTENCE.finditer(t):
            own = sorted({number.setdefault(w, len(number)) for w in WORD.findall(m.group())})
            flat.extend(own)
            sizes.append(len(own))
        bags.append(len(sizes) - before)
    flat, bags = np.array(flat, np.int32), np.array(bags, np.int64)
    ends, k = np.append(0, np.cumsum(np.array(sizes, np.int64))), len(sizes)
    edges = ends[np.append(0, np.cumsum(bags))]  # of each text's words

    def texts_with(y: int, most: int) -> np.ndarray:
        """How many texts of label y have each feature of a number below `most`."""
        out = np.zeros(most, np.int64)
        for d in np.flatnonzero(labels == y).tolist():
            out[np.unique(_of_words(np.unique(flat[edges[d] : edges[d + 1]]), known)[0])] += 1
        return out

    positive, at = np.zeros(len(number), bool), {}
    for d in np.flatnonzero(labels == 1).tolist():
        positive[flat[edges[d] : edges[d + 1]]] = True
    known = _known(number, at, positive)
    pos = texts_with(1, len(at))
    names = {f: i for f, i in at.items() if pos[i] >= 3}
    known = _known(number, names)
    neg = texts_with(0, len(at))
    del number, at
    cand = np.array(list(names.values()), np.int64)
    p, q = (pos[cand] + 0.5) / (n1 + 1), (neg[cand] + 0.5) / (n0 + 1)
    m = (pos[cand] + neg[cand] + 1) / (n1 + n0 + 2)
    z = dict(zip(names, ((p - q) / np.sqrt(m * (1 - m) * (1 / n1 + 1 / n0) + 1e-12)).tolist()))
    best = sorted((f for f in z if z[f] > MIN_Z), key=lambda f: (-z[f], f))[:FEATURES]
    at = {f: i for i, f in enumerate(best)}
    rank = np.full(len(pos), -1, np.int32)
    rank[[names[f] for f in best]] = np.arange(len(best))
    of = rank[known[0]]
    known = of[of >= 0], np.append(0, np.cumsum(of >= 0))[known[1]]
    del names, z, of
    s_of, f_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # sentence and feature of each entry
    for i, j in runs(ends, 1 << 18):
        f, n = _of_words(flat[ends[i] : ends[j]], known)
        s = np.repeat(np.repeat(np.arange(i, j), np.diff(ends[i : j + 1])), n)
        pair = np.unique(s * (len(best) + 1) + f)
        s_of.append(pair // (len(best) + 1))
        f_of.append(pair % (len(best) + 1))
    doc_of, s_of, f_of = np.repeat(np.arange(len(bags)), bags), np.concatenate(s_of), np.concatenate(f_of)
    del flat, known
    theta = np.zeros(len(best) + 1)
    theta[-1] = -6.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    y, n = labels.astype(float), len(labels)
    weights = weights / weights.sum()
    for t in range(1, steps + 1):
        zs = theta[-1] + np.bincount(s_of, theta[f_of], k) if len(s_of) else np.full(k, theta[-1])
        ps = 1 / (1 + np.exp(-np.clip(zs, -30, 30)))
        log0 = np.bincount(doc_of, -np.logaddexp(0, np.clip(zs, -30, 30)), n)  # log of P(label 0)
        p = np.clip(-np.expm1(log0), 1e-9, 1 - 1e-12)
        # d(log-likelihood)/dz: label 0: -sigmoid(z); label 1: sigmoid(z) (1 - p) / p
        g = np.where(y == 1, (1 - p) / p, -1.0) * weights
        gs = g[doc_of] * ps
        grad = np.append(np.bincount(f_of, gs[s_of], len(best)), gs.sum()) - RIDGE * np.append(theta[:-1], 0)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        theta += 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return float(theta[-1]), {f: float(theta[i]) for f, i in at.items() if abs(theta[i]) > 1e-3}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", **bounds) -> tuple[float, dict[str, float]]:
    """Fit in one task on the bounded sample; the model comes to the driver (at most FEATURES weights)."""

    def task(t: pa.Table) -> pa.Table:
        trim()
        y, n = t.column("label").to_numpy(), t.column("n").to_numpy()
        share = np.array([n[y == v][0] / max(1, (y == v).sum()) if (y == v).any() else 0.0 for v in (0, 1)])
        bias, w = fit((x.as_py() for x in t.column("text")), y, share[y])
        trim()
        return pa.table({"f": pa.array(["", *w], pa.string()), "w": pa.array([bias, *w.values()], pa.float64())})

    got = sample(docs, labels, label, text, key, **bounds).groupBy().applyInArrow(task, "f string, w double").collect()
    model = {r["f"]: r["w"] for r in got}
    return model.pop("", -30.0), model


def scorer(bias: float, model: dict[str, float]):
    """text -> (score, [(start, length, sentence score), ...] of the sentences with score >= 0.5)"""
    from math import exp

    base = 1 / (1 + exp(-max(-30.0, bias)))
    misses: set[str] = set()  # words without a weight
    sets: dict[str, frozenset] = {}
    heads = {f[1:4] for f in model}  # every word with a weight begins like a feature

    def look(w: str) -> bool:
        hit = w.lower()[:3] in heads and frozenset(f for f in features(w) if f in model)
        if hit:
            sets[w] = hit
        elif len(misses) < CACHE:
            misses.add(w)
        return bool(hit)

    def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
        if len(sets) > CACHE:
            sets.clear()
        # a sentence without a word of weight has the score `base`, so most texts need no more than how many there are
        hits = {w for w in set(WORD.findall(text)).difference(misses) if w in sets or look(w)}
        n, keep, spans = sum(1 for _ in SOME.finditer(text)), 1.0, []
        if hits:
            for m in SENTENCE.finditer(text):
                own = hits.intersection(WORD.findall(m.group()))
                if own:
                    z = bias + sum(model[f] for f in set().union(*(sets[w] for w in own)))
                    p = 1 / (1 + exp(-max(-30.0, min(30.0, z))))
                    if p >= 0.5:
                        spans.append((m.start(), m.end() - m.start(), p))
                    keep *= 1 - p
                    n -= 1
        return 1 - keep * (1 - base) ** n, spans

    return score


def score(docs: DataFrame, model: tuple[float, dict[str, float]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score double and offending array<struct<start,length,score>>."""
    bias, weights = model
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "offending")]
    d = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = "array<struct<start:int,length:int,score:double>>"
    out = d.select(*keep).withColumns({"score": F.lit(0.0), "offending": F.lit(None).cast(kind)}).schema

    def run(batches):
        of = scorer(bias, weights)
        span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            got = [of(t) for t in b.column("__text").to_pylist()]
            arrays = [b.column(c) for c in keep] + [pa.array([g[0] for g in got], pa.float64()), pa.array([[dict(zip(("start", "length", "score"), s)) for s in g[1]] for g in got], span)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "score", "offending"])

    return d.mapInArrow(trimmed(run), out)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    s = score(docs, train(docs, labels), keep=["doc_id"])
    return s.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "offending")
