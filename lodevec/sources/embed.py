"""Embedders: text -> array<float>. Providers are plugged in; the default needs no network."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 96


def hashing_embedder(dim: int = 384) -> Callable[[Column], Column]:
    """Words and word pairs hashed with a sign into dim components, then made a unit vector. Deterministic."""

    def embed(texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        import numpy as np

        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts):
            words = re.findall(r"\w+", t.lower())
            for w in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h & 0x40000000 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0).astype(np.float32).tolist()

    return provider(embed, dim)


def provider(embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = BATCH) -> Callable[[Column], Column]:
    """Wrap a function of a batch of texts; it is called with at most `batch` texts, and its vectors' length is checked.

    Only those texts and their vectors are Python objects at a time, however many come in one Arrow batch.
    """
    kind = pa.list_(pa.float32())

    def run(texts: pa.Array) -> pa.Array:
        out = [pa.array([], kind)]
        for i in range(0, len(texts), batch):
            values = [t or "" for t in texts.slice(i, batch).to_pylist()]
            got = embed(values)
            if len(got) != len(values) or any(len(v) != dim for v in got):
                raise ValueError(f"the embedder must give one vector of {dim} components a text")
            out.append(pa.array(got, kind))
        return pa.concat_arrays(out)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<float>")
