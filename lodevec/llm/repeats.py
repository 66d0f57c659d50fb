"""Operator 4, exact repeated substrings: prefix-free parsing with a depth-bounded suffix array.

Each byte covered by a LENGTH-byte string that also starts earlier in the corpus (smaller doc_id,
or same document and earlier start) is removed; strings never cross documents and are judged on
the input.

Parsing: every run of LENGTH bytes has a trigger, the GRAM-byte window in it whose rolling hash is
least, and consecutive runs with one trigger make a phrase, its bytes included up to the last
run's end. So equal strings always lie in phrases of equal triggers, at the same place relative
to them, whatever surrounds them (a plain "hash modulo p" trigger can leave a string without any).
Dictionary: phrases are grouped by trigger. Of equal phrases all but the earliest are removed
whole; that decides almost everything, as it is only the ends of copied passages that make unlike
phrases share a trigger. Only those phrases' bytes are fetched: their suffixes are ranked by
prefix doubling to depth LENGTH (the dictionary's suffix array, cut at the depth that matters;
equal ranks are equal strings, so no hash decides). Parse: each phrase knows its place in the
corpus, and ranks together with places put suffixes in corpus order; all but the first of each
rank are removed. The parse needs no suffix array of its own, as a phrase holds all LENGTH bytes
of each of its suffixes.

Scale: a phrase starts about every 32 bytes. It is shuffled as about 25 bytes in packed columns;
equal phrases are first merged within each batch, so that a passage that a third of all documents
share leaves one phrase per batch, and spans that touch are merged before they are sent. Phrases
are compared within the trigger's group only, by 40 + 48 hash bits beside those that name the
group; texts are shuffled twice, by document. The number of groups follows from the bytes of the
table (GROUP_BYTES of text a group), so that a task's memory is the same at every size. Rows that
repeat more than REPEATS times (one id and one text) are worked on once and multiplied at the end.

Cases: null text counts as empty; a text shorter than LENGTH is kept; a null doc_id comes before
all others; rows that agree in id and text are one document and are treated alike, rows that agree
in id alone are told apart and ordered by 128 hash bits of the text; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import REPEATS, U64, byte_codes, mix, powers, runs, single, stage, utf8

LENGTH, GRAM = 100, 32
CHUNK = 1 << 19
GROUP_BYTES, LEAST_GROUPS, MOST_TASKS = 8 << 20, 8, 20_000
FIRST = -(1 << 63)


def phrases(raw: np.ndarray, offsets: np.ndarray, codes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Phrases of consecutive rows of less than 2**20 bytes: arrays row, start, spread, trigger (place in
    the phrase), hash of the trigger, hash of the phrase. A phrase has spread + 1 runs of `length` bytes."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    total = np.zeros(n + 1, U64)
    np.cumsum(codes[raw] * powers(n), out=total[1:])
    inv = powers(n + 1, True)
    g = mix((total[gram:] - total[:-gram]) * inv[: n - gram + 1])
    m = (g & U64(0xFFFFFFFFFFF00000)) | np.arange(len(g), dtype=U64)  # the place breaks ties
    span, have = length - gram + 1, 1
    while have * 2 <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if span > have:
        m = np.minimum(m[: len(m) - (span - have)], m[span - have :])
    trigger = (m & U64(0xFFFFF)).astype(np.int64)  # of the run that starts here
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(trigger)]
    at = np.flatnonzero(np.arange(len(trigger)) + length <= offsets[1:][row])
    if not len(at):
        return none, none, none, none, none.astype(U64), none.astype(U64)
    t, r = trigger[at], row[at]
    new = np.append(True, (t[1:] != t[:-1]) | (r[1:] != r[:-1]))
    a = at[new]
    b = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    t, r = t[new], r[new]
    whole = mix((total[b + length] - total[a]) * inv[a] + ((b - a) * 128 + (t - a)).astype(U64))
    return r, a - offsets[r], b - a, t - a, g[t], whole


def all_phrases(raw: np.ndarray, offsets: np.ndarray, codes: np.ndarray):
    """The same of rows of any length."""
    parts = []
    for i, j in runs(offsets, CHUNK):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * CHUNK - LENGTH:
            r, a, *rest = phrases(raw[lo:hi], offsets[i : j + 1] - lo, codes)
            parts.append((r + i, a, *rest))
            continue
        for s in range(lo, hi, CHUNK):  # one long row: its runs by where they start
            end = min(hi, s + CHUNK + LENGTH - 1)
            r, a, *rest = phrases(raw[s:end], np.array([0, end - s]), codes)
            parts.append((r + i, a + (s - lo), *rest))
    if not parts:
        return phrases(raw[:0], np.zeros(1, np.int64), codes)
    return tuple(np.concatenate(x) for x in zip(*parts))


# ---------------------------------------------------------------- packed columns


def pack(*columns: tuple[np.ndarray, str]) -> bytes:
    """Arrays of one length as compressed little-endian bytes."""
    import zstandard

    body = b"".join(np.ascontiguousarray(c, d).tobytes() for c, d in columns)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    import zstandard

    z, width, out = zstandard.ZstdDecompressor(), sum(np.dtype(k).itemsize for k in kinds), [[] for _ in kinds]
    for b in blobs:
        if not b:
            continue
        body = z.decompress(b)
        n, at = len(body) // width, 0
        for o, k in zip(out, kinds):
            o.append(np.frombuffer(body, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds)]


# a document is (k, t, u): its id and two hashes of its text
ENTRY = ("<u4", "u1", "<u4", "<u2", "<i8", "<i8", "<i8", "<i4", "u1", "u1")  # trigger hash 32 + 8, phrase hash 32 + 16, document, start, spread, trigger
SPAN = ("<i8", "<i8", "<i8", "<i4", "<i4")  # document, start, end
ASK = ("<i8", "<i8", "<i8", "<i4", "u1", "<i8")  # document, start, spread, trigger hash


def _split(part: np.ndarray, *columns: tuple[np.ndarray, str]):
    """(part, packed columns) for each part that occurs."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [(c[order], d) for c, d in columns]
    cut = np.flatnonzero(np.append(len(part) > 0, part[1:] != part[:-1]))
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
        yield int(part[i]), pack(*((c[i:j], d) for c, d in columns))


def _bucket(k: np.ndarray, t: np.ndarray, buckets: int) -> np.ndarray:
    """As _keyed has it."""
    return (np.mod(k.astype(np.int64), buckets) * 7919 + np.mod(t.astype(np.int64), buckets)) % buckets


def _earliest(h, w, k, t, u, a):
    """Order by (h, w, place), where groups of equal (h, w) begin, and which rows stand later than their group's first."""
    order = np.lexsort((a, u, t, k, w, h))
    h, w, k, t, u, a = h[order], w[order], k[order], t[order], u[order], a[order]
    new = np.append(np.full(min(1, len(h)), True), (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    return order, new, (k != k[first]) | (t != t[first]) | (u != u[first]) | (a != a[first])


def merged(k, t, u, a, e):
    """Spans sorted by document and start; those that touch or overlap made one."""
    order = np.lexsort((a, u, t, k))
    k, t, u, a, e = k[order], t[order], u[order], a[order].astype(np.int64), e[order].astype(np.int64)
    if not len(k):
        return k, t, u, a, e
    doc = np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1]))
    shift = (np.cumsum(doc) - 1) << 32  # documents one after another, so that one running maximum does
    end = np.maximum.accumulate(shift + e)
    new = np.append(True, shift[1:] + a[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(k) - 1)
    return k[new], t[new], u[new], a[new], end[last] - shift[last]


# ---------------------------------------------------------------- the steps


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows (k, t, u, text)."""
    d = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(FIRST)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.select("k", F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit(1)).alias("u"), "text")


def _bucketed(d: DataFrame, buckets: int) -> DataFrame:
    b = F.lit(buckets).cast("long")
    return d.withColumn("bucket", F.pmod(F.pmod("k", b) * 7919 + F.pmod("t", b), b))


def _parse(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (part, entries, gone): packed phrases by trigger, merged within the batch, and spans decided already."""

    def run(batches):
        codes = byte_codes(False)
        for b in batches:
            if not b.num_rows:
                continue
            raw, off = utf8(b.column("text"))
            r, a, s, x, h, w = all_phrases(raw, off, codes)
            k, t, u = (b.column(c).to_numpy()[r] for c in "ktu")
            order, new, later = _earliest(h, w, k, t, u, a)
            gone = order[later]
            # the order of the input packs best
            own = np.sort(order[new])
            spans = merged(k[gone], t[gone], u[gone], a[gone], a[gone] + s[gone] + LENGTH)
            h, w = h[own], w[own]
            part, h = (h % U64(parts)).astype(np.int64), h // U64(parts)
            rows = list(_split(part, *zip((h & U64(0xFFFFFFFF), h >> U64(32) & U64(0xFF), w & U64(0xFFFFFFFF), w >> U64(32) & U64(0xFFFF), k[own], t[own], u[own], a[own], s[own], x[own]), ENTRY)))
            if not rows:
                continue
            blobs = [pack(*zip(spans, SPAN))] + [b""] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.binary()), pa.array(blobs, pa.binary())], ["part", "entries", "gone"])

    return docs.select("k", "t", "u", "text").mapInArrow(run, "part int, entries binary, gone binary")


def _decider(parts: int, buckets: int):
    """part -> rows (bucket, gone, ask): spans to remove, and phrases whose bytes must be seen."""

    def run(table):
        h0, h1, w0, w1, k, t, u, a, s, x = unpack(table.column("entries").to_pylist(), *ENTRY)
        spans = unpack(table.column("gone").to_pylist(), *SPAN)
        h, w = h0.astype(U64) | (h1.astype(U64) << U64(32)), w0.astype(U64) | (w1.astype(U64) << U64(32))
        w = w * U64(256) + x  # phrases are equal if their triggers' places are, too
        order, new, later = _earliest(h, w, k, t, u, a)
        gone = order[later]
        more = k[gone], t[gone], u[gone], a[gone], a[gone] + s[gone].astype(np.int32) + LENGTH
        spans = merged(*(np.append(c, d) for c, d in zip(spans, more)))
        hs = h[order]
        group = np.cumsum(np.append(np.full(min(1, len(hs)), True), hs[1:] != hs[:-1])) - 1
        unlike = np.bincount(group[new])[group] > 1 if len(hs) else np.zeros(0, bool)
        ask = order[new & unlike]
        part = table.column("part")[0].as_py()
        name = mix(h[ask] * U64(parts) + U64(part)).view(np.int64)  # the whole hash again: tells triggers apart within a later group
        left = dict(_split(_bucket(spans[0], spans[1], buckets), *zip(spans, SPAN)))
        want = dict(_split(_bucket(k[ask], t[ask], buckets), *zip((k[ask], t[ask], u[ask], a[ask], s[ask], name), ASK)))
        own = sorted(left.keys() | want.keys())
        return pa.table({"bucket": pa.array(own, pa.int64()), "gone": pa.array([left.get(i) for i in own], pa.binary()), "ask": pa.array([want.get(i) for i in own], pa.binary())})

    return run


def _fetcher(parts: int):
    """A bucket's documents and its requests -> rows (part, places, bytes): the phrases asked for, by trigger."""

    def run(docs, asks):
        empty = pa.table({"part": pa.array([], pa.int32()), "places": pa.array([], pa.binary()), "bytes": pa.array([], pa.binary())})
        k, t, u, a, s, h = unpack(asks.column("ask").to_pylist(), *ASK)
        if not len(k) or not docs.num_rows:
            return empty
        raw, off = utf8(docs.column("text"))
        row = {key: i for i, key in enumerate(zip(*(docs.column(c).to_pylist() for c in "ktu")))}
        at = off[np.array([row[key] for key in zip(k.tolist(), t.tolist(), u.tolist())])] + a
        part = (mix(h.view(U64)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, k, t, u, a, s, h, at = (c[order] for c in (part, k, t, u, a, s, h, at))
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        out: tuple[list, list, list] = ([], [], [])
        for i, j in zip(cut, [*cut[1:], len(part)]):
            out[0].append(int(part[i]))
            out[1].append(pack(*((c[i:j], d) for c, d in zip((k, t, u, a, s, h), ASK))))
            out[2].append(b"".join(raw[p : p + LENGTH + n].tobytes() for p, n in zip(at[i:j].tolist(), s[i:j].tolist())))
        return pa.table({"part": pa.array(out[0], pa.int32()), "places": pa.array(out[1], pa.binary()), "bytes": pa.array(out[2], pa.binary())})

    return run


def suffix_ranks(raw: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of each suffix by its first `length` bytes (the end counts as zeros): equal ranks, equal bytes. Prefix doubling."""
    n = len(raw)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = raw
    words = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(U64)
    _, rank = np.unique(words, return_inverse=True)
    have = 8
    while have < length:
        step = min(have, length - have)
        then = np.zeros(n, U64)
        then[: n - step] = rank[step:] + 1
        _, rank = np.unique((rank.astype(U64) << U64(32)) | then, return_inverse=True)
        have += step
    return rank


def _resolver(buckets: int):
    """part -> rows (bucket, gone): of runs with equal bytes all but the first in the corpus."""

    def run(table):
        k, t, u, a, s, h = unpack(table.column("places").to_pylist(), *ASK)
        raw = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        n = s.astype(np.int64) + 1
        base = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        rank = suffix_ranks(raw)
        order = np.lexsort((a, u, t, k))
        place = np.empty(len(k), np.int64)
        place[order] = np.arange(len(k))
        e = np.repeat(np.arange(len(k)), n)
        o = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
        key = rank[base[e] + o].astype(np.int64)
        by = np.lexsort((place[e] * 128 + o, key))
        later = np.append(np.full(min(1, len(by)), False), key[by][1:] == key[by][:-1])
        hit = np.zeros(len(e), bool)
        hit[by] = later
        # consecutive runs of a phrase make one span
        at = np.flatnonzero(hit)
        new = np.append(np.full(min(1, len(at)), True), (at[1:] != at[:-1] + 1) | (e[at[1:]] != e[at[:-1]]))
        i = at[new]
        j = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else at
        spans = merged(k[e[i]], t[e[i]], u[e[i]], a[e[i]] + o[i], a[e[i]] + o[j] + LENGTH)
        rows = list(_split(_bucket(spans[0], spans[1], buckets), *zip(spans, SPAN)))
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "gone": pa.array([g for _, g in rows], pa.binary())})

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finisher(keep: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * keep + ["rows"]

    def run(docs, spans):
        raw, off = utf8(docs.column("text")) if docs.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        k, t, u, a, e = merged(*unpack(spans.column("gone").to_pylist(), *SPAN))
        cut = np.flatnonzero(np.append(np.full(min(1, len(k)), True), (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1])))
        of = {(int(k[i]), int(t[i]), int(u[i])): (i, j) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(k)])}
        cols: list[list] = [[] for _ in names]
        copies = docs.column("rows").to_pylist()
        for d, key in enumerate(zip(*(docs.column(c).to_pylist() for c in "ktu"))):
            own, runs_, kept = raw[off[d] : off[d + 1]], [], None
            if key in of:
                i, j = of[key]
                begin, end = a[i:j], e[i:j]
                runs_ = list(zip(begin.tolist(), (end - begin).tolist()))
                edge = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(own)]
                kept = b"".join(own[edge[i] : edge[i + 1]].tobytes() for i in range(0, len(edge), 2))
            else:
                kept = own.tobytes()
            row = (None if key[0] == FIRST else key[0], len(own), len(own) - len(kept), len(runs_), hashlib.sha256(kept).hexdigest())
            for c, v in zip(cols, row + ((kept, [{"start": p, "length": q} for p, q in runs_]) if keep else ()) + (copies[d],)):
                c.append(v)
        types = [pa.int64()] * 4 + [pa.string()] + ([pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))] if keep else []) + [pa.int64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types)})

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256;
    with keep also kept binary (the bytes that stay) and spans array<struct<start,length>>."""
    d = _keyed(docs, text, key)
    size = d.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    d = single(d, ["k", "t", "u"], most=REPEATS)
    groups = max(LEAST_GROUPS, -(-size // GROUP_BYTES))
    tasks = min(groups, MOST_TASKS)
    d = _bucketed(d, groups)
    by = lambda df, c: df.repartition(tasks, c).groupBy(c)
    found = by(_parse(d, groups), "part").applyInArrow(_decider(groups, groups), "bucket long, gone binary, ask binary")
    found = stage(found, "found")
    asks = found.where("ask IS NOT NULL").select("bucket", "ask")
    fetched = by(d.drop("rows"), "bucket").cogroup(by(asks, "bucket")).applyInArrow(_fetcher(groups), "part int, places binary, bytes binary")
    ends = stage(by(fetched, "part").applyInArrow(_resolver(groups), "bucket long, gone binary"), "ends")
    spans = found.where("gone IS NOT NULL").select("bucket", "gone").unionByName(ends)
    out = RESULT + ", kept binary, spans array<struct<start:long,length:long>>" * keep
    done = by(d, "bucket").cogroup(by(spans, "bucket")).applyInArrow(_finisher(keep), out + ", rows long")
    columns = [c for c in done.columns if c != "rows"]
    return done.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(*columns)


def op4_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
