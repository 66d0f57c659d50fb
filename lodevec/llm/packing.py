"""Operator 7, best-fit packing: bound-certified repacking of documents into token sequences.

A document is its token ids and an end mark. One longer than SIZE is cut into pieces of SIZE, the
first of which holds the remainder. Pieces are dealt to partitions by a hash; each partition runs
best-fit decreasing over its pieces and computes a lower bound of its number of sequences from
dual-feasible functions (`lower_bound`). A partition that meets its bound is certified: no packing
of its pieces needs less. It gives up its emptiest sequence only. The others keep their full
sequences and give up the pieces of those with gaps. What is given up meets in fewer partitions,
none larger than before, and is packed again, until one partition's worth is left or their number
shrinks no more; the last round keeps all.

Scale: texts are read once and never shuffled; a row of the shuffles is a piece (about 40 bytes).
A partition of any round holds about PIECES pieces. Each later round handles only what is left open,
in a SPREADth of the partitions, or more where PIECES asks for more.

Cases: null text counts as empty (its only token is the end mark); null doc_id and repeated rows
are documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import stage, trimmed, unstage

SIZE, END, PIECES, SPREAD = 2048, 0, 250_000, 16


# ---------------------------------------------------------------- tokens


def encoder(tiktoken_file: str, pattern: str, added: dict[str, int] | None = None):
    """text -> its token ids as little-endian uint32 bytes; strings in `added` are one token of that id, all else is ordinary text."""
    import base64

    import tiktoken

    with open(tiktoken_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    special = set(added or ())
    return lambda text: np.array(encode.encode(text, allowed_special=special, disallowed_special=()), "<u4").tobytes()


def added_tokens(json_file: str) -> dict[str, int]:
    """The added tokens of a tokenizer's json, which `tokenizers` finds inside texts, too."""
    with open(json_file, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, vocabulary: str = "byte_bpe_50k", keep: bool = False, added: bool = False) -> DataFrame:
    """Rows (doc_id, row, piece, start, length, ids_crc32), with keep also ids array<int>.

    row tells documents of equal id apart. vocabulary names a public tokenizer's pair of files.
    With added, its json's added tokens are found in texts, as by the tokenizer as loaded; without, they are ordinary text.
    """
    import public_tokenizers as P

    file, pattern = P.path(f"{vocabulary}.tiktoken"), P.PATTERN
    extra = added_tokens(P.path(f"{vocabulary}.json")) if added else {}
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = "doc_id long, row long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * keep

    def run(batches):
        from pyspark import TaskContext

        ids_of, at = encoder(file, pattern, extra), TaskContext.get().partitionId() << 40
        end = np.array([END], "<u4").tobytes()
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * keep
        names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep
        for b in batches:
            rows = []
            for k, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = (ids_of(t) if t else b"") + end
                n, start, j = len(own) // 4, 0, 0
                while start < n:
                    length = (n - start) % size or size if n > size and not j else min(size, n - start)
                    cut = own[4 * start : 4 * (start + length)]
                    rows.append((k, at, j, start, length, zlib.crc32(cut)) + ((np.frombuffer(cut, "<u4").astype(np.int32),) if keep else ()))
                    start, j = start + length, j + 1
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    return d.mapInArrow(trimmed(run), kind)


# ---------------------------------------------------------------- packing


def lower_bound(counts: np.ndarray, size: int = SIZE) -> int:
    """At least so many sequences are needed; counts[l] pieces have length l.

    The best of the identity (total length), the functions u_k (k = 1..20) of Fekete and Schepers,
    and their threshold functions, which raise pieces beyond size - e to whole sequences and drop
    those below e, for every e up to half.
    """
    n = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * n).sum()) // size)
    for k in range(1, 21):
        w = np.where((k + 1) * n % size == 0, n * k, (k + 1) * n // size * size)  # times 1 / (size * k)
        best = max(best, -(-int((counts * w).sum()) // (size * k)))
    whole, length = np.cumsum(counts[::-1])[::-1], np.append(0, np.cumsum(counts * n))
    e = np.arange(0, size // 2 + 1)
    above = np.where(size - e + 1 < len(counts), whole[np.minimum(size - e + 1, len(counts) - 1)], 0)
    middle = length[np.minimum(size - e, len(counts) - 1) + 1] - length[np.minimum(e, len(counts) - 1)]
    return max(best, int((above + -(-middle // size)).max()))


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each piece, offset of each piece, fill of each bin)."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(size + 1)]  # bins by what still fits
    have, fills = 0, []  # bit r of have: some bin has room r
    for i, l in zip(order.tolist(), lengths[order].tolist()):
        fit = have >> l
        if fit:
            room = l + (fit & -fit).bit_length() - 1
            own = open_[room]
            b = own.pop()
            if not own:
                have &= ~(1 << room)
        else:
            b, room = len(fills), size
            fills.append(0)
        where[i], offset[i] = b, size - room
        fills[b] = size - room + l
        if room > l:
            open_[room - l].append(b)
            have |= 1 << (room - l)
    return where, offset, np.array(fills, np.int64)


def _pack(table: pa.Table, size: int, last: bool) -> pa.Table:
    """One partition: columns bin and offset; done is False for pieces to exchange."""
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
    lengths = table.column("length").to_numpy()
    where, offset, fills = best_fit(lengths, size)
    certified = len(fills) <= lower_bound(np.bincount(lengths, minlength=size + 1), size)
    if last:
        done = np.full(len(lengths), True)
    elif certified:  # its emptiest sequence may yet be filled with others'
        done = where != np.argmin(fills)
    else:
        done = fills[where] == size
    return table.append_column("bin", pa.array(where)).append_column("offset", pa.array(offset.astype(np.int32))).append_column("done", pa.array(done)).append_column("certified", pa.array(np.full(len(lengths), certified)))


def _packer(size: int, last: bool):
    return lambda table: _pack(table, size, last)


def pack(pieces: DataFrame, size: int = SIZE, most: int = PIECES, spread: int = SPREAD) -> DataFrame:
    """pieces (doc_id, row, piece, length and any others) with sequence_id long and offset long."""
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset", "bin", "done", "certified", "part", "round")]
    left, out, step = stage(pieces.select(*own), "pieces"), [], 0
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema)
    n = left.count()
    parts, before = max(1, -(-n // most)), None
    while True:
        last = parts == 1 or before is not None and parts >= before
        dealt = left.withColumn("part", F.pmod(F.xxhash64("doc_id", "row", "piece", F.lit(step)), F.lit(parts)))
        packed = dealt.repartition(min(parts, 20_000), "part").groupBy("part").applyInArrow(_packer(size, last), f"{names}, part long, bin long, offset int, done boolean, certified boolean")
        packed = stage(packed, f"packed-{step}")
        if not step:
            unstage(left)
        number = (F.lit(step).cast("bigint") * (1 << 56)) + F.col("part") * (1 << 28) + F.col("bin")
        out.append(packed.where("done").select(*own, number.alias("sequence_id"), F.col("offset").cast("bigint").alias("offset"), "certified", F.lit(step).alias("round")))
        left = packed.where("NOT done").select(*own)
        open_ = 0 if last else left.count()
        if not open_:
            break
        before, parts, step = parts, max(1, parts // spread, -(-open_ // most)), step + 1
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(pieces(docs, added=True)).select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset", "certified", "round")
