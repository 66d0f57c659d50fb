"""NDJSON interchange: one object a line with id, vector (base64 of float32), text, timestamp."""

from __future__ import annotations

import json
import os
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions import vectors

LINE = "id bigint, vector string, text string, timestamp string"


def export_range(rows: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """Lines (id, value) of live rows with start <= id < end (0: no end), to be written in id order."""
    if end and start > end:
        raise ValueError("start is beyond end")
    r = rows.where(F.col("id") >= start)
    r = r.where(F.col("id") < end) if end else r
    line = F.struct("id", F.regexp_replace(vectors.encode_base64(F.col("vector")), r"\s", "").alias("vector"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ts", F.lit("")).alias("timestamp"))
    return r.select("id", F.to_json(line).alias("value"))


def write_ndjson(rows: DataFrame, path: str, start: int = 0, end: int = 0, single: bool = False) -> None:
    """Range-partitioned text files in id order; single makes one file, in one task."""
    out = export_range(rows, start, end).orderBy("id").select("value")
    (out.coalesce(1) if single else out).write.text(path)


def parse_lines(lines: DataFrame, dim: int, *keep: str) -> DataFrame:
    """Rows (vector, text, ts, problem) of text lines (value); blank lines are left out. problem is null for good lines."""
    j = F.from_json("value", LINE)
    v = vectors.decode_base64(F.col("j.vector"), dim)
    d = lines.where(F.trim("value") != "").withColumn("j", j)
    problem = F.when(F.col("j").isNull() | F.col("j.vector").isNull(), "malformed").when(F.col("v").isNull(), "short vector")
    return d.withColumn("v", v).select(F.col("v").alias("vector"), F.coalesce("j.text", F.lit("")).alias("text"), F.coalesce("j.timestamp", F.lit("")).alias("ts"), problem.alias("problem"), *keep)


def checked(parsed: DataFrame) -> DataFrame:
    """Rows of parse_lines without problem; a bad line is an error when it is read."""
    bad = F.raise_error(F.concat(F.lit("bad line: "), "problem"))
    return parsed.withColumn("text", F.when(F.col("problem").isNotNull(), bad).otherwise(F.col("text"))).drop("problem")


def read_ndjson(spark: SparkSession, path: str, dim: int, strict: bool = True) -> DataFrame:
    """Rows (vector, text, ts). A bad line is an error, or with strict off is left out."""
    d = parse_lines(spark.read.text(path), dim)
    return checked(d) if strict else d.where("problem IS NULL").drop("problem")


def import_ndjson(collection, path: str, chunk_size: int = 1024, checkpoint_path: str = "", resume: bool = False) -> int:
    """Append a local file in chunks, each one commit; the checkpoint moves after its chunk's commit.

    The driver reads one file, from an offset; a directory or a path with a scheme, such as an
    export's, is read by the executors and is one commit, in the order of the lines' ids. Returns the rows imported by this
    call. A bad line ends the import; earlier chunks stay, and of a directory nothing does.
    """
    if "://" in path or os.path.isdir(path):
        lines = collection.spark.read.text(path)
        place = F.from_json("value", "id bigint")["id"]
        return len(collection.put_batch(checked(parse_lines(lines.withColumn("place", place), collection.dim, "place")), "place"))
    at = done = n = 0
    if resume and checkpoint_path and os.path.exists(checkpoint_path):
        with open(checkpoint_path) as f:
            c = json.load(f)
        at, done = c["byte_offset"], c["rows_imported"]

    def save(offset: int) -> None:
        if checkpoint_path:
            with open(checkpoint_path + ".tmp", "w") as f:
                json.dump({"version": 1, "byte_offset": offset, "rows_imported": done}, f)
            os.replace(checkpoint_path + ".tmp", checkpoint_path)

    with open(path, "rb") as f:
        f.seek(at)
        while True:
            lines = list(islice(iter(f.readline, b""), chunk_size))
            if not lines:
                break
            d = collection.spark.createDataFrame([(x.decode().rstrip("\n"),) for x in lines], "value string")
            rows = parse_lines(d, collection.dim)
            if rows.where("problem IS NOT NULL").count():
                raise ValueError("malformed line; the chunks before it are imported")
            k = len(collection.put_batch(rows.drop("problem")))
            n, done = n + k, done + k
            save(f.tell())
    save(os.path.getsize(path))
    return n


def read_vector_file(path: str, dim: int) -> list[float]:
    """The first dim little-endian floats of a binary file."""
    import numpy as np

    v = np.fromfile(path, "<f4", dim)
    if len(v) < dim:
        raise ValueError(f"{path} holds {len(v)} of {dim} floats")
    return v.tolist()
