"""Operator 5, line dedup: overlapping windows of consecutive lines, repeated ones removed.

Every run of `width` consecutive lines of a document is hashed (128 bits). A window whose hash
has an earlier occurrence anywhere (smaller doc_id; same id, smaller text hash; same document,
smaller line number) covers its lines, and covered lines of later occurrences go. Windows
overlap, so covered positions merge into whole passages.

Cases: null text counts as empty; a text of fewer lines than the width has no window and stays
whole; a null doc_id sorts before all others; rows that agree in id and text are one document
and are treated alike; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def _windows(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    d = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), lines.alias("l")).where(F.size("l") >= width)

    def window(i):
        return F.struct(i.alias("pos"), *(F.xxhash64(*(F.get("l", i + j) for j in range(width)), F.lit(seed)).alias(c) for seed, c in ((0, "a"), (1, "b"))))

    spans = F.transform(F.sequence(F.lit(0), F.size("l") - width), window)
    return d.select("k", "t", F.explode(spans).alias("w")).select("k", "t", "w.pos", "w.a", "w.b")


def covered_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Rows (k, t, gone): id, text hash and the sorted numbers of the lines to remove."""
    w = _windows(docs, text, key, width)
    me = F.struct("k", "t", "pos")
    first = w.groupBy("a", "b").agg(F.min(me).alias("first"), F.max(me).alias("last")).where("first < last")
    later = w.join(first.select("a", "b", "first"), ["a", "b"]).where(me > F.col("first"))
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + width - 1)))))
    return later.groupBy("k", "t").agg(gone.alias("gone"))


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """docs with kept_text string, n_lines int and n_removed int; a row per row of docs."""
    taken = {c.lower() for c in docs.columns}
    if clash := taken & {"kept_text", "n_lines", "n_removed"}:
        docs = docs.drop(*[c for c in docs.columns if c.lower() in clash])
    gone = covered_lines(docs, text, key, width)
    d = docs.withColumn("__t", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    d = d.join(gone.withColumnsRenamed({"k": "__k", "t": "__u", "gone": "__gone"}), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__t") == F.col("__u")), "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))  # hashed, so linear in the lines
    keep = F.transform(left, lambda i: F.get(lines, i))
    some = F.col("__gone").isNotNull()
    return d.withColumns({
        "kept_text": F.when(some, F.array_join(keep, "\n")).otherwise(F.coalesce(F.col(text), F.lit(""))),
        "n_lines": F.size(lines),
        "n_removed": F.when(some, F.size("__gone")).otherwise(0),
    }).drop("__t", "__k", "__u", "__gone")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "kept_text")


OP5_SQL = """
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, pos, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c
  FROM (SELECT doc_id, lines, unnest(generate_series(0, len(lines) - 3)) AS pos FROM l WHERE len(lines) >= 3)
),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n FROM w),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1),
k AS (
  SELECT x.doc_id, x.pos, x.line, g.pos IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(generate_series(0, len(lines) - 1)) AS pos, unnest(lines) AS line FROM l) x
  LEFT JOIN g ON g.doc_id = x.doc_id AND g.pos = x.pos
)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
FROM k GROUP BY doc_id
"""
