"""The training-data pipeline over `documents`.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame that works on all that the stage
before it kept; every stage's result is written as Parquet and read again as the next one's docs.

1. toxicity: documents of score >= 0.5 go. The model is trained on the labelled rows outside the
   held-out fold, with the texts of the table `documents`; scores are of the stage's own docs.
2. line dedup: repeated three-line windows lose their later occurrences; a document that had any
   text and has none but white space left goes, as all of it stands elsewhere.
3. n-gram Jaccard join: of each group of near copies the row of the least id stays.
4. source mix: documents repeat or go so that sources reach their target weights; where a source's
   last epoch ends, one document is cut at a word's end.
5. best-fit packing: pieces of token sequences.

Stages 1 to 4 return the columns of documents; n_chars follows the text. No stage's result can be
expressed whole in SQL (a trained model comes first), so ORACLE_SQL is None and the tests hold
each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm import linededup, mixing, neardup, packing, toxicity
from lodevec.llm.common import stage, unstage

ORACLE_SQL = None


def _same_columns(docs: DataFrame, changed: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(texts, labels))
    return scored.where("score < 0.5").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d = linededup.line_dedup(docs).where(r"n_removed = 0 OR kept_text RLIKE '\\S'")
    return _same_columns(docs, d.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_dups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = packing.pack(packing.pieces(docs, added=True))
    return p.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:  # read for the last time
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
