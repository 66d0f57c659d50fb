"""Structured Streaming: NDJSON files into a collection exactly once, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.sources import ndjson


def ingest(spark: SparkSession, source: str, collection, checkpoint: str, name: str = "ingest"):
    """Run all NDJSON files of a directory not yet seen into a collection, and end; returns the query.

    Each batch is one commit, whose manifest holds the batch's number, so a batch that is replayed
    after a crash is not appended twice. A malformed line fails its batch, which can be run again
    when the line is mended: none is lost.
    """
    lines = spark.readStream.text(source)

    def commit(batch: DataFrame, number: int) -> None:
        if collection.state.get("streams", {}).get(name, -1) < number:
            collection.put_batch(ndjson.checked(ndjson.parse_lines(batch, collection.dim)), mark=(name, number))

    q = lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def tumbling(events: DataFrame, ts: str = "ts", every: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Counts and sums by window and key; on a stream the watermark bounds what is kept."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if events.isStreaming else e
    d = e.groupBy(F.window(ts, every).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return d.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def dedup_stream(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """First event of each key; state is dropped after the watermark."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else e.dropDuplicates([key])
