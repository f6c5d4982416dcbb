"""Keeping an index up to date from a stream of documents.

Each micro-batch appends its own postings; readers sum them. Batches are written
under their number, so that a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import index


def maintain(stream: DataFrame, stop: list[str], folder: str, state: str, trigger: dict | None = None) -> StreamingQuery:
    """Start writing postings of ``(doc_id, field, text)`` rows to ``folder``; ``state`` is the query's checkpoint folder."""

    def write(batch: DataFrame, number: int) -> None:
        index.postings(batch, stop).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The index as of the batches written so far."""
    return spark.read.parquet(folder).groupBy("field", "term", "doc_id").agg(F.sum("tf").alias("tf"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by time window and type, with a watermark for late ones."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
