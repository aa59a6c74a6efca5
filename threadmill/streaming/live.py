"""Streaming forms of the counts: classes by window, an author's day, redeliveries.

These extend the batch operators; ``ingested_at`` or a time made of
``created_utc`` is the event time. Late rows are taken up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators.audit import classify


def stream_comments(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream, with ``ts`` from ``created_utc``."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("ts", F.timestamp_seconds("created_utc"))


def live_category_counts(df: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows of each class by community and window."""
    return (
        classify(df)
        .withWatermark("ts", late)
        .groupBy(F.window("ts", window), "subreddit", "category")
        .agg(F.count("*").alias("n"))
    )


def live_author_velocity(df: DataFrame, late: str = "30 days") -> DataFrame:
    """Comments of an author in each 24 hours, every hour."""
    return (
        df.withWatermark("ts", late)
        .groupBy(F.window("ts", "24 hours", "1 hour"), "author")
        .agg(F.count("*").alias("n"))
    )


def live_sessions(df: DataFrame, gap: str = "30 minutes", late: str = "30 days") -> DataFrame:
    """An author's runs of comments without a longer gap."""
    return (
        df.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "author")
        .agg(F.count("*").alias("n"))
    )


def live_first_delivery(df: DataFrame, late: str = "30 days") -> DataFrame:
    """Redeliveries of an id within the watermark dropped; the state is bounded by it."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def run_to_end(df: DataFrame, path: str, mode: str) -> DataFrame:
    """Run a stream over what there is into Parquet files below ``path`` and read them back.

    Each batch has a folder of its own, which a repeated batch writes anew; in
    complete mode the last batch is the result.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else f'b{number}'}")

    sink = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/_state")
    sink.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
