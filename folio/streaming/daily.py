"""Streams: statistics by day with late rows, and resumable ingestion in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events below folder as a stream of files."""
    path = f"{folder}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Count and sum of values by day and type; days close when the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events less than gap apart."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "n")


def ingest(rows: DataFrame, path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Appends a stream's new rows to a table once each, also if a batch is run again: a batch's rows are written below its own number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
