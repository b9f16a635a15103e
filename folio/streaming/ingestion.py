"""Ingestion of documents as state by key, kept across batches, restarts and failures.

A document is pending, processing, done or error. The table of states grows by segments: batch n claims its documents in
one segment (processing, since now) and writes their outcomes in the next. A batch that runs again reads what stood before
it and replaces its own two segments, so nothing is written twice; one that never runs again leaves documents processing,
and they are taken up once STUCK minutes have passed.

In a batch: a new document, or one whose content has changed, is pending; one that comes again unchanged and is done stays
as it is, as does one that is being processed; one in error is queued again, and so is any in error that was tried fewer
than TRIES times. Of copies of a key in a batch the latest counts. A null key is no document and is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.sources import segments

STUCK, TRIES = 30, 3
STATE = "key string, content string, hash string, state string, attempts int, since timestamp, error string"
#: Segments of a batch: its claim, its outcomes, and room for a compaction.
A_BATCH = 4


def queued(before: DataFrame | None, arrivals: DataFrame, now: Column, stuck: int = STUCK, tries: int = TRIES) -> DataFrame:
    """The documents that a batch takes up, as pending rows: arrivals are key, content and at; before has STATE's columns."""
    latest = arrivals.filter("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("content"), F.struct("at", "content")).alias("x"))
    fresh = latest.select("key", "x.content", F.sha2(F.coalesce("x.content", F.lit("")), 256).alias("hash"))
    pending = [F.lit("pending").alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"), now.alias("since"), F.lit(None).cast("string").alias("error")]
    if before is None:
        return fresh.withColumn("attempts", F.lit(0)).select("key", "content", "hash", *pending)
    old = before.select("key", F.struct("content", "hash", "state", "attempts", "since").alias("old"))
    both = fresh.select("key", F.struct("content", "hash").alias("new")).join(old, "key", "full")
    again = F.when(F.col("new").isNull(), F.col("old.attempts") < tries).otherwise(F.lit(True))
    waits = (F.col("old.state") == "pending") | ((F.col("old.state") == "error") & again) | ((F.col("old.state") == "processing") & (F.col("old.since") < now - F.make_interval(mins=F.lit(stuck))))
    changed = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.hash") != F.col("old.hash")))
    taken = both.filter(changed | F.coalesce(waits, F.lit(False)))
    attempts = F.when(changed, F.lit(0)).otherwise(F.col("old.attempts")).alias("attempts")
    pick = lambda c: F.coalesce(F.col(f"new.{c}"), F.when(F.col("new").isNull(), F.col(f"old.{c}"))).alias(c)
    return taken.select("key", pick("content"), pick("hash"), attempts).select("key", "content", "hash", *pending)


def processed(claimed: DataFrame, work: Callable[[Column], Column], now: Column) -> DataFrame:
    """Claimed documents with their outcome: work gives the error of a content, null if there is none."""
    tried = claimed.withColumn("error", work(F.col("content")))
    return tried.select("key", "content", "hash", F.when(F.col("error").isNull(), "done").otherwise("error").alias("state"), (F.col("attempts") + 1).alias("attempts"), now.alias("since"), "error")


def batch_of(path: str, work: Callable[[Column], Column], now: Callable[[], Column] = F.current_timestamp, stuck: int = STUCK, tries: int = TRIES) -> Callable[[DataFrame, int], None]:
    """What a stream does with its batch number n."""

    def run(batch: DataFrame, n: int) -> None:
        spark, at = batch.sparkSession, A_BATCH * n
        before = segments.current(spark, path, below=at)
        rows = queued(before, batch, now(), stuck, tries).withColumn("state", F.lit("processing"))
        segments.put(rows, ["key"], path, at)
        claimed = spark.read.schema(STATE).parquet(f"{path}/segment={at}/rows")
        outcome = processed(claimed, work, now())
        segments.put(outcome, ["key"], path, at + 1)
        segments.compacted(spark, path)

    return run


def ingest(arrivals: DataFrame, path: str, checkpoint: str, work: Callable[[Column], Column], **options) -> StreamingQuery:
    """Keeps the states of a stream of documents (key, content, at) at path; starts again where the checkpoint says."""
    return arrivals.writeStream.foreachBatch(batch_of(path, work, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
