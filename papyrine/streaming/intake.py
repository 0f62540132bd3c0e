"""Incremental intake with Structured Streaming: each file or row is processed once, also after a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.operators.index import Collection


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is there and stop; the checkpoint keeps what was done."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, collection: Collection, checkpoint: str, force: bool = True) -> StreamingQuery:
    """Keep a collection up to date from a stream of points; repeating a batch changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        collection.create()
        collection.upsert(batch, force=force)

    return run_available(stream, checkpoint, each)


def counts_by_window(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and kind; rows later than the watermark are left out on a stream."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    src = events.withWatermark(ts, late) if events.isStreaming else events
    s = src.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return s.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def once_per_id(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
