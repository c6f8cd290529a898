"""Event behaviours as streams: debounce, coalescing, leases, exactly-once delivery.

Each takes a streaming or a static DataFrame, so the same code runs on both; what a
stream has emitted once its input is done equals the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, ts: str, value: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Fires after ``gap`` without an event of the key, with the last value."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    s = e.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("events"), F.max_by(value, F.struct(ts, value)).alias("last"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("fires_at"), "events", "last")


def leases(beats: DataFrame, client: str, ts: str, ttl: str = "20 seconds", late: str = "10 minutes") -> DataFrame:
    """Spans in which a client's heartbeats keep its lease alive."""
    e = beats.withWatermark(ts, late) if beats.isStreaming else beats
    s = e.groupBy(F.session_window(ts, ttl).alias("w"), F.col(client)).agg(F.count(F.lit(1)).alias("beats"))
    return s.select(client, F.col("w.start").alias("since"), F.col("w.end").alias("expires"), "beats")


def once(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """The first delivery of each event id."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def coalesced(jobs: DataFrame) -> DataFrame:
    """Queued jobs by kind and target: the first request's id stays, the last one's time
    to run counts.  jobs: id, kind, target, requested_at, delay_ms."""
    run = F.col("requested_at") + F.make_dt_interval(secs=F.col("delay_ms") / 1000)
    return jobs.groupBy("kind", "target").agg(F.min_by("id", F.struct("requested_at", "id")).alias("id"), F.min("requested_at").alias("requested_at"), F.max(run).alias("run_after"), F.count(F.lit(1)).alias("requests"))


def next_jobs(queue: DataFrame, n: int = 1) -> DataFrame:
    return queue.orderBy("run_after", "requested_at", "id").limit(n)


def recent_ring(results: DataFrame, n: int = 50) -> DataFrame:
    """The last n results, newest first."""
    return results.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def windowed_counts(events: DataFrame, key: str, ts: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each key in windows of event time (not in the reference: an addition)."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    c = e.groupBy(F.window(ts, length).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("events"))
    return c.select(key, F.col("w.start").alias("start"), "events")


def running_stats(events: DataFrame) -> DataFrame:
    """Counts by tool and result, for an append-only log (complete mode on a stream)."""
    return events.groupBy("tool_name", "result").agg(F.count(F.lit(1)).alias("n"))


def to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all its input to a Parquet sink, and stop.  In append mode what
    the watermark has not yet closed stays open."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def each_batch(stream: DataFrame, handle, checkpoint: str, mode: str = "update") -> None:
    """Run a stream to its end, each micro-batch through ``handle(df, epoch)``."""
    q = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
