"""Streams over the events table; results are read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubrica.session import scratch_path
from rubrica.streaming import jobs as J

from .base import query


def staged(t, twice: bool = False) -> tuple[str, object]:
    """Events as a folder of day files in time order (each day twice on request)."""
    path = scratch_path(t.spark, "stream-in")
    rows = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    rows.repartitionByRange(4, "ts").write.parquet(path)
    if twice:
        rows.repartitionByRange(4, "ts").write.mode("append").parquet(path)
    return path, rows.schema


ROWS_PER_FILE, FILES_PER_TRIGGER = 250_000, 8


def arriving(t) -> tuple[str, object]:
    """Events as a folder of small files that come day after day, as the file source orders them by their time of writing.

    A batch of a few files then holds a short span of time, and windows close as the stream goes on.
    Rows of one day may come in any order: they are not a day behind each other.
    """
    days, path = scratch_path(t.spark, "stream-days"), scratch_path(t.spark, "stream-in")
    rows = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    rows.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(days)
    dealt = t.spark.read.parquet(days)
    for day in [r["day"] for r in dealt.select("day").distinct().orderBy("day").collect()]:
        own = dealt.where(F.col("day").eqNullSafe(F.lit(day))).select(*rows.columns)
        own.coalesce(FILES_PER_TRIGGER).write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return path, rows.schema


def run_and_close(t, path: str, run) -> None:
    """Run a stream, then again with a row that closes every window; no row may be late."""
    late = run()
    J.closing_row(t.spark.read.parquet(path), "ts", "30 DAYS").write.mode("append").parquet(path)
    if late + run():
        raise ValueError("Rows came behind the watermark")


@query(
    "stream_resume_ingest",
    "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys, sum(value) AS total FROM events GROUP BY event_type",
    "total",
    digits=4,
)
def _(t):
    path, schema = staged(t, twice=True)
    sink, check = scratch_path(t.spark, "ingested"), scratch_path(t.spark, "ingest-state")
    stream = J.event_stream(t.spark, path, schema, files_per_trigger=3).withColumn("day", F.to_date("ts"))
    J.resume_ingest(stream, sink, check, ["event_id"], "day")
    out = t.spark.read.parquet(sink)
    return out.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("keys"), F.sum("value").alias("total")
    )


@query(
    "stream_hopping_frames",
    """SELECT user_id, start, count(*) AS n, sqrt(avg(value * value)) AS rms FROM (SELECT user_id, value, ts, unnest(list_transform(range(0, 4), lambda k: time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes')) AS start FROM events)
      GROUP BY user_id, start""",
    "rms",
)
def _(t):
    path, schema = arriving(t)
    sink, check = scratch_path(t.spark, "frames"), scratch_path(t.spark, "frames-state")
    run_and_close(t, path, lambda: J.run_append(J.hopping_frames(J.event_stream(t.spark, path, schema, files_per_trigger=FILES_PER_TRIGGER), ["user_id"], "ts", "value", "1 hour", "15 minutes", "1 day"), sink, check))
    return t.spark.read.parquet(sink).where("user_id IS NOT NULL").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "rms")


@query(
    "stream_activity_sessions",
    """WITH o AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '6 hours' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
      SELECT user_id, min(ts) AS start, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, sid""",
    "total",
)
def _(t):
    path, schema = arriving(t)
    sink, check = scratch_path(t.spark, "sessions"), scratch_path(t.spark, "sessions-state")
    run_and_close(t, path, lambda: J.run_append(J.activity_sessions(J.event_stream(t.spark, path, schema, files_per_trigger=FILES_PER_TRIGGER), ["user_id"], "ts", "value", "6 hours", "1 day"), sink, check))
    return t.spark.read.parquet(sink).where("user_id IS NOT NULL").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "total")


@query(
    "stream_running_stats",
    "SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY event_type",
    "mean std",
)
def _(t):
    path, schema = staged(t)
    sink, check = scratch_path(t.spark, "stats"), scratch_path(t.spark, "stats-state")
    J.run_batches(J.running_stats(J.event_stream(t.spark, path, schema, files_per_trigger=2), ["event_type"], "value"), check, "complete", J.replace_table(sink))
    everything = t.spark.read.parquet(sink)
    newest = everything.agg(F.max("batch").alias("batch"))
    return everything.join(F.broadcast(newest), "batch").select("event_type", "n", "mean", "std")
