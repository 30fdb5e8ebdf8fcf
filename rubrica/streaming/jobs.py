"""Structured Streaming forms of the incremental patterns.

Each job reads a folder of parquet files as a stream, keeps its state under a
checkpoint folder and writes a parquet sink, so a restart continues where it
stopped.  ``availableNow`` processes what is there and ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of rows with an event-time column that watermarks accept."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def resume_ingest(stream: DataFrame, sink: str, checkpoint: str, key: Sequence[str], day: str | None = None) -> None:
    """Store every key once, however late its row comes: no watermark, no state.

    Repeats inside a micro-batch collapse there; keys stored before are left out
    by an anti-join with the sink.  With ``day``, a column that all rows of a key
    share, the sink is partitioned by it and only the batch's days are read.
    """
    run_batches(stream, checkpoint, "append", append_new_keys(sink, key, day))


def hopping_frames(stream: DataFrame, key: Sequence[str], ts: str, value: str, duration: str, slide: str, delay: str) -> DataFrame:
    """RMS per key and hopping window; a window is emitted once it is closed."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*key, F.window(ts, duration, slide).alias("w"))
        .agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
        .select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "rms")
    )


def activity_sessions(stream: DataFrame, key: Sequence[str], ts: str, value: str, gap: str, delay: str) -> DataFrame:
    """Runs of events whose pauses stay below the gap."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*key, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
    )


def running_stats(stream: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Mergeable count, mean and population deviation per key."""
    return stream.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )


def closing_row(rows: DataFrame, ts: str, after: str) -> DataFrame:
    """One row later than all others by ``after``, NULL but for its time: as input it closes every window before it."""
    late = rows.agg(F.max(ts).alias("t")).where("t IS NOT NULL")
    return late.select(
        *[
            (F.col("t") + F.expr(f"INTERVAL {after}") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in rows.schema.fields
        ]
    )


def run_append(stream: DataFrame, sink: str, checkpoint: str) -> int:
    """Append results to a parquet sink until the available input is used up.

    Returns the number of rows that came behind the watermark and are in no result.
    """
    run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(
        "append"
    ).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(s["numRowsDroppedByWatermark"] for p in run.recentProgress for s in p["stateOperators"])


def run_batches(stream: DataFrame, checkpoint: str, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Hand every micro-batch to ``write``."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(
        availableNow=True
    ).start().awaitTermination()


def append_new_keys(sink: str, key: Sequence[str], day: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer that skips keys the sink already has and repeats of a key in the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from ..sources.tables import _existing

        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(key))
        if _existing(spark, sink):
            done = spark.read.parquet(sink)
            if day is not None:  # as many values as the batch has days
                done = done.where(F.col(day).isin([r[0] for r in batch.select(day).distinct().collect()]))
            fresh = fresh.join(done.select(*key), list(key), "left_anti")
        writer = fresh.write.mode("append")
        (writer.partitionBy(day) if day is not None else writer).parquet(sink)

    return write


def replace_table(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer for complete mode: one folder per batch, the last one is current."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")

    return write
