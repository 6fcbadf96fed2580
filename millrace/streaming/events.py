"""Structured Streaming over a folder of parquet event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, delay: str, files_per_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """Events of the folder's files as a stream, ts as a zoned timestamp with a watermark of delay."""
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def windowed_counts(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Events and their summed value by window and type."""
    grouped = events.groupBy(F.window("ts", length, slide).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Events of each user's session."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")


def first_of_each(events: DataFrame, *keys: str) -> DataFrame:
    """One event of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def matched_within(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """Pairs of one user's events in two streams, right at most seconds after left."""
    one = left.select(F.col("user_id").alias("left_user"), F.col("ts").alias("left_ts"), F.col("event_id").alias("left_id"))
    two = right.select(F.col("user_id").alias("right_user"), F.col("ts").alias("right_ts"), F.col("event_id").alias("right_id"))
    later = F.expr(f"left_user = right_user AND right_ts > left_ts AND right_ts <= left_ts + INTERVAL {int(seconds)} SECONDS")
    return one.join(two, later).select(F.col("left_user").alias("user_id"), "left_id", "right_id")


def running_totals(events: DataFrame) -> DataFrame:
    """Each user's events and value so far, updated by batch, with state of our own."""
    import pandas as pd

    def step(key, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def with_customers(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Events of a stream with the market segment of their customer, from a table that doesn't stream."""
    named = customers.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return events.join(named, "user_id").select("event_id", "user_id", "c_mktsegment")


def drain(stream: DataFrame, mode: str, folder: str, name: str) -> DataFrame:
    """Runs the stream over all that is there and returns its rows, those of the last batch alone in complete mode.

    Rows and state are written below folder, which driver and executors must
    share; a batch that is run again overwrites its own rows.
    """
    spark, batches = stream.sparkSession, []

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        batches.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/{max(batches)}" if mode == "complete" else f"{folder}/rows/*")
