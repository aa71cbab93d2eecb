"""Detections over streams of canonical events.

Windows close by watermark, in event time: a late event within the delay still counts in its own window, one beyond
it is dropped. In append mode a window's rows come when the watermark passes its end, all in one batch. `drain` runs a
bounded stream to its end in update mode, so that no window waits for a later event, and keeps each key's last row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import exact
from ..session import scratch


def _timed(events: DataFrame, window_ms: int, delay: str) -> DataFrame:
    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)
    return timed.withColumn("_w", F.window("ts", f"{window_ms} milliseconds"))


def _window_id(window_ms: int):
    return F.expr(f"unix_millis(_w.start) div {int(window_ms)}L").alias("window_id")


def login_counts(events: DataFrame, window_ms: int, delay: str = "0 seconds") -> DataFrame:
    """(window_id, source, n) as a stream."""
    grouped = _timed(events, window_ms, delay).where("action = 'LOGIN'").groupBy("_w", "source").agg(F.count("*").alias("n"))
    return grouped.select(_window_id(window_ms), "source", "n")


def brute_force(events: DataFrame, window_ms: int, threshold: int, delay: str = "0 seconds") -> DataFrame:
    return login_counts(events, window_ms, delay).where(F.col("n") >= threshold)


def user_enumeration(events: DataFrame, window_ms: int, threshold: int, delay: str = "0 seconds") -> DataFrame:
    """(window_id, source, n): state holds the set of users of a source, as streams have no distinct count."""
    own = _timed(events, window_ms, delay).where("action = 'LOGIN' AND actor IS NOT NULL")
    grouped = own.groupBy("_w", "source").agg(F.size(F.collect_set("actor")).cast("long").alias("n"))
    return grouped.where(F.col("n") >= threshold).select(_window_id(window_ms), "source", "n")


def user_enumeration_sketch(events: DataFrame, window_ms: int, threshold: int, delay: str = "0 seconds", lg_k: int = 12) -> DataFrame:
    """The same with Spark's HyperLogLog as state, of bounded size for each source."""
    own = _timed(events, window_ms, delay).where("action = 'LOGIN' AND actor IS NOT NULL")
    grouped = own.groupBy("_w", "source").agg(F.hll_sketch_estimate(F.hll_sketch_agg("actor", F.lit(lg_k))).alias("n"))
    return grouped.where(F.col("n") >= threshold).select(_window_id(window_ms), "source", "n")


def activity_counts(events: DataFrame, window_ms: int, delay: str = "0 seconds") -> DataFrame:
    """(window_id, source, n): events of any action, as a stream."""
    grouped = _timed(events, window_ms, delay).groupBy("_w", "source").agg(F.count("*").alias("n"))
    return grouped.select(_window_id(window_ms), "source", "n")


def write_rankings(counts: DataFrame, k: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Rankings (window_id, source, n, rank) of closed windows, appended to Parquet as they close.

    State holds counts only. A window's counts arrive in one batch, which is ranked like a table: cut to k in each
    partition before the shuffle, so no task sees all sources.
    """

    def rank(batch: DataFrame, _: int) -> None:
        exact.top_k(batch, k, ["window_id"]).write.mode("append").parquet(path)

    return counts.writeStream.outputMode("append").foreachBatch(rank).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def crossing_alerts(events: DataFrame, window_ms: int, threshold: int, delay: str = "0 seconds") -> DataFrame:
    """(window_id, source, seq): each brute-force alert once, at the event that reaches the threshold. Append mode.

    State is a count for each window and source; it goes when the watermark passes the window's end.
    """
    own = events.where("action = 'LOGIN'").withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay).withColumn("window_id", F.expr(f"ts_ms div {int(window_ms)}L"))
    kind = dict(events.dtypes)["source"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        at = pd.concat([f["seq"] for f in frames]).sort_values()
        if seen < threshold <= seen + len(at):
            yield pd.DataFrame({"window_id": [key[0]], "source": [key[1]], "seq": [int(at.iloc[threshold - seen - 1])]})
        state.update((seen + len(at),))
        end = (int(key[0]) + 1) * window_ms
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)

    return own.groupBy("window_id", "source").applyInPandasWithState(step, f"window_id long, source {kind}, seq long", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The files of a Parquet table, a folder or a single file, as a stream with the table's own schema."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in table.inputFiles()] == [name]:  # a stream reads folders only
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drain(stream: DataFrame, mode: str = "update", keys: tuple[str, ...] = ("window_id", "source"), value: str = "n") -> DataFrame:
    """Run a bounded stream to its end and return the rows it wrote; in update mode the last of each key.

    `value` only grows, so the last row of a key is its largest. Rows go to the shared folder, none to the driver.
    """
    spark = stream.sparkSession
    path = scratch(spark, "drained")
    spark.createDataFrame([], stream.schema).write.parquet(path)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark, "drain-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(path)
    return rows if mode == "append" else rows.groupBy(*keys).agg(F.max(value).alias(value))


def throughput(query: StreamingQuery) -> float:
    """Rows a second of the latest batch that had any; 0 before the first."""
    rates = [p["processedRowsPerSecond"] for p in query.recentProgress if p["numInputRows"]]
    return float(rates[-1]) if rates else 0.0
