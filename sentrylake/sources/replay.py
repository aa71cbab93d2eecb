"""Replays of stored events as streams, and sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed_rate(spark: SparkSession, events: DataFrame, events_per_second: int) -> DataFrame:
    """Stored events as a stream of so many a second, in the order of a gapless `seq` from 0."""
    if events_per_second <= 0:
        raise ValueError("events_per_second must be positive")
    ticks = spark.readStream.format("rate").option("rowsPerSecond", events_per_second).load()
    return ticks.select(F.col("value").alias("seq")).join(events, "seq")


def scaled_delays(events: DataFrame, scale: float, longest_ms: float = 250.0) -> DataFrame:
    """Adds wall_ms: when each event is due if time runs `scale` times as fast and no gap lasts over longest_ms.

    One replay is one sequence, so this orders all of it; it is meant for captures, not for corpora.
    """
    if scale <= 0:
        raise ValueError("scale must be positive")
    from pyspark.sql import Window

    order = Window.orderBy("seq")
    gap = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(order), F.lit(0)) / scale
    return events.withColumn("_gap", F.least(F.greatest(gap, F.lit(0.0)), F.lit(longest_ms))).withColumn("wall_ms", F.sum("_gap").over(order)).drop("_gap")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def to_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
