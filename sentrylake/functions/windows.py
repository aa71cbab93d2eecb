"""Tumbling windows over epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_window(events: DataFrame, window_ms: int, out: str = "window_id") -> DataFrame:
    """Integer quotient, rounded toward zero: times on both sides of the epoch share window 0."""
    return events.withColumn(out, F.expr(f"ts_ms div {int(window_ms)}L"))
