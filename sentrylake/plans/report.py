"""Reports over events and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import with_window
from ..operators import compare, exact
from ..schema import Sketches, Thresholds
from . import engine


def window_summary(events: DataFrame, window_ms: int) -> DataFrame:
    """(window_id, events, logins, failures, sources, users) of each window."""
    w = with_window(events, window_ms)
    return w.groupBy("window_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.expr("action = 'LOGIN'")).alias("logins"),
        F.count_if(F.expr("outcome = 'FAILURE'")).alias("failures"),
        F.count_distinct("source").alias("sources"),
        F.count_distinct("actor").alias("users"),
    )


def outcomes(events: DataFrame) -> DataFrame:
    """(action, outcome, n)."""
    return exact.counts(events, ["action", "outcome"])


def most_tried(events: DataFrame, k: int = 10) -> DataFrame:
    """(actor, n): the users tried most."""
    return exact.global_top_k(exact.counts(exact.logins(events).where("actor IS NOT NULL"), ["actor"]), k, "actor")


def snapshot(events: DataFrame, thresholds: Thresholds, sketches: Sketches | None = None) -> DataFrame:
    """(type, matched, extra, missed, exact_alerts, sketch_alerts): the state of a session in one row for each detection."""
    a = engine.alerts(events, thresholds, "exact", ranking=False)
    b = engine.alerts(events, thresholds, "sketch", sketches, ranking=False)
    return compare.agreement(a, b).select("type", "matched", "extra", "missed", (F.col("matched") + F.col("missed")).alias("exact_alerts"), (F.col("matched") + F.col("extra")).alias("sketch_alerts"))
