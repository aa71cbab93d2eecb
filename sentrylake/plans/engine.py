"""Detection as one call: events in, alerts or rankings out, exact or by sketch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import with_window
from ..operators import cms, exact, hll, space_saving
from ..schema import BRUTE_FORCE, TOP_ATTACKERS, USER_ENUMERATION, Sketches, Thresholds


def _rows(kind: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.col("source").alias("key"), "window_id")


def alerts(events: DataFrame, thresholds: Thresholds, impl: str = "exact", sketches: Sketches | None = None, ranking: bool = True) -> DataFrame:
    """(type, key, window_id) of all three detections. impl: "exact" or "sketch"."""
    t, s = thresholds, sketches or Sketches()
    windowed = with_window(events, t.window_ms)
    if impl == "exact":
        return exact.alerts(windowed, t.brute_force, t.user_enumeration, t.top_k, ranking)
    if impl == "sketch":
        logins = exact.logins(windowed)
        brute = cms.incremental_alerts(logins, t.brute_force, s.width, s.depth, s.seed)
        users = hll.alerts(logins, t.user_enumeration, s.precision)
        top = space_saving.top(windowed, t.top_k, s.capacity)
    else:
        raise ValueError("impl must be 'exact' or 'sketch'")
    out = _rows(BRUTE_FORCE, brute).unionByName(_rows(USER_ENUMERATION, users))
    return out.unionByName(_rows(TOP_ATTACKERS, top)) if ranking else out


def ranking(events: DataFrame, thresholds: Thresholds, impl: str = "exact", sketches: Sketches | None = None, evict: bool = True) -> DataFrame:
    """(window_id, source, n, rank). evict: False deals a sketch's keys to as many parts as have a counter for each."""
    windowed = with_window(events, thresholds.window_ms)
    if impl == "exact":
        return exact.top_attackers(windowed, thresholds.top_k)
    capacity = (sketches or Sketches()).capacity
    parts = 1 if evict else space_saving.parts_without_eviction(windowed, capacity)
    return space_saving.top(windowed, thresholds.top_k, capacity, parts).drop("error")
