"""How large sketches must be: rows of the sizing reports, which replay.write_csv writes as CSV.

Synthetic logins, twelve a source, all in one window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import with_window
from ..operators import compare, exact, memory, space_saving
from ..schema import Thresholds
from ..sources import zipf

#: Fixed values of the reports: events of a source, users, skew, seed, time span, members of the ranking, sketch depth.
EVENTS, USERS, SKEW, SEED, SPAN_MS, TOP_K, DEPTH = 12, 200, 0.8, 42, 50_000, 20, 4


def _events(spark: SparkSession, keys: int) -> DataFrame:
    made = zipf.zipf_events(spark, keys, USERS, SKEW, SEED, EVENTS * keys, 0, SPAN_MS)
    return with_window(made, Thresholds().window_ms)


def rankings(spark: SparkSession, cardinalities: list[int], counters: int = 4_096) -> DataFrame:
    """(keys, events, counters, exact_bytes, sketch_bytes, memory_ratio, overlap_pct): Space-Saving against the exact map."""
    out = None
    for keys in cardinalities:
        events = _events(spark, keys)
        bytes_ = events.agg(memory.exact_count(F.count_distinct("source")).alias("exact_bytes"))
        same = compare.overlap(exact.top_attackers(events, TOP_K), space_saving.top(events, TOP_K, counters), ["window_id"]).select((F.col("overlap") * 100).alias("overlap_pct"))
        sketch = F.lit(memory.space_saving(counters)).cast("long")
        sizes = bytes_.select(F.lit(keys).alias("keys"), F.lit(EVENTS * keys).alias("events"), F.lit(counters).alias("counters"), "exact_bytes", sketch.alias("sketch_bytes"), (sketch / F.col("exact_bytes")).alias("memory_ratio"))
        one = sizes.join(same)  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def counters(spark: SparkSession, cardinalities: list[int], target: float = 0.05) -> DataFrame:
    """(keys, events, exact_bytes, sketch_bytes, width, depth, memory_ratio, false_pct): the narrowest Count-Min sketch
    with at most `target` false alarms among the widths of the search."""
    out = None
    for keys in cardinalities:
        events = _events(spark, keys)
        rates = compare.false_rates(events, Thresholds().brute_force, depth=DEPTH, seed=SEED).where(F.col("false_rate") <= target)
        best = rates.agg(F.min_by("false_rate", "width").alias("rate"), F.min("width").alias("width"))
        bytes_ = events.agg(memory.exact_count(F.count_distinct("source")).alias("exact_bytes"))
        sketch = F.col("width") * (DEPTH * 8)
        one = bytes_.join(best).select(F.lit(keys).alias("keys"), F.lit(EVENTS * keys).alias("events"), "exact_bytes", sketch.alias("sketch_bytes"), "width", F.lit(DEPTH).alias("depth"), (sketch / F.col("exact_bytes")).alias("memory_ratio"), (F.col("rate") * 100).alias("false_pct"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out
