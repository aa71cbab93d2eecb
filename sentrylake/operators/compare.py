"""How sketches differ from exact results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TOP_ATTACKERS
from . import cms
from .exact import logins

KEYS = ["type", "key", "window_id"]


def _sides(exact: DataFrame, sketch: DataFrame) -> DataFrame:
    """Every alert once, with whether exact and sketch have it. One grouped pass over both instead of a full join."""
    both = exact.select(*KEYS, F.lit(1).alias("_e"), F.lit(0).alias("_s")).unionByName(sketch.select(*KEYS, F.lit(0).alias("_e"), F.lit(1).alias("_s")))
    return both.groupBy(*KEYS).agg(F.max("_e").alias("_e"), F.max("_s").alias("_s"))


def agreement(exact: DataFrame, sketch: DataFrame) -> DataFrame:
    """(type, matched, extra, missed); rankings are compared elsewhere."""
    sides = _sides(exact, sketch).where(F.col("type") != TOP_ATTACKERS)
    return sides.groupBy("type").agg(F.count_if(F.expr("_e = 1 AND _s = 1")).alias("matched"), F.count_if(F.expr("_e = 0")).alias("extra"), F.count_if(F.expr("_s = 0")).alias("missed"))


def totals(exact: DataFrame, sketch: DataFrame) -> DataFrame:
    """(mode, type, n): alerts of each mode."""
    mode = lambda df, name: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(name).alias("mode"), "type", "n")
    return mode(exact, "exact").unionByName(mode(sketch, "sketch"))


def tag(exact: Column, sketch: Column) -> Column:
    return F.when((exact == 1) & (sketch == 1), "both").when(exact == 1, "exact_only").otherwise("sketch_only")


def feed(exact: DataFrame, sketch: DataFrame, latest: int = 40) -> DataFrame:
    """The latest alerts (type, key, window_id, tag); by window, then type and key."""
    sides = _sides(exact, sketch).select(*KEYS, tag(F.col("_e"), F.col("_s")).alias("tag"))
    return sides.orderBy(F.desc("window_id"), "type", F.asc_nulls_first("key")).limit(latest)


def overlap(expected: DataFrame, actual: DataFrame, within: list[str], key: str = "source") -> DataFrame:
    """(within, overlap): share of expected members that actual has; by membership, whatever the order."""
    both = expected.select(*within, key).join(actual.select(*within, key).withColumn("_hit", F.lit(1)), [*within, key], "left")
    return both.groupBy(*within).agg((F.count("_hit") / F.count("*")).alias("overlap"))


def overlap_of(expected: list, actual: list) -> float:
    return len(set(expected) & set(actual)) / len(expected) if expected else 1.0


def side_by_side(exact: DataFrame, sketch: DataFrame) -> DataFrame:
    """(window_id, source, exact_rank, exact_n, sketch_rank, sketch_n) of all members of either ranking."""
    pick = lambda df, name: df.select("window_id", "source", F.col("rank").alias(f"{name}_rank"), F.col("n").alias(f"{name}_n"))
    a, b = pick(exact, "exact"), pick(sketch, "sketch")
    same = (a["window_id"] == b["window_id"]) & a["source"].eqNullSafe(b["source"])
    return a.join(b, same, "full_outer").select(F.coalesce(a["window_id"], b["window_id"]).alias("window_id"), F.coalesce(a["source"], b["source"]).alias("source"), "exact_rank", "exact_n", "sketch_rank", "sketch_n")


#: The widths that a search goes through.
WIDTHS = [64 << i for i in range(17)]


def false_rates(windowed: DataFrame, threshold: int, widths: list[int] | None = None, depth: int = 4, seed: int = 42) -> DataFrame:
    """(width, exact_alerts, extra, lost, false_rate) for each width; a sketch that loses an alert is an error in the data or here."""
    widths = widths or WIDTHS
    own = cms.decided(logins(windowed), threshold, widths, depth, seed)  # a row for each source, whose count is the exact side
    each = F.array_distinct(F.concat(cms.raised(widths), F.when(F.col("n") >= threshold, F.array(*(F.lit(w).cast("long") for w in widths))).otherwise(F.array().cast("array<bigint>"))))
    sides = own.select((F.col("n") >= threshold).alias("_e"), cms.raised(widths).alias("_s"), F.explode(each).alias("width"))
    found = sides.groupBy("width").agg(F.count_if("_e").alias("exact_alerts"), F.count_if(~F.col("_e")).alias("extra"), F.count_if(~F.array_contains("_s", F.col("width"))).alias("lost"))
    return found.withColumn("false_rate", F.when(F.col("exact_alerts") > 0, F.col("extra") / F.col("exact_alerts")).otherwise(0.0))


def min_width(windowed: DataFrame, threshold: int, target: float, depth: int = 4, seed: int = 42) -> DataFrame:
    """(width): the smallest of WIDTHS whose false-alarm rate is at most `target`; null if none is. A width without any
    alert, of a table without exact ones, has the rate 0."""
    found = false_rates(windowed, threshold, WIDTHS, depth, seed)
    every = windowed.sparkSession.range(len(WIDTHS)).select(F.call_function("shiftleft", F.lit(WIDTHS[0]).cast("long"), F.col("id").cast("int")).alias("width"))
    return every.join(F.broadcast(found), "width", "left").where(F.coalesce("false_rate", F.lit(0.0)) <= target).agg(F.min("width").alias("width"))  # a row for each width


def tracked(windowed: DataFrame, summaries: DataFrame) -> DataFrame:
    """(window_id, exact_keys, sketch_keys): how many sources the exact ranking and the sketch follow."""
    a = windowed.select("window_id", "source").distinct().groupBy("window_id").agg(F.count("*").alias("exact_keys"))
    return a.join(summaries.groupBy("window_id").agg(F.count("*").alias("sketch_keys")), "window_id")
