"""Modelled memory of exact maps and sketches, in bytes.

An open-addressing table for n entries at load 3/4 has a power of two of slots, at least 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slots(n: Column) -> Column:
    """The least power of two that is at least ceil(4n/3), and at least 2; whole numbers only."""
    need = F.greatest(F.floor((n.cast("long") * 4 + 2) / 3).cast("long"), F.lit(2).cast("long"))
    return F.greatest(F.lit(2).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(need - 1))))


def slots_of(n: int) -> int:
    return max(2, 1 << (max(-(-4 * n // 3), 2) - 1).bit_length())


def exact_count(keys: Column) -> Column:
    return slots(keys) * 12


def exact_distinct(keys: Column, sets: Column) -> Column:
    """sets: the sum over keys of 48 + 4 * slots(values of the key)."""
    return slots(keys) * 8 + sets


def count_min(width: int, depth: int) -> int:
    return width * depth * 8


def hyperloglog(keys: Column, precision: int) -> Column:
    return slots(keys) * 8 + keys * (16 + (1 << precision))


def space_saving(capacity: int) -> int:
    return capacity * 20 + slots_of(capacity) * 8


def by_window(windowed: DataFrame, sizes) -> DataFrame:
    """Six byte counts of each window at its close, exact and sketch for the three structures."""
    logins = F.col("action") == "LOGIN"
    per_key = windowed.groupBy("window_id", "source").agg(F.count_if(logins).alias("_n"))
    keys = per_key.groupBy("window_id").agg(F.count("*").alias("_all"), F.count_if(F.col("_n") > 0).alias("_keys"))
    values = windowed.where(logins & F.col("actor").isNotNull()).select("window_id", "source", "actor").distinct().groupBy("window_id", "source").agg(F.count("*").alias("_v"))
    sets = values.groupBy("window_id").agg(F.count("*").alias("_d"), F.sum(F.lit(48) + slots(F.col("_v")) * 4).alias("_sets"))
    both = keys.join(sets, "window_id", "left").na.fill(0, ["_d", "_sets"])
    return both.select(
        "window_id",
        exact_count(F.col("_keys")).alias("exact_counter"),
        F.lit(count_min(sizes.width, sizes.depth)).cast("long").alias("sketch_counter"),
        exact_distinct(F.col("_d"), F.col("_sets")).alias("exact_users"),
        hyperloglog(F.col("_d"), sizes.precision).alias("sketch_users"),
        exact_count(F.col("_all")).alias("exact_ranking"),
        F.lit(space_saving(sizes.capacity)).cast("long").alias("sketch_ranking"),
    )


def total(sums: DataFrame) -> DataFrame:
    """(exact_bytes, sketch_bytes): the byte counts of all windows and structures added up."""
    side = lambda name: F.sum(F.col(f"{name}_counter") + F.col(f"{name}_users") + F.col(f"{name}_ranking")).cast("long").alias(f"{name}_bytes")
    return sums.agg(side("exact"), side("sketch"))


def history(windowed: DataFrame, sizes, keep: int = 180) -> DataFrame:
    """The byte counts of the latest `keep` windows."""
    return by_window(windowed, sizes).orderBy(F.desc("window_id")).limit(keep)


def sampled_peak(windowed: DataFrame, every: int = 1024) -> DataFrame:
    """(peak_bytes): the largest exact counter at events whose seq is a multiple of `every`, over all windows.

    A source counts from its first login of the window on.
    """
    from pyspark.sql import Window

    from .exact import logins

    firsts = logins(windowed).groupBy("window_id", "source").agg(F.min("seq").alias("seq")).select("window_id", "seq", F.lit(1).alias("_new"))
    ticks = windowed.where(F.col("seq") % every == 0).select("window_id", "seq", F.lit(0).alias("_new"))
    running = Window.partitionBy("window_id").orderBy("seq", F.desc("_new")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = firsts.unionByName(ticks).withColumn("_keys", F.sum("_new").over(running)).where("_new = 0")
    return seen.agg(F.max(exact_count(F.col("_keys"))).alias("peak_bytes"))


def ratio(sketch: Column, exact: Column) -> Column:
    """Sketch over exact; null where either is 0."""
    return F.when((sketch > 0) & (exact > 0), sketch / exact)
