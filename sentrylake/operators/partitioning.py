"""How work is shared out by source, and rankings merged from partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import partition_of
from .exact import counts, top_k


def load(events: DataFrame, n: int) -> DataFrame:
    """(part, events): events of each of n partitions by source; partitions without any are left out."""
    key = F.coalesce(F.col("source"), F.lit(-1))
    return events.groupBy("source").agg(F.count("*").alias("_n")).select(partition_of(key, n).cast("int").alias("part"), "_n").groupBy("part").agg(F.sum("_n").alias("events"))


def largest_share(events: DataFrame, n: int) -> DataFrame:
    """(parts, largest, total, share) of the busiest partition."""
    return load(events, n).agg(F.lit(n).cast("long").alias("parts"), F.max("events").alias("largest"), F.sum("events").alias("total")).withColumn("share", F.col("largest") / F.col("total"))


def merged_top_k(windowed: DataFrame, k: int, n: int) -> DataFrame:
    """(window_id, source, n, rank): rankings of n partitions, then the k largest of their union; right since a source has one partition."""
    counted = counts(windowed, ["window_id", "source"]).withColumn("part", partition_of(F.coalesce(F.col("source"), F.lit(-1)), n))
    local = top_k(counted, k, ["window_id", "part"]).drop("rank", "part")
    return top_k(local, k, ["window_id"])
