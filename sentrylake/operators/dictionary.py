"""Dense ids of keys in the order of their first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def encode(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """(key, id) with ids from 0; null has none. Sorted by range, then numbered with the partitions' counts, so no task sees all keys."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    dealt = first.repartitionByRange("_first", key).sortWithinPartitions("_first", key).withColumn("_m", F.monotonically_increasing_id())
    parts = dealt.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before), "_p").select(key, (F.col("_before") + F.col("_i")).alias("id"))  # a row for each partition


def decode(ids: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """The key of each id; null for ids that aren't in the dictionary."""
    return ids.join(dictionary.select("id", key), "id", "left")
