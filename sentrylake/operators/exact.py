"""Exact aggregations and the three detections.

A null source is a source of its own. Alerts are rows (type, key, window_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BRUTE_FORCE, TOP_ATTACKERS, USER_ENUMERATION


def logins(windowed: DataFrame) -> DataFrame:
    return windowed.where(F.col("action") == "LOGIN")


def counts(df: DataFrame, keys: list[str], delta: Column | None = None, out: str = "n") -> DataFrame:
    """Rows, or the sum of `delta`, for each key; summed before the shuffle."""
    return df.groupBy(*keys).agg((F.count("*") if delta is None else F.sum(delta).cast("long")).alias(out))


def distinct_counts(df: DataFrame, keys: list[str], value: str, out: str = "n") -> DataFrame:
    """Different non-null values for each key. Distinct first, so that a hot key is spread by its values."""
    return df.where(F.col(value).isNotNull()).select(*keys, value).distinct().groupBy(*keys).agg(F.count("*").alias(out))


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """`value` of each row's key, 0 for keys that were never seen."""
    return df.join(table, keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def top_k(counted: DataFrame, k: int, within: list[str], key: str = "source", n: str = "n") -> DataFrame:
    """The k largest of each group with their rank; ties go to the smaller key. Cut in each partition before the shuffle."""
    order = Window.partitionBy(*within).orderBy(F.desc(n), F.asc_nulls_first(key))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0))


def global_top_k(counted: DataFrame, k: int, key: str = "source", n: str = "n") -> DataFrame:
    return counted.orderBy(F.desc(n), F.asc_nulls_first(key)).limit(max(k, 0))


def _alert(kind: str, df: DataFrame, key: str = "source") -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.col(key).alias("key"), "window_id")


def brute_force(windowed: DataFrame, threshold: int) -> DataFrame:
    """(window_id, source, n): sources with at least `threshold` logins of any outcome in a window."""
    return counts(logins(windowed), ["window_id", "source"]).where(F.col("n") >= threshold)


def user_enumeration(windowed: DataFrame, threshold: int) -> DataFrame:
    """(window_id, source, n): sources that tried at least `threshold` different users in a window."""
    return distinct_counts(logins(windowed), ["window_id", "source"], "actor").where(F.col("n") >= threshold)


def top_attackers(windowed: DataFrame, k: int) -> DataFrame:
    """(window_id, source, n, rank): the k sources with most events of any action in each window."""
    return top_k(counts(windowed, ["window_id", "source"]), k, ["window_id"])


def brute_force_crossing(windowed: DataFrame, threshold: int) -> DataFrame:
    """(window_id, source, seq): the event at which the threshold is reached."""
    order = Window.partitionBy("window_id", "source").orderBy("seq")
    return logins(windowed).withColumn("_r", F.row_number().over(order)).where(F.col("_r") == threshold).select("window_id", "source", "seq")


def user_enumeration_crossing(windowed: DataFrame, threshold: int) -> DataFrame:
    """(window_id, source, seq): the event that brings the threshold's new user."""
    first = logins(windowed).where("actor IS NOT NULL").groupBy("window_id", "source", "actor").agg(F.min("seq").alias("seq"))
    order = Window.partitionBy("window_id", "source").orderBy("seq")
    return first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == threshold).select("window_id", "source", "seq")


def totals(windowed: DataFrame) -> DataFrame:
    """(window_id, source, n, attempts, users): events, logins and users of logins, all figures from one pass.

    Counted by user first, so a hot source is spread by its users and arrives at its own task pre-aggregated.
    """
    by_user = windowed.groupBy("window_id", "source", "actor").agg(F.count("*").alias("_n"), F.count_if(F.col("action") == "LOGIN").alias("_l"))
    known = (F.col("_l") > 0) & F.col("actor").isNotNull()
    return by_user.groupBy("window_id", "source").agg(F.sum("_n").alias("n"), F.sum("_l").alias("attempts"), F.count_if(known).alias("users"))


def alerts(windowed: DataFrame, brute: int, users: int, k: int, ranking: bool = True) -> DataFrame:
    """All three detections as (type, key, window_id). Thresholds and ranking read the same shuffled totals."""
    raised = F.array_compact(F.array(F.when(F.col("attempts") >= brute, F.lit(BRUTE_FORCE)), F.when(F.col("users") >= users, F.lit(USER_ENUMERATION))))
    per = totals(windowed if ranking else logins(windowed))
    used = F.col("n") + F.col("attempts") + F.col("users") > 0  # names all columns on both sides, so that the exchange is one
    crossed = per.where(used & ((F.col("attempts") >= brute) | (F.col("users") >= users)))
    thresholds = crossed.select(F.explode(raised).alias("type"), F.col("source").alias("key"), "window_id")
    return thresholds.unionByName(_alert(TOP_ATTACKERS, top_k(per.where(used), k, ["window_id"]))) if ranking else thresholds
