"""HyperLogLog, one sketch for each key, as DataFrames of registers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import leading_zeros, with_splitmix64


def check(precision: int) -> int:
    if not 4 <= precision <= 16:
        raise ValueError("precision must be from 4 to 16")
    return precision


def precision_for(error: float) -> int:
    """The least precision whose standard error is at most `error`, within 4 to 16."""
    if not 0 < error < 1:
        raise ValueError("error must be between 0 and 1")
    return max(4, min(16, math.ceil(math.log2((1.04 / error) ** 2))))


def alpha(m: int) -> float:
    """Fixed values for 16, 32 and 64 registers, else the usual formula."""
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def registers(df: DataFrame, keys: list[str], value: str, precision: int) -> DataFrame:
    """(keys, idx, rank): the non-empty registers. Values are made distinct before they are hashed."""
    p = check(precision)
    hashed = with_splitmix64(df.where(F.col(value).isNotNull()).select(*keys, value).distinct(), value, "_h")
    bits = F.shiftleft("_h", p).bitwiseOR(F.lit(1 << (p - 1)))
    return hashed.select(*keys, F.shiftrightunsigned("_h", 64 - p).alias("idx"), (leading_zeros(bits) + 1).alias("rank")).groupBy(*keys, "idx").agg(F.max("rank").alias("rank"))


def estimate(filled: Column, harmonic: Column, m: int) -> Column:
    """Rounded estimate from the number of non-empty registers and the sum of 2**-rank over them."""
    empty = F.lit(m) - filled
    raw = F.lit(alpha(m) * m * m) / (harmonic + empty)
    counted = F.lit(float(m)) * F.ln(F.lit(float(m)) / empty)
    return F.floor(F.when((raw <= 2.5 * m) & (empty > 0), counted).otherwise(raw) + 0.5)


def estimates(df: DataFrame, keys: list[str], value: str, precision: int) -> DataFrame:
    """(keys, estimate) of every key that has a value."""
    sums = registers(df, keys, value, precision).groupBy(*keys).agg(F.count("*").alias("_filled"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("_sum"))
    return sums.select(*keys, estimate(F.col("_filled"), F.col("_sum"), 1 << precision).alias("estimate"))


def alerts(logins: DataFrame, threshold: int, precision: int) -> DataFrame:
    """(window_id, source) of sources whose estimated number of users is at the threshold.

    The estimate rises with every new register while it counts empty ones, so the close of a window decides.
    """
    return estimates(logins, ["window_id", "source"], "actor", precision).where(F.col("estimate") >= threshold).select("window_id", "source")


def native(df: DataFrame, keys: list[str], value: str, lg_k: int = 12) -> DataFrame:
    """Spark's own sketch: (keys, estimate)."""
    return df.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(lg_k))).alias("estimate"))
