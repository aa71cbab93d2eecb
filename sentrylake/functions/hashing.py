"""Integer hashes as column expressions, safe under ANSI arithmetic: no product exceeds 63 bits.

A step is a projection of its own, so that no expression is copied into the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF
#: Multipliers of the 32-bit finaliser, of the 64-bit finaliser, and the golden-ratio constants.
FMIX = (0x85EBCA6B, 0xC2B2AE35)
SPLITMIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
GOLDEN32, GOLDEN64 = 0x9E3779B9, 0x9E3779B97F4A7C15
#: Fixed values of the generator behind seeded draws: multiplier, increment, modulus 2**48.
LCG_A, LCG_C = 0x5DEECE66D, 0xB


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >= 1 << 63 else x


def mul32(h: Column, c: int) -> Column:
    """h * c modulo 2**32, for h in [0, 2**32)."""
    high = F.shiftright(h, 16) * F.lit(c).cast("long")
    low = h.bitwiseAND(F.lit(65535)) * F.lit(c).cast("long")
    return (high.bitwiseAND(F.lit(65535)) * 65536 + low).bitwiseAND(F.lit(M32))


def _shifted(h: Column, n: int) -> Column:
    return h.bitwiseXOR(F.shiftright(h, n))


def seeds(seed: int) -> tuple[int, int]:
    """The first two 32-bit draws of the 48-bit linear congruential generator with this seed."""
    state, out = (seed ^ LCG_A) & ((1 << 48) - 1), []
    for _ in range(2):
        state = (state * LCG_A + LCG_C) & ((1 << 48) - 1)
        out.append(state >> 16)
    return out[0], out[1]


def fmix32(key: Column, seed: int) -> Column:
    """32-bit finaliser of key ^ seed, as a long in [0, 2**32)."""
    h = key.cast("long").bitwiseAND(F.lit(M32)).bitwiseXOR(F.lit(seed & M32))
    h = mul32(_shifted(h, 16), FMIX[0])
    h = mul32(_shifted(h, 13), FMIX[1])
    return _shifted(h, 16)


def partition_of(key: Column, n: int) -> Column:
    """Partition of a key among n (a power of two), by multiplicative hashing."""
    if n <= 0 or n & (n - 1):
        raise ValueError("the number of partitions must be a power of two")
    h = mul32(key.cast("long").bitwiseAND(F.lit(M32)), GOLDEN32)
    return _shifted(h, 16).bitwiseAND(F.lit(0x7FFFFFFF & (n - 1)))


def _mul64(df: DataFrame, x: str, c: int, out: str) -> DataFrame:
    """out = x * c modulo 2**64, from 16- and 32-bit limbs."""
    lo, hi = F.lit(c & M32).cast("long"), c >> 32
    a = F.col(x).bitwiseAND(F.lit(M32))
    step = df.withColumns({"_a": a, "_b": F.shiftrightunsigned(F.col(x), 32)})
    step = step.withColumns({"_p": F.col("_a").bitwiseAND(F.lit(65535)) * lo, "_q": F.shiftright("_a", 16) * lo, "_r": mul32(F.col("_b"), c & M32), "_s": mul32(F.col("_a"), hi)})
    step = step.withColumn("_l", F.col("_p").bitwiseAND(F.lit(M32)) + F.shiftleft(F.col("_q").bitwiseAND(F.lit(65535)), 16))
    top = (F.shiftright("_p", 32) + F.shiftright("_q", 16) + F.shiftright("_l", 32) + F.col("_r") + F.col("_s")).bitwiseAND(F.lit(M32))
    return step.withColumn(out, F.shiftleft(top, 32).bitwiseOR(F.col("_l").bitwiseAND(F.lit(M32)))).drop("_a", "_b", "_p", "_q", "_r", "_s", "_l")


def _add64(x: Column, c: int) -> Column:
    """x + c modulo 2**64, by halves."""
    lo = x.bitwiseAND(F.lit(M32)) + F.lit(c & M32).cast("long")
    hi = F.shiftrightunsigned(x, 32) + F.lit(c >> 32).cast("long") + F.shiftright(lo, 32)
    return F.shiftleft(hi.bitwiseAND(F.lit(M32)), 32).bitwiseOR(lo.bitwiseAND(F.lit(M32)))


def with_splitmix64(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds the 64-bit finaliser of a long, as a signed long."""
    step = df.withColumn(out, _add64(F.col(key).cast("long"), GOLDEN64))
    for shift, c in zip((30, 27), SPLITMIX, strict=True):
        step = step.withColumn(out, F.col(out).bitwiseXOR(F.shiftrightunsigned(F.col(out), shift)))
        step = _mul64(step, out, c, out)
    return step.withColumn(out, F.col(out).bitwiseXOR(F.shiftrightunsigned(F.col(out), 31)))


def leading_zeros(x: Column) -> Column:
    """Of the 64-bit pattern; x must not be 0."""
    return F.lit(64) - F.length(F.bin(x))
