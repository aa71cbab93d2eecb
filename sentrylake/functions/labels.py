"""Labels that hide addresses, and small formatting helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def masked(address: Column) -> Column:
    """An IPv4 address without its last part, an IPv6 address without all but three groups; blank is unknown."""
    colons = F.length(address) - F.length(F.replace(address, F.lit(":")))
    tail = F.length(F.substring_index(address, ".", -1))
    v6 = F.when(colons >= 3, F.concat(F.substring_index(address, ":", 3), F.lit("::x"))).otherwise(address)
    v4 = F.when(F.contains(address, F.lit(".")), F.concat(F.substring(address, F.lit(1), F.length(address) - tail), F.lit("x"))).otherwise(address)
    return F.when(address.isNull() | address.rlike(r"^\s*$"), UNKNOWN).when(colons > 0, v6).otherwise(v4)


def synthetic(key: Column) -> Column:
    """An address of the benchmarking range for a number; the last part runs from 1 to 256, ids repeat from 131,072 on."""
    part = lambda shift, mask: F.shiftright(key, shift).bitwiseAND(F.lit(mask))
    return F.concat_ws(".", F.lit("198"), part(16, 1) + 18, part(8, 255), part(0, 255) + 1)


def readable_bytes(n: Column) -> Column:
    """A count of bytes in B, KB or MB; a decimal for broken KB below 100 and for broken MB (fixed values)."""
    kb, mb = n / 1024, n / (1 << 20)
    whole, broken = (lambda x: F.call_function("format_number", x, F.lit("0"))), (lambda x: F.call_function("format_number", x, F.lit("0.0")))
    in_kb = F.when((kb < 100) & (kb != F.floor(kb)), broken(kb)).otherwise(whole(kb))
    in_mb = F.when(mb == F.floor(mb), whole(mb)).otherwise(broken(mb))
    return F.when(n == 0, F.lit("0")).when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(in_kb, F.lit(" KB"))).otherwise(F.concat(in_mb, F.lit(" MB")))


#: Steps of a chart's upper end within a power of ten of kilobytes.
STEPS = (1, 1.2, 1.6, 2, 2.4, 3.2, 4, 5, 6, 8, 10)


def chart_ceiling(n: Column) -> Column:
    """The upper end of a chart for a largest value of n bytes: the next step, in bytes; 1,024 (a fixed value) for nothing."""
    kb = n / 1024
    power = F.pow(F.lit(10.0), F.floor(F.log10(kb)))
    out = F.when(n <= 0, F.lit(1024.0))
    for step in STEPS:
        out = out.when(kb <= F.lit(float(step)) * power, F.lit(float(step)) * power * 1024)
    return out.otherwise(F.lit(10.0) * power * 1024)
