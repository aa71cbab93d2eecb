"""Count-Min sketch as DataFrames: a cell is (row, col) within a group, an estimate the least cell of a key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import fmix32, seeds

_MASK = 62  # widths of one mask, as bits of a long


def sizes(error: float, failure: float) -> tuple[int, int]:
    """Width and depth for an error of `error` times the total, exceeded with probability `failure`."""
    if not (0 < error < 1 and 0 < failure < 1):
        raise ValueError("error and failure must be between 0 and 1")
    return math.ceil(math.e / error), max(math.ceil(math.log(1 / failure)), 1)


def _check(width: int, depth: int) -> None:
    if width <= 0 or depth <= 0:
        raise ValueError("width and depth must be positive")


def with_cells(df: DataFrame, key: str, width: int, depth: int, seed: int) -> DataFrame:
    """A row for each sketch row: adds r and col. Two hashes make all columns."""
    _check(width, depth)
    a, b = seeds(seed)
    hashed = df.withColumn("_h1", fmix32(F.col(key), a)).withColumn("_h2", fmix32(F.col(key), b).bitwiseOR(F.lit(1)))
    rows = hashed.withColumn("r", F.explode(F.array(*(F.lit(i) for i in range(depth)))))
    return rows.withColumn("col", (F.col("_h1") + F.col("r") * F.col("_h2")).bitwiseAND(F.lit(0x7FFFFFFF)) % width).drop("_h1", "_h2")


def cells(df: DataFrame, within: list[str], key: str, width: int, depth: int, seed: int) -> DataFrame:
    """(within, r, col, n): the sketch of each group. Counted by key first, so the exploded rows are one for each key."""
    per_key = df.groupBy(*within, key).agg(F.count("*").alias("_n"))
    return with_cells(per_key, key, width, depth, seed).groupBy(*within, "r", "col").agg(F.sum("_n").alias("n"))


def estimates(df: DataFrame, within: list[str], key: str, width: int, depth: int, seed: int) -> DataFrame:
    """(within, key, n, estimate): every key's count and its estimate when the window closes."""
    per_key = df.groupBy(*within, key).agg(F.count("*").alias("n"))
    spread = with_cells(per_key, key, width, depth, seed)
    sketch = spread.groupBy(*within, "r", "col").agg(F.sum("n").alias("_cell"))
    return spread.join(sketch, [*within, "r", "col"]).groupBy(*within, key).agg(F.first("n").alias("n"), F.min("_cell").alias("estimate"))


def incremental_alerts(logins: DataFrame, threshold: int, width: int, depth: int, seed: int, slice_size: int = 1 << 18) -> DataFrame:
    """(window_id, source) of sources whose estimate reaches the threshold at an event of their own."""
    return alerts_by_width(logins, threshold, [width], depth, seed, slice_size).select("window_id", "source")


def alerts_by_width(logins: DataFrame, threshold: int, widths: list[int], depth: int, seed: int, slice_size: int = 1 << 18) -> DataFrame:
    """(width, window_id, source): the incremental alerts of a sketch of each width, all in one plan."""
    found = decided(logins, threshold, widths, depth, seed, slice_size)
    return found.select(F.explode(raised(widths)).alias("width"), "window_id", "source")


def raised(widths: list[int]) -> Column:
    """The widths at which a row of decided() is an alert, as an array."""
    return F.array_compact(F.array(*(F.when(F.get("masks", i // _MASK).bitwiseAND(F.lit(1 << i % _MASK)) != 0, F.lit(w).cast("long")) for i, w in enumerate(widths))))


def decided(logins: DataFrame, threshold: int, widths: list[int], depth: int, seed: int, slice_size: int = 1 << 18) -> DataFrame:
    """(window_id, source, n, masks): every source's count, and as bits the widths at which a sketch raises an alert.

    Cells are running counts in event order: collisions that come after a source's last event raise no alert. They only
    grow, so a source is an alert if each of its cells has its `threshold`-th event at the source's last one or before.
    That event is among the first `threshold` of some source, so no more events of a source are looked at and a hot
    source is a few rows. All widths share the remainder by their common divisor: a row goes once, whatever the number
    of widths, to the group of its window, sketch row and remainder, and groups are taken whole, in slices of about
    `slice_size` rows. A null source has no cells and goes by its own count.
    """
    for w in widths:
        _check(w, depth)
    t, (a, b) = max(threshold, 1), seeds(seed)
    totals = logins.groupBy("window_id", "source").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    order = Window.partitionBy("window_id", "source").orderBy("seq")
    first = logins.where("source IS NOT NULL").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= t)
    nothing = F.lit(None).cast("long")
    both = totals.select("window_id", "source", "n", "last", nothing.alias("seq")).unionByName(first.select("window_id", "source", nothing.alias("n"), nothing.alias("last"), F.col("seq").cast("long").alias("seq")))
    keys = both.groupBy("window_id", "source").agg(F.max("n").alias("n"), F.max("last").alias("last"), F.collect_list("seq").alias("seqs"))  # nulls are left out

    hashed = keys.where("source IS NOT NULL").withColumn("_h1", fmix32(F.col("source"), a)).withColumn("_h2", fmix32(F.col("source"), b).bitwiseOR(F.lit(1)))
    rows = hashed.withColumn("r", F.explode(F.array(*(F.lit(i) for i in range(depth)))))
    rows = rows.withColumn("c", (F.col("_h1") + F.col("r") * F.col("_h2")).bitwiseAND(F.lit(0x7FFFFFFF))).withColumn("g", F.col("c") % math.gcd(*widths))
    group = [F.col("window_id").isNull().alias("w0"), F.coalesce("window_id", F.lit(0)).cast("long").alias("w"), "r", "g"]
    dealt = rows.select(*group, "window_id", "source", "n", "c", "last", "seqs")
    names = ["w0", "w", "r", "g"]
    ordered = dealt.repartition(*names).sortWithinPartitions(*names)
    schema = dealt.select("window_id", "source", "n").schema.add("masks", T.ArrayType(T.LongType()))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= slice_size:
                whole = pa.Table.from_batches(held)
                start = _starts(whole, names)[-1]  # of the last group, which may go on
                if start:
                    yield from _decided(whole.slice(0, start), names, t, widths)
                held = whole.slice(start).to_batches()
                size = min(size - start, slice_size // 2) if start else slice_size // 2  # a large group grows before it is looked at again
        if held:
            yield from _decided(pa.Table.from_batches(held), names, t, widths)

    masks = [F.bit_and(F.get("masks", i)) for i in range(-(-len(widths) // _MASK))]  # an alert has the threshold in every row
    every = ordered.mapInArrow(decide, schema).groupBy("window_id", "source").agg(F.any_value("n").alias("n"), F.array(*masks).alias("masks"))
    own = [F.when(F.col("n") >= threshold, F.lit((1 << min(_MASK, len(widths) - i)) - 1)).otherwise(F.lit(0)).cast("long") for i in range(0, len(widths), _MASK)]
    return every.unionByName(totals.where("source IS NULL").select("window_id", "source", "n", F.array(*own).alias("masks")))


def _starts(rows: pa.Table, names: list[str]) -> np.ndarray:
    """First rows of the groups of a table that is ordered by `names`."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in names:
        column = rows[name].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _decided(rows: pa.Table, names: list[str], threshold: int, widths: list[int]) -> Iterator[pa.RecordBatch]:
    """Whole groups: at which widths each row's cell has its `threshold`-th event at the row's last one or before."""
    count = rows.num_rows
    if not count:
        return
    start = _starts(rows, names)
    group = np.repeat(np.arange(len(start)), np.diff(start, append=count))
    c, last = rows["c"].to_numpy(), rows["last"].to_numpy()
    lists = rows["seqs"].combine_chunks()
    seq, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(count), lists.value_lengths().to_numpy(zero_copy_only=False))
    by_time = np.argsort(seq, kind="stable")
    seq, owner = seq[by_time], owner[by_time]
    masks = np.zeros((count, -(-len(widths) // _MASK)), np.int64)
    for i, width in enumerate(widths):
        cell = (group * width + c % width)[owner]
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        sizes = np.diff(first, append=len(order))
        reached = np.where(sizes >= threshold, seq[order][np.minimum(first + threshold - 1, len(order) - 1)], np.iinfo(np.int64).max)
        of = np.empty(count, np.int64)  # the row's cell
        of[owner[order]] = np.repeat(np.arange(len(first)), sizes)
        hit = (sizes[of] >= threshold) & (last >= reached[of])
        masks[hit, i // _MASK] |= np.int64(1 << i % _MASK)
    out = rows.select(["window_id", "source", "n"])
    packed = pa.ListArray.from_arrays(np.arange(0, masks.size + 1, masks.shape[1], dtype=np.int32), pa.array(masks.ravel()))
    yield from out.append_column("masks", packed).to_batches(max_chunksize=1 << 16)


def close_alerts(logins: DataFrame, threshold: int, width: int, depth: int, seed: int) -> DataFrame:
    """(window_id, source) of sources whose estimate is at the threshold when the window closes; cheaper, and never fewer."""
    return estimates(logins, ["window_id"], "source", width, depth, seed).where(F.col("estimate") >= threshold).select("window_id", "source")


def native(df: DataFrame, within: list[str], key: str, error: float, confidence: float, seed: int) -> DataFrame:
    """Spark's own Count-Min sketch as binary, one for each group."""
    return df.groupBy(*within).agg(F.count_min_sketch(F.col(key), F.lit(error), F.lit(confidence), F.lit(seed)).alias("sketch"))
