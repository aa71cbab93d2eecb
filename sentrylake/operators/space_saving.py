"""Space-Saving: the heaviest keys of each window in a fixed number of counters.

Order matters to this sketch, so a window's events of one partition are one stream. Keys are dealt to `parts`
partitions, each with its own summary of `capacity` counters; summaries of disjoint keys merge by taking the largest.
With one part the summary is the classic one, with several the window is several tasks' work. Once every part has a
counter for each of its keys nothing is evicted and all counts are exact; `parts_without_eviction` finds how many that takes. The root of a binary heap is
evicted, so of several smallest counters the heap's order decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import top_k


class Summary:
    """Counters in a binary heap by count: a counter sinks below its lighter child, the left one if both weigh the same."""

    def __init__(self, capacity: int):
        if capacity <= 0:
            raise ValueError("capacity must be positive")
        self.capacity = capacity
        self.heap: list = []  # keys
        self.place: dict = {}
        self.counts: dict = {}
        self.errors: dict = {}

    def _sink(self, at: int) -> None:
        heap, counts, n = self.heap, self.counts, len(self.heap)
        key = heap[at]
        own = counts[key]
        while (child := 2 * at + 1) < n:
            if child + 1 < n and counts[heap[child + 1]] < counts[heap[child]]:
                child += 1
            if own <= counts[heap[child]]:
                break
            heap[at] = heap[child]
            self.place[heap[at]] = at
            at = child
        heap[at] = key
        self.place[key] = at

    def add(self, key) -> None:
        if key in self.counts:
            self.counts[key] += 1
            self._sink(self.place[key])
            return
        if len(self.heap) < self.capacity:
            self.errors[key], self.counts[key] = 0, 1
            at = len(self.heap)
            self.heap.append(key)
            while at and self.counts[self.heap[up := (at - 1) // 2]] > 1:  # a new counter rises above heavier ones
                self.heap[at] = self.heap[up]
                self.place[self.heap[at]] = at
                at = up
            self.heap[at] = key
            self.place[key] = at
            return
        old = self.heap[0]
        least = self.counts.pop(old)
        del self.errors[old], self.place[old]
        self.errors[key], self.counts[key], self.heap[0] = least, least + 1, key
        self._sink(0)

    def rows(self) -> list[tuple]:
        """(key, count, error), largest first, ties by key."""
        return sorted(((k, c, self.errors[k]) for k, c in self.counts.items()), key=lambda r: (-r[1], r[0] is not None, r[0]))


def summaries(windowed: DataFrame, capacity: int, parts: int = 1) -> DataFrame:
    """(window_id, part, source, n, error): the counters of every window and part. Events stream through; only counters are held."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    kind = dict(windowed.dtypes)["source"]

    dealt = windowed.select("window_id", F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int").alias("part"), "source", "seq")
    ordered = dealt.repartition("window_id", "part").sortWithinPartitions("window_id", "part", "seq")

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, summary = None, None
        for f in frames:
            for key, g in f.groupby(["window_id", "part"], sort=False):
                if key != now:
                    if summary is not None:
                        yield _frame(now, summary)
                    now, summary = key, Summary(capacity)
                for source in g["source"].astype(object).where(g["source"].notna(), None):
                    summary.add(source)
        if summary is not None:
            yield _frame(now, summary)

    return ordered.mapInPandas(stream, f"window_id long, part int, source {kind}, n long, error long")


def parts_without_eviction(windowed: DataFrame, capacity: int) -> int:
    """The fewest parts, a power of two, at which no summary of any window meets more keys than it has counters."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    keys = windowed.select("window_id", "source").distinct()
    parts = 1
    while parts < 1 << 30:
        dealt = keys.groupBy("window_id", F.pmod(F.xxhash64("source"), F.lit(parts)).alias("part")).agg(F.count("*").alias("n"))
        most = dealt.agg(F.max("n")).first()[0] or 0
        if most <= capacity:
            return parts
        while most > capacity:  # parts halve the keys, or nearly so
            parts, most = 2 * parts, (most + 1) // 2
    raise ValueError("more keys share a hash than a summary has counters")


def _frame(key: tuple, summary: Summary) -> pd.DataFrame:
    rows = summary.rows()
    return pd.DataFrame({"window_id": key[0], "part": key[1], "source": pd.Series([r[0] for r in rows], dtype=object), "n": [r[1] for r in rows], "error": [r[2] for r in rows]})


def top(windowed: DataFrame, k: int, capacity: int, parts: int = 1) -> DataFrame:
    """(window_id, source, n, error, rank): the k largest counters of each window."""
    return top_k(summaries(windowed, capacity, parts).drop("part"), k, ["window_id"])


def native(df: DataFrame, within: list[str], key: str, k: int, capacity: int) -> DataFrame:
    """Spark's own approximate top-k: (within, source, n, rank)."""
    best = df.groupBy(*within).agg(F.expr(f"approx_top_k({key}, {int(k)}, {int(capacity)})").alias("_top"))
    return best.select(*within, F.posexplode("_top").alias("_i", "_e")).select(*within, F.col("_e.item").alias("source"), F.col("_e.count").alias("n"), (F.col("_i") + 1).alias("rank"))
