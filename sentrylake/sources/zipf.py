"""Synthetic login events whose sources follow Zipf's law.

The seeded stream is a linear congruential generator modulo 2**48. A partition jumps straight to its own draws and makes
them as arrays, so the same events come out whatever the number of partitions. A user is drawn again where the draw
falls into the remainder of 2**31 by the number of users; each such event moves all later draws by one. They are rare,
so a first pass over the raw draws finds their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import LCG_A, LCG_C

MASK = (1 << 48) - 1
SCHEMA = "seq long, ts_ms long, source long, actor long, action string, outcome string"


def cumulative(sources: int, skew: float) -> np.ndarray:
    """Distribution function over ranks; the last entry is exactly 1."""
    if sources <= 0:
        raise ValueError("sources must be positive")
    if skew < 0:
        raise ValueError("skew must not be negative")
    weights = 1.0 / np.arange(1, sources + 1, dtype=np.float64) ** skew
    out = np.cumsum(weights / np.cumsum(weights)[-1])  # added one by one
    out[-1] = 1.0
    return out


def jump(state: int, steps: int) -> int:
    """The generator's state after so many draws."""
    a, c, add, mul = LCG_A, LCG_C, 0, 1
    while steps:
        if steps & 1:
            mul, add = mul * a & MASK, (add * a + c) & MASK
        a, c, steps = a * a & MASK, (a * c + c) & MASK, steps >> 1
    return (state * mul + add) & MASK


def _states(state: int, n: int) -> np.ndarray:
    """The next n states, by doubling: the states after k draws are one product and sum away from the k before."""
    out = np.empty(n + 1, np.uint64)
    out[0] = state
    mul, add, done = LCG_A, LCG_C, 1  # one draw, then two, four and so on
    while done <= n:
        take = min(done, n + 1 - done)
        out[done : done + take] = (out[:take] * np.uint64(mul) + np.uint64(add)) & np.uint64(MASK)  # wraps at 2**64, a multiple of 2**48
        mul, add, done = mul * mul & MASK, (mul * add + add) & MASK, done * 2
    return out[1:]


def _users(states: np.ndarray, users: int) -> tuple[np.ndarray, np.ndarray]:
    """The user of each draw, and whether it is drawn again."""
    bits = states >> np.uint64(17)
    if not users & (users - 1):
        return (np.uint64(users) * bits) >> np.uint64(31), np.zeros(len(bits), bool)
    chosen = bits % np.uint64(users)
    return chosen, bits - chosen + np.uint64(users - 1) >= np.uint64(1 << 31)


def _again(spark: SparkSession, users: int, seed: int, draws: int) -> list[int]:
    """Places among the raw draws, from 0, that would be drawn again if they chose a user."""
    if not users & (users - 1):
        return []

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["id"].to_numpy()
            if len(ids):
                states = _states(jump((seed ^ LCG_A) & MASK, int(ids[0])), len(ids))
                yield pd.DataFrame({"id": ids[_users(states, users)[1]]})

    return sorted(r.id for r in spark.range(draws).mapInPandas(find, "id long").collect())


def shifts(again: list[int]) -> list[tuple[int, int]]:
    """(event, draws by which the events after it are late) for each event whose user is drawn again."""
    out: list[tuple[int, int]] = []
    late, at = 0, 0
    while at < len(again):
        place = again[at] - late
        at += 1
        if place % 3 == 2:  # the third draw of an event chooses its user
            late += 1
            while at < len(again) and again[at] == again[at - 1] + 1:
                late, at = late + 1, at + 1
            out.append((place // 3, late))
    return out


def zipf_events(spark: SparkSession, sources: int, users: int, skew: float, seed: int, n: int, start_ms: int, span_ms: int) -> DataFrame:
    """n events, evenly spaced from start_ms over span_ms."""
    if users <= 0:
        raise ValueError("users must be positive")
    if users > 1 << 20:
        raise ValueError("over 2**20 users, draws are repeated too often")
    steps = cumulative(sources, skew)
    moved = shifts(_again(spark, users, seed, 3 * n + 3 * (n >> 10) + 64))  # at most about n / 2**10 of them, as users is bounded
    events, late = (np.array([m[i] for m in moved], np.int64) for i in range(2))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["id"].to_numpy()
            if not len(ids):
                continue
            total = np.concatenate([[0], late])
            before = total[np.searchsorted(events, ids, "left")]  # events before this one
            after = total[np.searchsorted(events, ids, "right")]  # and itself
            first = 3 * int(ids[0]) + int(before[0])
            states = _states(jump((seed ^ LCG_A) & MASK, first), int(3 * ids[-1] + after[-1]) + 3 - first)
            at = 3 * ids + before - first
            uniform = (((states[at] >> np.uint64(22)) << np.uint64(27)) + (states[at + 1] >> np.uint64(21))).astype(np.float64) / (1 << 53)
            chosen = _users(states[at + 2 + (after - before)], users)[0].astype(np.int64)
            rank = np.minimum(np.searchsorted(steps, uniform, side="left"), sources - 1)
            yield pd.DataFrame({"seq": ids, "ts_ms": start_ms + ids * span_ms // max(n, 1), "source": rank.astype(np.int64), "actor": chosen, "action": "LOGIN", "outcome": "FAILURE"})

    return spark.range(n).mapInPandas(make, SCHEMA)
