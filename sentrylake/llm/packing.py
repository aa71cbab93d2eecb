"""Best-fit packing of token sequences by linear grouping.

The plan needs only how many pieces there are of each length (1 to 1024), so it is made on the driver from at most
1024 counts, whatever the size of the corpus:
 1. Lengths above SMALL are sorted and cut into GROUPS groups of equal cardinality; each is rounded up to its longest.
 2. With so few sizes, the best mix of configurations (multisets of sizes that fit) is a linear programme, solved by
    column generation; the whole parts of its multiplicities are taken.
 3. Actual lengths replace the rounded ones, longest first. Where that leaves a gap, the smallest of the sequence
    goes back to be fitted in step 4; all do if much is left.
 4. What is left over, and then the small lengths, are best-fit into the gaps, longest first; new sequences open
    only if nothing fits.
Sequences are kept as runs with a multiplicity, so the plan is a short table: (length, rank of the piece among all
of its length) -> (sequence, offset). Ranks come from counts for each input partition, without sorting.

Defined results: null or empty text is the end id alone; repeated rows are packed repeatedly; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .encode import encoder

SIZE, SMALL, GROUPS = 1024, 400, 64
MEMO = 500_000  # chunks that a worker's encoder remembers, some 80 MB: two workers share an executor with a JVM at its full heap
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, path: str, end: int, words: bool, size: int = SIZE) -> DataFrame:
    """Pieces of at most `size` tokens, each with its place among those of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(path, end, words, MEMO), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["body"], strict=True):
                ids = code.ids(text.as_py())
                n = len(ids) // 4
                at, k, length = 0, 0, n % size or min(n, size)
                while at < n:
                    place = seen[length] = seen.get(length, -1) + 1
                    for column, x in zip(out, (doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, place), strict=True):
                        column.append(x)
                    at, k, length = at + length, k + 1, size
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    return rows.mapInArrow(run, PIECE)


def best_pattern(sizes: list[int], values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes that fits."""
    w = np.array(sizes)
    best, took = np.zeros(size + 1), np.full(size + 1, -1)
    low = int(w.min())
    for room in range(low, size + 1):
        fits = w <= room
        gain = np.where(fits, best[room - np.where(fits, w, 0)] + values, -1.0)
        i = int(gain.argmax())
        if gain[i] > best[room - 1] + 1e-12:
            best[room], took[room] = gain[i], i
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(w)), size
    while room >= low:
        if took[room] < 0:
            room -= 1
            continue
        counts[took[room]] += 1
        room -= sizes[took[room]]
    return float(best[size]), counts


def configurations(sizes: list[int], demand: np.ndarray, size: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and the whole parts of their multiplicities in the linear programme's optimum."""
    basis = np.diag([float(size // s) for s in sizes])
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, new = best_pattern(sizes, price, size)
        if value <= 1 + 1e-6:
            break
        x, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, new)
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    x = np.linalg.solve(basis, demand)
    return [(basis[:, j].round().astype(int), int(x[j] + 1e-6)) for j in range(len(sizes)) if x[j] >= 1 - 1e-6]


class Plan:
    """Runs of equal sequences: [multiplicity, room left, slots]; a slot is (length, first rank)."""

    def __init__(self, counts: dict[int, int], size: int = SIZE, small: int = SMALL, groups: int = GROUPS):
        self.size, self.left = size, dict(counts)
        self.next = dict.fromkeys(counts, 0)
        self.runs: list[list] = []
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self._group(small, groups)
        for length in sorted(self.left, reverse=True):
            self._best_fit(length)
        for runs in self.open:
            self.runs += runs

    def _take(self, length: int, n: int) -> int:
        first = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        return first

    def _group(self, small: int, groups: int) -> None:
        large = sorted((n for n in self.left if small < n < self.size), reverse=True)
        total = sum(self.left[n] for n in large)
        if total < 4 * groups:
            return
        queues: list[list[list[int]]] = []  # of each group: [length, count], longest first
        share, filled = total / groups, 0
        for n in large:
            rest = self.left[n]
            while rest:
                g = min(int(filled // share), groups - 1)
                if g >= len(queues):
                    queues.append([])
                    g = len(queues) - 1
                take = rest if g == groups - 1 else min(rest, max(1, int((g + 1) * share) - filled + 1))
                queues[-1].append([n, take])
                rest, filled = rest - take, filled + take
        sizes = [q[0][0] for q in queues]
        demand = np.array([float(sum(c for _, c in q)) for q in queues])
        for pattern, times in configurations(sizes, demand, self.size):
            slots = [g for g, k in enumerate(pattern) for _ in range(k)]
            while times and all(sum(c for _, c in queues[g]) >= slots.count(g) for g in set(slots)):
                # as many equal sequences as the heads of the queues allow
                used: dict[tuple[int, int], int] = {}
                heads, at = [], dict.fromkeys(slots, 0)
                for g in slots:
                    while used.get((g, at[g]), 0) >= queues[g][at[g]][1]:
                        at[g] += 1
                    used[g, at[g]] = used.get((g, at[g]), 0) + 1
                    heads.append((g, at[g]))
                m = min(times, *(queues[g][i][1] // k for (g, i), k in used.items()))
                run = [m, self.size, []]
                lengths = sorted((queues[g][i][0] for g, i in heads), reverse=True)
                gap = self.size - sum(lengths)
                if gap >= lengths[-1] or gap > self.size // 16:
                    lengths = []  # poorly filled: all go to the best fit
                elif gap and len(lengths) > 1:
                    lengths.pop()  # rounding left a gap: the smallest is fitted with the small ones instead
                for length in lengths:
                    run[2].append((length, self._take(length, m)))
                    run[1] -= length
                for (g, i), k in used.items():
                    queues[g][i][1] -= m * k
                for g in set(slots):
                    queues[g] = [x for x in queues[g] if x[1]]
                if run[2]:
                    self.open[run[1]].append(run)
                times -= m

    def _split(self, run: list, n: int) -> list:
        """The first n sequences of a run as a run of their own; the run keeps the rest."""
        part = [n, run[1], list(run[2])]
        run[0] -= n
        run[2] = [(length, first + n) for length, first in run[2]]
        return part

    def _fill(self, run: list, length: int, k: int) -> None:
        """k more pieces of a length into each sequence of a run."""
        for _ in range(k):
            run[2].append((length, self._take(length, run[0])))
        run[1] -= k * length
        self.open[run[1]].append(run)

    def _best_fit(self, length: int) -> None:
        room = length
        while self.left[length] and room <= self.size:
            if not self.open[room]:
                room += 1
                continue
            run = self.open[room].pop()
            k = room // length
            n = min(run[0], self.left[length] // k)
            if n == 0:  # fewer are left than one sequence can take
                k, n = self.left[length], 1
            if n < run[0]:
                part = self._split(run, n)
                self.open[room].append(run)
                run = part
            self._fill(run, length, k)
        if self.left[length]:
            k = self.size // length
            for m, each in ((self.left[length] // k, k), (1, self.left[length] % k)):
                if m and each:
                    self._fill([m, self.size, []], length, each)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Sorted keys length << 44 | first rank, with the run's first sequence and the offset; all sequences."""
        rows, base = [], 0
        for m, _, slots in self.runs:
            at = 0
            for length, first in slots:
                rows.append((length << 44 | first, base, at))
                at += length
            base += m
        rows.sort()
        key, seq, at = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        return key, seq, at, base


def pack(docs: DataFrame, path: str, end: int = 2, words: bool = False, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, end, words, size), "pieces")
    # a row for each partition and length: it grows with the table, so it is joined by a shuffle of the short piece rows
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    plan = spark.sparkContext.broadcast(Plan(totals, size).table()[:3])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, at = plan.value
        for batch in batches:
            want = (batch["length"].to_numpy() << 44) + batch["rank"].to_numpy()
            run = np.searchsorted(key, want, "right") - 1
            yield pa.record_batch([*batch.columns[:5], pa.array(seq[run] + (want - key[run])), pa.array(at[run])], [*batch.schema.names[:5], "sequence_id", "offset"])

    named = cut.join(bases.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    return named.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
