"""Approximate nearest neighbours by shifted space-filling curves.

Equal vectors are one class with its smallest ids. Each of CURVES orderings projects the unit vectors onto DIMS random
orthogonal directions, shifts them, and takes their place on a Hilbert curve as a 64-bit key. Spark range-partitions the rows
of every curve by key; positions come from counts of the partitions. A query is compared with all that stand within a
window around it, on every curve, by exact cosine in double precision; the best are merged for each query.

The window is measured on the table itself: for at most PROBES queries the true neighbours are found by comparing them
with all rows, and the window is what holds the share TARGET of these neighbours on at least one curve. So it is small
where vectors have structure and grows with the table where they have none, and recall stays. Blocks of at most BLOCK
positions cover the window. Directions and shifts are fitted to the spread of at most SAMPLE vectors. Both are documented
bounds of the fit; every row is indexed.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
an id; vectors of different lengths are compared as if zeros followed the shorter one; a repeated id or row is a row of
its own, both as query and as candidate; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CURVES, DIMS, BITS = 24, 16, 4
SAMPLE, PROBES = 10_000, 64
TARGET, LEAST, BLOCK = 0.96, 256, 16_384  # share of the probes' neighbours; smallest window; positions of a block at most


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells [n, dims], dims * bits <= 64, as unsigned 64-bit integers.

    Gray-code form: axes are brought to the curve's transposed index bit by bit, from the highest, and the index is
    read off across the axes.
    """
    x = [c.copy() for c in cells.T.astype(np.uint64)]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        low = bit - one
        for axis in x:
            high = (axis & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(high, low, swap)
            if axis is not x[0]:
                axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        flip ^= np.where((x[-1] & bit) != 0, bit - one, np.uint64(0))
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | (((axis ^ flip) >> np.uint64(level)) & one)
    return key


class Curves:
    """Directions, ranges and shifts of all curves; of fixed size."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int = 29):
        width = sample.shape[1]
        dims = min(dims, width)
        self.bits, rng, self.maps = bits, np.random.default_rng(seed), []
        for _ in range(curves):
            axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims]
            low, high = np.quantile(sample @ axes, [0.001, 0.999], axis=0)
            self.maps.append((axes, low, np.maximum(high - low, 1e-12), rng.random(dims) * 0.5))

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        """Signed 64-bit keys in the curve's order."""
        axes, low, span, shift = self.maps[curve]
        unit = _wide(unit, len(axes))[:, : len(axes)]
        cells = np.clip(((unit @ axes - low) / span * 0.5 + shift) * (1 << self.bits), 0, (1 << self.bits) - 1)
        return (hilbert_keys(cells.astype(np.uint64), self.bits) ^ np.uint64(1 << 63)).view(np.int64)


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    """Rows with zeros up to a width."""
    return np.hstack([x, np.zeros((len(x), width - x.shape[1]))]) if x.shape[1] < width else x


def _matrix(rows, kind: str) -> np.ndarray:
    """Raw vectors, kept in the table's own precision, as doubles; zeros follow the shorter ones."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    if (sizes == sizes[0]).all():
        return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    out = np.zeros((len(rows), int(sizes.max()) // np.dtype(kind).itemsize))
    for i, row in enumerate(rows):
        v = np.frombuffer(row, kind)
        out[i, : len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that no square overflows or vanishes."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def _kind(vectors: DataFrame, vec_col: str) -> str:
    return "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): valid vectors as raw floats or doubles, without zeros at the end."""
    kind = _kind(vectors, vec_col)
    arr = F.col(vec_col).cast("array<double>")
    bad = F.exists(arr, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select(F.col(id_col).cast("long").alias("id"), arr.alias("arr")).where(F.col("id").isNotNull() & ~bad & F.exists("arr", lambda x: x != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch["arr"].flatten().to_numpy(zero_copy_only=False).astype(kind) + 0, np.cumsum(pa.compute.list_value_length(batch["arr"]).to_numpy())  # -0 becomes 0
            yield pa.record_batch([batch["id"], pa.array([_trimmed(x) for x in np.split(flat, ends[:-1])], pa.binary())], ["id", "v"])

    return good.mapInArrow(pack, "id long, v binary")


def _trimmed(x: np.ndarray) -> bytes:
    return x.tobytes() if x[-1] else x[: np.flatnonzero(x)[-1] + 1].tobytes()


def _scores(x: np.ndarray, unit: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows a and b, from the original vectors; from the unit ones where squares overflow or vanish."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        length = np.sqrt((x * x).sum(axis=1))
        score = (x[a] * x[b]).sum(axis=1) / (length[a] * length[b])
    return np.where(np.isfinite(score), score, (unit[a] * unit[b]).sum(axis=1))


def _true_neighbours(classes: DataFrame, probes: list[tuple[int, bytes]], k: int, kind: str) -> list[tuple[int, int]]:
    """(probe's cid, neighbour's cid): the k nearest classes of each probe, by comparison with all."""
    sent = classes.sparkSession.sparkContext.broadcast(probes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([c for c, _ in sent.value])
        asked = _unit(_matrix([v for _, v in sent.value], kind))
        best, who = np.full((len(ids), k), -2.0), np.full((len(ids), k), -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, cid = _unit(_matrix(batch["v"].to_pylist(), kind)), batch["cid"].to_numpy()
            width = max(asked.shape[1], unit.shape[1])
            near = _wide(asked, width) @ _wide(unit, width).T
            near[ids[:, None] == cid[None, :]] = -2
            both, names = np.hstack([best, near]), np.hstack([who, np.broadcast_to(cid, near.shape)])
            order = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best, who = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        keep = best > -2
        yield pa.record_batch([pa.array(np.repeat(ids, keep.sum(1))), pa.array(who[keep]), pa.array(best[keep])], ["q", "cid", "score"])

    found = classes.select("cid", "v").mapInArrow(compare, "q long, cid long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    return [(r.q, r.cid) for r in found.withColumn("r", rank).where(F.col("r") <= k).collect()]  # at most PROBES * k


def _window(pairs: list[tuple[int, int]], places: list, target: float) -> int:
    """Positions on either side that hold the share `target` of the pairs on at least one curve. places: (cid, curve, position)."""
    at: dict[int, dict[int, int]] = {}
    for cid, curve, position in places:
        at.setdefault(cid, {})[curve] = position
    apart = sorted(min(abs(p - at[b][c]) for c, p in at[a].items()) for a, b in pairs)
    return apart[max(0, int(np.ceil(target * len(apart))) - 1)] if apart else 1


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, curves: int = CURVES, target: float = TARGET, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, window: the k nearest found of every row whose id is divisible by `every`."""
    spark, kind = vectors.sparkSession, _kind(vectors, vec_col)
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    smallest = Window.partitionBy("v").orderBy("id")  # cut to k + 1 rows before the exchange too
    few = rows.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
    classes = written(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("cid", F.xxhash64("v")), "classes")
    asked = rows.where(F.col("id") % every == 0).groupBy(F.col("id").alias("query_id"), "v").agg(F.count("*").alias("copies"))
    queries = written(asked.withColumn("cid", F.xxhash64("v")), "queries")
    sample = classes.orderBy("cid").select("v").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, window long")
    sizes = [len(r.v) for r in sample]
    usual = max(set(sizes), key=lambda n: (sizes.count(n), n))
    fitted = Curves(_unit(_matrix([r.v for r in sample if len(r.v) == usual], kind)), curves, DIMS, BITS)
    maps = spark.sparkContext.broadcast(fitted)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch["v"].to_pylist(), kind))
            for c in range(curves):
                yield pa.record_batch([pa.array(np.full(len(unit), c), pa.int32()), pa.array(maps.value.keys(unit, c)), batch["cid"], batch["asked"]], ["curve", "key", "cid", "asked"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = batch["curve"].to_numpy()
            place = np.empty(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                own = curve == c
                first = seen.get(c, 0)
                place[own] = first + np.arange(own.sum())
                seen[c] = first + int(own.sum())
            yield pa.record_batch([pa.array(np.full(len(curve), part), pa.int32()), pa.array(place), batch["curve"], batch["cid"], batch["asked"]], ["part", "place", "curve", "cid", "asked"])

    wanted = queries.select("cid").distinct().withColumn("asked", F.lit(True))
    points = classes.join(wanted, "cid", "left").select("cid", F.coalesce("asked", F.lit(False)).alias("asked"), "v")
    keyed = points.mapInArrow(order, "curve int, key long, cid long, asked boolean")
    laid = written(keyed.repartitionByRange("curve", "key", "cid").sortWithinPartitions("curve", "key", "cid").mapInArrow(number, "part int, place long, curve int, cid long, asked boolean"), "curves")  # without the vectors
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("curve", "part").agg(F.count("*").alias("n")).select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = laid.join(starts, ["curve", "part"]).select("curve", (F.col("base") + F.col("place")).alias("at"), "cid", "asked")

    chosen = classes.join(wanted, "cid", "left_semi").orderBy(F.xxhash64("cid"), "cid").select("cid", "v").limit(PROBES).collect()
    pairs = _true_neighbours(classes, [(r.cid, bytes(r.v)) for r in chosen], k, kind)
    met = sorted({c for pair in pairs for c in pair})  # at most PROBES * (k + 1)
    window = max(LEAST, _window(pairs, [tuple(r) for r in placed.where(F.col("cid").isin(met)).select("cid", "curve", "at").collect()], target))
    size = min(window, block)
    reach = -(-window // size)

    here = F.array(F.struct(F.lit(0).alias("d"), F.lit(True).alias("row")))
    around = F.when(F.col("asked"), F.array(*(F.struct(F.lit(d).alias("d"), F.lit(d == 0).alias("row")) for d in range(-reach, reach + 1)))).otherwise(here)
    sent = placed.withColumn("block", F.floor(F.col("at") / size)).withColumn("to", F.explode(around)).select("curve", (F.col("block") + F.col("to.d")).alias("block"), "cid", "asked", F.col("to.row").alias("row"))
    sent = sent.join(classes.select("cid", "v"), "cid")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        cid, row, ask = frame["cid"].to_numpy(), np.flatnonzero(frame["row"].to_numpy()), np.flatnonzero(frame["asked"].to_numpy())
        out: list[tuple[int, int, float]] = []
        if len(row) and len(ask):
            x = _matrix(frame["v"].tolist(), kind)
            unit = _unit(x)
            for i in range(0, len(ask), 256):
                near = unit[ask[i : i + 256]] @ unit[row].T
                least = np.partition(near, -min(k + 1, len(row)), axis=1)[:, -min(k + 1, len(row))]
                a, b = np.nonzero(near >= least[:, None] - 1e-9)
                a, b = ask[i + a], row[b]
                out += zip(cid[a].tolist(), cid[b].tolist(), _scores(x, unit, a, b).tolist(), strict=True)
        return pd.DataFrame(out, columns=["q", "cid", "score"])

    found = sent.groupBy("curve", "block").applyInPandas(compare, "q long, cid long, score double").groupBy("q", "cid").agg(F.max("score").alias("score"))
    named = found.join(classes.select("cid", "ids"), "cid")
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))
    best = named.withColumn("r", first).where(F.col("r") <= k + 1)
    each = queries.withColumnRenamed("cid", "q").drop("v").join(best, "q")
    others = F.when(F.col("cid") == F.col("q"), _without("ids", "query_id")).otherwise(F.col("ids"))
    every_one = each.select("query_id", "q", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "score", others.alias("ids")).withColumn("vec_id", F.explode("ids"))
    rank = F.row_number().over(Window.partitionBy("query_id", "q", "copy").orderBy(F.desc("score"), "vec_id"))
    return every_one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(window).cast("long").alias("window"))


def _without(ids: str, own: str) -> Column:
    """The sorted ids without the first that is a query's own: the row itself."""
    return F.when(F.array_contains(ids, F.col(own)), F.concat(F.filter(ids, lambda x: x < F.col(own)), F.slice(F.filter(ids, lambda x: x == F.col(own)), 2, F.size(ids)), F.filter(ids, lambda x: x > F.col(own)))).otherwise(F.col(ids))
