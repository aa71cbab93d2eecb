"""Resharding by minimum-cost flow, under the law `bytes`: shard sizes as near equal as whole blocks allow.

A layout is a folder with a folder `shard=N` of Parquet files for each shard. A row has its text's hash and size, and
the columns of the table in a struct. A row's slot is its place in the shard: rows in the files before it (by name),
then its place in the file. So slots are gapless by construction and nothing has to be sorted.

Rows belong to blocks, which move whole. A block is a bucket of the text's hash, so equal texts share one. Of a bucket
over half a shard the texts that are that large by themselves are split by row, and the others into blocks by text.
 1. Bytes of every block in every old shard: a grouped sum over two small columns of the old layout's files. There are
    at most a fixed number of blocks, whatever the rows. A block's home is the old shard with most of its bytes.
 2. Flow network: old shards supply the bytes at home there, new shards take their capacity (equal, or as given), an
    arc from an old shard to itself costs nothing, to another one in its rack a little less than to one elsewhere. The
    cheapest flow moves the fewest bytes, and of those flows it is one with the fewest bytes between racks.
 3. For every arc between different shards blocks are chosen, largest first, as long as they fit its flow.
    A few more single blocks then even out what no block fitted.
 4. Shards that gain or lose a row are written anew; of the others the files stay where they are.

Defined results: null text counts as empty (16 bytes); repeated rows each get a slot; a null doc_id is a row like any
other; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch

OVERHEAD = 16
BUCKETS = 20_480
FILE_BYTES, FILES = 128 << 20, 16_384  # of text in a file, less where there is little; at most about so many files
WRITERS = 4_096  # tasks that write a first layout
SPLIT = 2  # a text over the SPLITth part of a shard
PARTS = 512  # is split into blocks of about the PARTSth part of one
RACKS = 4
HOT = 1 << 20  # parts of the first split text are numbered from here on


class FlowNetwork:
    """Minimum-cost flow by successive shortest paths with potentials."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = []  # to, room, cost; an arc's reverse is its neighbour
        self.of: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        self.of[a].append(len(self.arcs))
        self.of[b].append(len(self.arcs) + 1)
        self.arcs += [[b, room, cost], [a, 0, -cost]]
        return len(self.arcs) - 2

    def flow(self, arc: int) -> int:
        return self.arcs[arc + 1][1]

    def run(self, s: int, t: int) -> tuple[int, int]:
        """(flow, cost) of the largest flow at the least cost; costs must not be negative at first."""
        n, total, cost = len(self.of), 0, 0
        potential = [0] * n
        while True:
            far: list[float] = [float("inf")] * n
            by = [-1] * n
            far[s], heap = 0, [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for i in self.of[a]:
                    b, room, c = self.arcs[i]
                    if room and d + c + potential[a] - potential[b] < far[b]:
                        far[b], by[b] = d + c + potential[a] - potential[b], i
                        heapq.heappush(heap, (far[b], b))
            if by[t] < 0:
                return total, cost
            for a in range(n):
                if far[a] < float("inf"):
                    potential[a] += int(far[a])
            path, a = [], t
            while a != s:
                path.append(by[a])
                a = self.arcs[by[a] ^ 1][0]
            most = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= most
                self.arcs[i ^ 1][1] += most
                cost += most * self.arcs[i][2]
            total += most


def rack(shard: int) -> int:
    return shard % RACKS


def transfers(old: list[int], new: list[int], rack_of: Callable[[int], int] = rack) -> dict[tuple[int, int], int]:
    """Bytes to move from old shard i to new shard j; shard i of both is the same place."""
    net, n, m = FlowNetwork(len(old) + len(new) + 2), len(old), len(new)
    s, t = n + m, n + m + 1
    near, far = 1_000, 1_001  # so that no saving between racks outweighs a byte more
    for i, size in enumerate(old):
        net.arc(s, i, size, 0)
    arcs = {(i, j): net.arc(i, n + j, old[i], 0 if i == j else near if rack_of(i) == rack_of(j) else far) for i in range(n) for j in range(m) if old[i]}
    for j, room in enumerate(new):
        net.arc(n + j, t, room, 0)
    net.run(s, t)
    return {k: f for k, a in arcs.items() if k[0] != k[1] and (f := net.flow(a))}


Block = tuple[int, int]


def _even_out(where: dict[Block, int], sizes_of: dict[Block, int], shards: int, new_shards: int) -> None:
    """What no block fitted: moves single blocks from the fullest shard to the emptiest while that narrows their gap."""
    held: list[list[tuple[int, Block]]] = [[] for _ in range(shards)]
    sizes = [0] * shards
    for key, shard in where.items():
        bisect.insort(held[shard], (sizes_of[key], key))
        sizes[shard] += sizes_of[key]
    for _ in range(50 * new_shards):
        high, low = max(range(new_shards), key=sizes.__getitem__), min(range(new_shards), key=sizes.__getitem__)
        gap = sizes[high] - sizes[low]
        at = bisect.bisect_left(held[high], (gap // 2 + 1,))  # half the gap is best, less than all of it still helps
        fits = [i for i in (at - 1, at) if 0 <= i < len(held[high]) and held[high][i][0] < gap]
        if not fits:
            break
        size, key = held[high].pop(min(fits, key=lambda i: abs(held[high][i][0] - gap / 2)))
        bisect.insort(held[low], (size, key))
        where[key] = low
        sizes[high], sizes[low] = sizes[high] - size, sizes[low] + size


def capacities(total: int, weights: list[int]) -> list[int]:
    """The total shared out by weight, in whole bytes."""
    every, out, given, before = sum(weights), [], 0, 0
    for w in weights:
        before += w
        out.append(total * before // every - given)
        given += out[-1]
    return out


def plan(blocks: dict[Block, dict[int, int]], weights: list[int]) -> dict[Block, int]:
    """blocks: (bucket, part) -> bytes in each old shard. The new shard of each block."""
    sizes = {key: sum(own.values()) for key, own in blocks.items()}
    home = {key: max(own, key=lambda s: (own[s], -s)) for key, own in blocks.items()}
    old_shards = 1 + max((s for own in blocks.values() for s in own), default=0)
    old = [0] * old_shards
    members: list[list[Block]] = [[] for _ in range(old_shards)]
    for key in sorted(blocks, key=lambda k: (-sizes[k], k)):
        old[home[key]] += sizes[key]
        members[home[key]].append(key)
    where = dict(home)
    moved: set[Block] = set()
    for (i, j), room in sorted(transfers(old, capacities(sum(old), weights)).items(), key=lambda x: (-x[1], x[0])):
        for key in members[i]:
            if key not in moved and sizes[key] <= room:
                moved.add(key)
                where[key] = j
                room -= sizes[key]
    for key, shard in where.items():
        if shard >= len(weights):  # of a shard that goes; no block fitted what was left
            where[key] = min(range(len(weights)), key=lambda j: sum(sizes[k] for k, s in where.items() if s == j))
    if len(set(weights)) == 1:
        _even_out(where, sizes, max(old_shards, len(weights)), len(weights))
    return where


@dataclass(frozen=True)
class Layout:
    """Shards as they lie: which of them are found under which folder."""

    roots: dict[str, list[int]]
    schema: str

    def rows(self, spark: SparkSession) -> DataFrame:
        """shard, size, h, row of every row, with the files' own _metadata."""
        out = None
        for root, shards in self.roots.items():
            one = spark.read.schema(self.schema).parquet(root).where(F.col("shard").isin(shards))
            one = one.select("shard", "size", "h", "row", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
            out = one if out is None else out.unionByName(one)
        return out

    def numbered(self, spark: SparkSession) -> DataFrame:
        """shard, size, row and the row's slot."""
        rows = self.rows(spark)
        files = rows.groupBy("shard", "_file").agg(F.count("*").alias("n"))
        before = Window.partitionBy("shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        first = files.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        return rows.join(F.broadcast(first), "_file").select("shard", "size", "row", (F.col("first") + F.col("_at")).alias("slot"))  # a row for each file: at most about FILES


def _write(rows: DataFrame, path: str) -> None:
    """Rows into folders by shard; each task keeps its files open, so it need not sort."""
    conf = rows.sparkSession.conf
    name = "spark.sql.maxConcurrentOutputFileWriters"
    was = conf.get(name, None)
    conf.set(name, "256")
    try:
        rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    finally:
        conf.unset(name) if was is None else conf.set(name, was)


def write_layout(docs: DataFrame, path: str, shards: int) -> Layout:
    """A first layout: the bucket of a row's text gives the shard. No shuffle; at most WRITERS tasks write to each shard."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*plain)
    text = F.col(plain[names.index("text")])
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")
    row = F.struct(*(F.col(p).alias(n) for p, n in zip(plain, names, strict=True)))
    named = rows.select(F.xxhash64(text).alias("h"), size.alias("size"), row.alias("row")).withColumn("shard", _bucket(F.col("h")) % shards)
    _write(named.coalesce(WRITERS), path)
    return Layout({path: list(range(shards))}, named.schema.toDDL())


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _part(hot: dict[int, tuple[int, int]], cold: dict[int, int]) -> Column:
    """The part of a row within its bucket. hot: hash of a split text -> its number and parts; cold: bucket -> parts."""
    part = F.lit(0)
    if cold:
        n = F.element_at(F.create_map(*(F.lit(x) for pair in cold.items() for x in pair)), _bucket(F.col("h")))
        part = F.coalesce(F.pmod(F.xxhash64("h", F.lit("cold")), n.cast("long")).cast("int"), part)
    if hot:
        of = F.element_at(F.create_map(*(x for h, (i, n) in hot.items() for x in (F.lit(h).cast("long"), F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"))))), F.col("h"))
        row = F.pmod(F.xxhash64("_file", "_at"), of["n"].cast("long")).cast("int")  # equal rows too lie in different places
        part = F.when(of.isNotNull(), (of["i"] + 1) * HOT + row).otherwise(part)
    return part


def _blocks(rows: DataFrame, new_shards: int) -> tuple[dict[Block, dict[int, int]], dict, dict]:
    """Bytes of every block in every old shard; and what splits large buckets."""

    def sizes(part: Column, of: DataFrame) -> dict[Block, dict[int, int]]:
        out: dict[Block, dict[int, int]] = {}
        for r in of.groupBy(_bucket(F.col("h")).alias("bucket"), part.alias("part"), "shard").agg(F.sum("size").alias("bytes")).toLocalIterator():
            out.setdefault((r["bucket"], r["part"]), {})[r["shard"]] = r["bytes"]
        return out

    blocks = sizes(F.lit(0), rows)
    share = max(1, sum(b for own in blocks.values() for b in own.values()) // new_shards)
    large = {bucket: sum(own.values()) for (bucket, _), own in blocks.items() if SPLIT * sum(own.values()) > share}  # fewer than SPLIT * new_shards
    if not large:
        return blocks, {}, {}
    inside = rows.where(_bucket(F.col("h")).isin(list(large)))
    found = inside.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * SPLIT > share).orderBy("h").collect()  # as few
    hot = {r["h"]: (i, -(-PARTS * r["bytes"] // share)) for i, r in enumerate(found)}
    rest = dict(large)
    for r in found:
        rest[r["h"] % BUCKETS] -= r["bytes"]
    cold = {bucket: -(-PARTS * b // share) for bucket, b in rest.items() if SPLIT * b > share}
    again = sizes(_part(hot, cold), inside)
    return {k: v for k, v in blocks.items() if k[0] not in large} | again, hot, cold


def reshard(spark: SparkSession, old: Layout, path: str, new_shards: int = 40, weights: list[int] | None = None) -> tuple[Layout, set[int]]:
    """Write the shards that change to `path`; the layout from then on, and the shards written."""
    rows, weights = old.rows(spark), weights or [1] * new_shards
    blocks, hot, cold = _blocks(rows, len(weights))
    where = plan(blocks, weights)
    changed = {s for k, own in blocks.items() if set(own) != {where[k]} for s in (*own, where[k])}
    total = sum(b for own in blocks.values() for b in own.values())
    file_bytes, filled, files, listed = max(min(FILE_BYTES, max(8 << 20, total // 256)), -(-total // FILES)), {}, {}, []
    for key in sorted(where):
        shard = where[key]
        if shard in changed:
            at = filled.get(shard, 0)
            listed.append((*key, shard, files.setdefault((shard, at // file_bytes), len(files))))
            filled[shard] = at + sum(blocks[key].values())
    table = spark.createDataFrame(listed, "bucket int, part int, to int, file int")  # a row for each block
    placed = rows.withColumn("bucket", _bucket(F.col("h"))).withColumn("part", _part(hot, cold)).drop("shard", "_file", "_at").join(F.broadcast(table), ["bucket", "part"])
    out = placed.repartitionById(max(1, len(files)), F.col("file")).select("h", "size", "row", F.col("to").alias("shard"))
    _write(out, path)
    kept = {root: [s for s in shards if s not in changed and s < len(weights)] for root, shards in old.roots.items()}
    return Layout({r: s for r, s in kept.items() if s} | {path: sorted(changed)}, old.schema), changed


def report(spark: SparkSession, docs: DataFrame, old_shards: int = 32, new_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, from the files written.

    The table is laid out in `old_shards` shards first, as it has none.
    """
    layout, _ = reshard(spark, write_layout(docs, scratch(spark, "old-shards"), old_shards), scratch(spark, "shards"), new_shards)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return layout.numbered(spark).select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
