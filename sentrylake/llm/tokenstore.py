"""Token ids in a binary file format with a minimal perfect hash index.

A store is a folder with two Parquet tables, so that any file system of Spark's will do.

shards: a row is a shard of about SHARD_BYTES of whole documents; row groups are small and its columns `part` and `seq`
have statistics, so a reader that asks for a few shards reads about those.
  part, seq      shards in ascending order of doc_id; one input partition gives one or more
  n_docs, n_tokens, first_id, last_id
  width          2 or 4: bytes of an id in `payload`, as the vocabulary needs
  keys           the doc_ids in order, 8 bytes each, then a bit for each that is null
  index          a hash index of the shard's documents: offset and number of ids of each
  payload        raw little-endian ids, documents one after the other, each closed by the end id

index: a row is a bucket of all documents of the store by a hash of the key, with a hash index that gives part, seq,
offset and number of ids. Some BUCKET keys make a bucket, so one key needs one bucket and one shard.

A hash index maps a key (doc_id and its occurrence, within the shard or within the store) to a slot in constant
expected time. Levels of bit arrays hold the keys that are alone at their bit; colliding keys go to the next level, and
the rank of a key's bit among all set bits is its slot, so n keys have exactly the slots 0 to n-1. A slot holds a 32-bit
fingerprint of the key, which tells absent keys, and the values.
  u32 n, u32 levels, then for each level u32 bits and the bit array in whole bytes; u32 fingerprint[n],
  then u64 value[n] for each kind of value

Defined results: null or empty text is the end id alone; a null doc_id sorts first; a repeated doc_id keeps all its
rows, in the order of their texts' hashes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import encoder

SHARD_BYTES, BUCKET = 1 << 20, 1 << 16
RUN = 4_096  # occurrences of a doc_id that share a bucket
GAMMA = 1.5
SCHEMA = "part int, seq int, n_docs long, n_tokens long, first_id long, last_id long, width int, keys binary, index binary, payload binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each key: doc_id, whether it is null, its occurrence in the shard."""
    return _mix(_mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ _mix(nth.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64) + np.uint64(1)))


def occurrences(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """How many equal keys come before each; equal keys are neighbours."""
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.arange(n) - start


class HashIndex:
    """Levels of bits; slot = rank of a key's bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            total = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            self.ranks.append(before + total[:-1])
            before += int(total[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> HashIndex:
        """keys: distinct 64-bit hashes."""
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) > 200:
                raise ValueError("two keys have the same 64-bit hash")
            size = max(8, int(len(keys) * GAMMA) // 8 * 8 + 8)
            at = cls._at(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(keys + np.uint64(level + 1) * np.uint64(0xD6E8FEB86659FD93 & 0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 if it certainly is none of the index's."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = self._at(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out


def dump_index(keys: np.ndarray, *values: np.ndarray) -> bytes:
    index = HashIndex.build(keys)
    slot, n = index.slots(keys), len(keys)
    prints = np.zeros(n, "<u4")
    prints[slot] = (keys >> np.uint64(32)).astype(np.uint32)
    parts = [struct.pack("<II", n, len(index.levels))]
    parts += [struct.pack("<I", len(b)) + np.packbits(b, bitorder="little").tobytes() for b in index.levels]
    parts.append(prints.tobytes())
    for v in values:
        own = np.zeros(n, "<u8")
        own[slot] = v
        parts.append(own.tobytes())
    return b"".join(parts)


class Table:
    """A hash index, opened."""

    def __init__(self, index: bytes, values: int = 2):
        self.n, levels = struct.unpack_from("<II", index)
        at, bits = 8, []
        for _ in range(levels):
            (size,) = struct.unpack_from("<I", index, at)
            bits.append(np.unpackbits(np.frombuffer(index, np.uint8, (size + 7) // 8, at + 4), bitorder="little")[:size].astype(bool))
            at += 4 + (size + 7) // 8
        self.hash = HashIndex(bits)
        self.prints = np.frombuffer(index, "<u4", self.n, at)
        self.values = [np.frombuffer(index, "<u8", self.n, at + (4 + 8 * i) * self.n).astype(np.int64) for i in range(values)]

    def find(self, ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where the stored fingerprint says that the key is absent."""
        keys = hashed(ids, null, nth)
        slot = self.hash.slots(keys)
        good = (slot >= 0) & (self.prints[slot] == (keys >> np.uint64(32)).astype(np.uint32)) if self.n else np.zeros(len(keys), bool)
        return np.where(good, slot, -1)


class Shard(Table):
    """One shard, opened: access to the ids of a key."""

    def __init__(self, index: bytes, payload: bytes, width: int):
        super().__init__(index)
        self.offset, self.count = self.values
        self.ids = np.frombuffer(payload, f"<u{width}")

    def get(self, slot: int) -> np.ndarray:
        return self.ids[self.offset[slot] : self.offset[slot] + self.count[slot]].astype("<u4")


def _keys(ids: np.ndarray, null: np.ndarray) -> bytes:
    return ids.astype("<i8").tobytes() + np.packbits(null, bitorder="little").tobytes()


def read_keys(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(data, "<i8", n)
    return ids, np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, 8 * n), bitorder="little")[:n].astype(bool)


def write_store(docs: DataFrame, path: str, tokenizer: str, end: int = 2, words: bool = True, shard_bytes: int = SHARD_BYTES, vocabulary: int = 1 << 16) -> None:
    """Encode every whole text and write the store to `path`."""
    width = 2 if max(vocabulary - 1, end) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq = encoder(tokenizer, end, words), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        parts: list[bytes] = []
        counts: list[int] = []
        held = 0

        def shard() -> pa.RecordBatch:
            null = np.array([x is None for x in ids], bool)
            key, n = np.array([x or 0 for x in ids], np.int64), np.array(counts, np.int64)
            offset = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
            known = key[~null]
            row = (part, seq, len(ids), int(n.sum()), int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None, width, _keys(key, null), dump_index(hashed(key, null, occurrences(key, null)), offset, n), b"".join(parts))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["body"], strict=True):
                found = code.ids(text.as_py())
                n = len(found) // 4
                if width == 2:
                    wide = np.frombuffer(found, "<u4")
                    if n and int(wide.max()) >= 1 << 16:
                        raise ValueError("an id needs more than two bytes: pass the tokenizer's vocabulary")
                    found = wide.astype("<u2").tobytes()
                ids.append(doc)
                parts.append(found)
                counts.append(n)
                held += len(found)
                if held >= shard_bytes:
                    yield shard()
                    ids, parts, counts, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    # equal doc_ids are dealt by their text too, so that one hot id does not fill one partition
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("body")).sortWithinPartitions("doc_id", F.xxhash64("body"))
    ranged.mapInArrow(run, SCHEMA).write.option("compression", "none").option("parquet.block.size", 8 * shard_bytes).option("parquet.page.size", shard_bytes).parquet(f"{path}/shards")
    write_index(docs.sparkSession, path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/shards")


def write_index(spark: SparkSession, path: str) -> None:
    """The index of all documents, from the shards' keys and indexes; no payload is read."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, n = (batch[c][i].as_py() for c in ("part", "seq", "n_docs"))
                ids, null = read_keys(batch["keys"][i].as_py(), n)
                table, nth = Table(batch["index"][i].as_py()), occurrences(ids, null)
                slot = table.find(ids, null, nth)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(null), pa.array(nth, pa.int64()), pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, seq), pa.int32()), *(pa.array(v[slot]) for v in table.values)], ["id", "none", "nth", "part", "seq", "at", "n"])

    store = open_store(spark, path)
    rows = store.select("part", "seq", "n_docs", "keys", "index").mapInArrow(listed, "id long, none boolean, nth long, part int, seq int, at long, n long")
    # occurrences in earlier shards, for the few doc_ids that lie in several
    own = ["id", "none"]
    each = rows.groupBy(*own, "part", "seq").agg(F.count("*").alias("m"))
    several = each.groupBy(*own).agg(F.count("*").alias("shards")).where("shards > 1").select(*own)
    order = Window.partitionBy(*own).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = each.join(several, own, "left_semi").select(*own, "part", "seq", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("before"))
    numbered = rows.join(earlier, [*own, "part", "seq"], "left").withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0)))
    docs = store.agg(F.sum("n_docs")).first()[0] or 0
    buckets = int(docs) // BUCKET + 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def row() -> pa.RecordBatch:
            cols = {c: np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in held]) for c in ("id", "none", "nth", "part", "seq", "at", "n")}
            made = dump_index(hashed(cols["id"], cols["none"], cols["nth"]), *(cols[c] for c in ("part", "seq", "at", "n")))
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([buckets], pa.int32()), pa.array([made], pa.binary())], ["bucket", "buckets", "table"])

        for batch in batches:
            of = batch["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if of[a] != now and held:
                        yield row()
                        held = []
                    now = int(of[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield row()

    bucket = F.pmod(F.xxhash64("id", "none", F.floor(F.col("nth") / RUN).cast("long")), F.lit(buckets)).cast("int")
    dealt = numbered.select(bucket.alias("bucket"), "id", "none", "nth", "part", "seq", "at", "n").repartition("bucket").sortWithinPartitions("bucket")
    dealt.mapInArrow(build, "bucket int, buckets int, table binary").write.option("compression", "none").option("parquet.block.size", 8 << 20).parquet(f"{path}/index")


def shard_starts(store: DataFrame) -> DataFrame:
    """(part, seq, base): ids in all shards before. Reads no payload; one row for each partition meets in one task."""
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    return store.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("within")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, by keyed access to the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                shard = Shard(row["index"], row["payload"], row["width"])
                ids, null = read_keys(row["keys"], row["n_docs"])
                slot = shard.find(ids, null, occurrences(ids, null))
                if (slot < 0).any():
                    raise ValueError(f"shard {row['part']}-{row['seq']}: a stored key is not in the index")
                crc = [zlib.crc32(shard.get(s).tobytes()) for s in slot.tolist()]
                n = len(ids)
                yield pa.record_batch([pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(ids, pa.int64(), mask=null), pa.array(shard.offset[slot]), pa.array(shard.count[slot]), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    store = open_store(spark, path)
    found = store.select("part", "seq", "n_docs", "width", "keys", "index", "payload").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(store), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def locate(spark: SparkSession, path: str, doc_ids: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, part, seq, offset, ids) of every occurrence of the keys: one bucket of the index is read for each."""
    index = spark.read.schema("bucket int, buckets int, table binary").parquet(f"{path}/index")
    first = index.select("buckets").first()
    out, run, open_ = [], 0, sorted(set(doc_ids))
    while first and open_:
        asked = spark.createDataFrame([(x,) for x in open_], "id long").select("id", F.pmod(F.xxhash64("id", F.lit(False), F.lit(run).cast("long")), F.lit(first["buckets"])).cast("int").alias("bucket"))
        by_bucket: dict[int, list[int]] = {}
        for r in asked.collect():
            by_bucket.setdefault(r["bucket"], []).append(r["id"])

        def look(batches: Iterator[pa.RecordBatch], by_bucket=by_bucket, run=run) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    table, left = Table(batch["table"][i].as_py(), 4), np.array(by_bucket[batch["bucket"][i].as_py()], np.int64)
                    for nth in range(run * RUN, (run + 1) * RUN):
                        slot = table.find(left, np.zeros(len(left), bool), np.full(len(left), nth))
                        left, slot = left[slot >= 0], slot[slot >= 0]
                        if not len(left):
                            break
                        yield pa.record_batch([pa.array(left), pa.array(np.full(len(left), nth), pa.int64()), *(pa.array(v[slot]) for v in table.values)], ["id", "nth", "part", "seq", "at", "n"])

        found = index.where(F.col("bucket").isin(list(by_bucket))).select("bucket", "table").mapInArrow(look, "id long, nth long, part long, seq long, at long, n long").collect()
        out += [(r["id"], r["part"], r["seq"], r["at"], r["n"]) for r in found]
        run += 1
        open_ = sorted({r["id"] for r in found if r["nth"] == run * RUN - 1})
    return out


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some keys; only the shards that hold them are read."""
    places: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for doc, part, seq, at, n in locate(spark, path, doc_ids):
        places.setdefault((part, seq), []).append((doc, at, n))
    near = F.lit(False)
    for part in sorted({p for p, _ in places}):
        near = near | ((F.col("part") == part) & F.col("seq").isin([s for p, s in places if p == part]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch["payload"][i].as_buffer(), f"<u{batch['width'][i].as_py()}")
                for doc, at, n in places[batch["part"][i].as_py(), batch["seq"][i].as_py()]:
                    yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([ids[at : at + n].tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return open_store(spark, path).where(near).select("part", "seq", "width", "payload").mapInArrow(run, "doc_id long, ids array<bigint>")
