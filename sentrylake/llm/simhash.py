"""SimHash near-duplicates found with pivot distance tables.

A fingerprint is 64 bits over 3-word shingles. Links join fingerprints at 2 or fewer differing bits.

Copies collapse first: only distinct fingerprints are compared. For a pivot p, |d(a,p) - d(b,p)| <= d(a,b), on the
whole word or on any set of its bits. So:
 1. Candidates. The 64 bits are cut into 3 bands; two differing bits leave one band untouched. The other two bands
    are cut into 3 parts; again one part is untouched. For each of the 9 regions (band plus part, 35 to 37 bits) a
    table holds the distances to many pivots within the region; a linked pair has all coordinates equal in at
    least one region (coordinate difference 0), so an equi-join on the row of distances loses no link.
 2. Discard. Distances to 16 more pivots on all 64 bits: a maximum coordinate difference over 2 discards the pair.
 3. Verify. The bits of the survivors are counted.
Within a region's bucket a fingerprint meets only fingerprints that share 35 or more bits, all of them distinct.

Defined results: null or empty text has fingerprint 0 and is linked like any other; repeated rows come back
repeatedly; a null doc_id gets the smallest known doc_id of its component, or null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import word_runs, words_of, written
from .graph import components

RADIUS = 2
BANDS = ((0, 21), (21, 42), (42, 64))
REGION_PIVOTS, FULL_PIVOTS = 24, 16
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_LONG = 1 << 20


def _pivots(n: int, seed: int) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, n)]


def regions() -> list[int]:
    """Masks of the 9 regions, as signed longs."""
    out = []
    for b, (lo, hi) in enumerate(BANDS):
        rest = [i for c, (x, y) in enumerate(BANDS) if c != b for i in range(x, y)]
        for part in range(3):
            bits = [*range(lo, hi), *rest[part * len(rest) // 3 : (part + 1) * len(rest) // 3]]
            mask = sum(1 << i for i in bits)
            out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def _ones(shingles: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(_hash, shingles), np.uint64, len(shingles))
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    if not text:
        return 0
    ones, total = np.zeros(64, np.int64), 0
    if len(text) <= _LONG:
        w = words_of(text)
        shingles = list(map(b" ".join, zip(w, w[1:], w[2:], strict=False))) if len(w) > 2 else [b" ".join(w)] * bool(w)
        if shingles:
            ones, total = _ones(shingles), len(shingles)
    else:
        tail: list[bytes] = []
        for run in word_runs(text):
            w = tail + run
            shingles = list(map(b" ".join, zip(w, w[1:], w[2:], strict=False)))
            if shingles:
                ones, total = ones + _ones(shingles), total + len(shingles)
            tail = w[-2:]
        if not total and tail:
            ones, total = _ones([b" ".join(tail)]), 1
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0]) if total else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch["body"]]
            yield pa.record_batch([batch["doc_id"], pa.array(prints, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _distance(column, pivot: int, mask: int = -1):
    return F.bit_count((column.bitwiseXOR(F.lit(pivot))).bitwiseAND(F.lit(mask)))


def links(prints: DataFrame) -> DataFrame:
    """(u, v): pairs of distinct fingerprints within RADIUS bits, u > v. prints: distinct column fp."""
    fp = F.col("fp")
    near = _pivots(REGION_PIVOTS, 1)
    keys = F.array(*(F.struct(F.lit(i).alias("region"), F.xxhash64(*(_distance(fp, p, mask) for p in near)).alias("row")) for i, mask in enumerate(regions())))
    # 16 distances of 0 to 64, eight bits each, in two longs
    packed = []
    for half in range(2):
        own = _pivots(FULL_PIVOTS, 2)[half * 8 : half * 8 + 8]
        word = F.lit(0).cast("long")
        for i, p in enumerate(own):
            word = word.bitwiseOR(F.shiftleft(_distance(fp, p).cast("long"), 8 * i))
        packed.append(word.alias(f"p{half}"))
    table = prints.select(fp, *packed, F.explode(keys).alias("k")).select("fp", "p0", "p1", "k.region", "k.row")
    a, b = table.alias("a"), table.alias("b")
    unit = lambda side, half, i: F.shiftrightunsigned(F.col(f"{side}.p{half}"), 8 * i).bitwiseAND(F.lit(255))
    widest = F.greatest(*(F.abs(unit("a", h, i) - unit("b", h, i)) for h in range(2) for i in range(8)))
    on = (F.col("a.region") == F.col("b.region")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.fp") > F.col("b.fp")) & (widest <= RADIUS)
    pairs = a.join(b, on).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    rows = written(fingerprints(docs), "prints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(prints.select("fp")))
    # distinct fingerprints of a component: their smallest doc_id, for those that have any link
    named = prints.join(roots, prints.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    label = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(named.join(label, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def proposed(prints: DataFrame) -> DataFrame:
    """(u, v): pairs of sets within RADIUS bits, by the links above. prints: distinct (sid, fp).

    Of the sets with one fingerprint each meets the smallest, and of linked fingerprints the smallest sets meet.
    """
    first = written(prints.groupBy("fp").agg(F.min("sid").alias("least")), "firsts")
    same = prints.join(first.hint("merge"), "fp").select(F.col("sid").alias("u"), F.col("least").alias("v"))
    a, b = (first.select(F.col("fp").alias(fp), F.col("least").alias(sid)).hint("merge") for fp, sid in (("u", "x"), ("v", "y")))
    near = links(first.select("fp")).join(a, "u").join(b, "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return same.unionByName(near).where("u <> v").distinct()


def keep_one(docs: DataFrame, words: int = jaccard.WORDS, least: float = jaccard.LEAST) -> DataFrame:
    """One document of each component of near copies stays: the one with the smallest doc_id, its first row if it repeats.

    Near copies share at least `least` of their shingles of `words` words, the contract of near-duplicate stages. Texts
    within 2 bits by the fingerprints and pivot tables above are proposed, then those of MinHash bands, as most near
    copies differ in more bits; whole sets decide on both. Documents without a doc_id stay, as no row can be named for them.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # any column name may clash with ours
    rows = docs.toDF(*plain).withColumn("h", F.xxhash64(plain[names.index("text")]))
    key = plain[names.index("doc_id")]
    texts = rows.select(F.col(key).cast("long").alias("doc_id"), "h", F.col(plain[names.index("text")]).cast("binary").alias("body"))
    kept = written(jaccard.smallest_rows(texts, fingerprint, proposed, words, least).withColumnRenamed("doc_id", key), "kept")
    once, repeated = kept.where("rows = 1").select(key, "h"), kept.where("rows > 1").select(key, "h")
    rest = rows.join(repeated, [key, "h"], "left_semi").dropDuplicates([key, "h"])
    # as large as the table: never broadcast
    out = rows.join(once.hint("merge"), [key, "h"], "left_semi").unionByName(rest).unionByName(rows.where(F.col(key).isNull()))
    return out.select(*(F.col(p).alias(n) for p, n in zip(plain, names, strict=True)))
