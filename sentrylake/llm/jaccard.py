"""Near copies by Jaccard similarity of word shingles: SimHash and MinHash bands propose pairs, whole shingle sets decide.

SimHash fingerprints and their pivot distance tables (simhash.py) propose first. Alone they can't serve this contract:
pairs at a similarity of 0.8 over 5 words differ in up to 17 of 64 bits on the check tables, and 17 differing bits
leave no region wide enough for a join key. MinHash bands are the way for what lies beyond SimHash's radius.

Equal shingle sets collapse first. BANDS keys of ROWS minima each are the join keys; a pair at similarity s shares none
with probability (1 - s^ROWS)^BANDS: 3e-6 at 0.8, less above. Then:
 1. The pairs that SimHash proposes are verified, and every member of a bucket meets the bucket's smallest and largest
    member; components are formed.
 2. In buckets that still hold several components all pairs across components meet. Pairs inside a component are
    left out, as they can't change it. Texts of a large group that are alike but not near copies still are compared
    each with each inside the join.
Every pair is verified on its whole sets; no bucket is capped.

Defined results: texts under `words` words are one shingle; null, empty and blank texts are equal to one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import word_runs, written
from .graph import components

WORDS, LEAST, BANDS, ROWS = 5, 0.8, 32, 5
_hash = partial(xxhash.xxh64_intdigest, seed=42)
_rng = np.random.default_rng(53)
_MIX = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words."""
    parts, tail = [np.empty(0, np.uint64)], []
    for run in word_runs(text or b""):
        w = tail + run
        n = len(w) - words + 1
        if n > 0:
            parts.append(np.unique(np.fromiter(map(_hash, map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))), np.uint64, n)))
        tail = w[-(words - 1) :] if words > 1 else []
        short = w
    if len(parts) == 1 and text and short:
        parts.append(np.array([_hash(b" ".join(short))], np.uint64))
    return np.unique(np.concatenate(parts))


def _bands(found: np.ndarray) -> list[int]:
    """Keys of the bands, as signed longs."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 512):
        least = np.minimum(least, ((found[i : i + 512, None] ^ _MIX) * _ODD).min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _name(found: np.ndarray) -> int:
    return int(np.array([_hash(found.tobytes())], np.uint64).view(np.int64)[0])


def _short(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few sets at once."""
    return (batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))


def sketches(rows: DataFrame, mark: Callable[[bytes | None], int], words: int = WORDS) -> DataFrame:
    """rows: (doc_id, h, body). (doc_id, h, fp, sid, n, bands): the text's mark, its shingle set's name and size, and its
    band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short(batches):
            texts = batch["body"].to_pylist()
            sets = [shingles(t, words) for t in texts]
            made = [pa.array(map(mark, texts), pa.int64()), pa.array(map(_name, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(_bands, sets), pa.list_(pa.int64()))]
            yield pa.record_batch([batch["doc_id"], batch["h"], *made], ["doc_id", "h", "fp", "sid", "n", "bands"])

    return rows.mapInArrow(run, "doc_id long, h long, fp long, sid long, n long, bands array<long>")


def _similarity(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs (u, v) those whose sets are at least so similar."""
    a, b = (sets.select(F.col("sid").alias(c), F.col("s").alias(f"s{c}")).hint("merge") for c in "uv")
    return pairs.join(a, "u").join(b, "v").where(_similarity("su", "sv") >= least).select("u", "v")


def smallest_rows(docs: DataFrame, mark: Callable[[bytes | None], int], propose: Callable[[DataFrame], DataFrame], words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs: (doc_id, h, body), h a hash of the row's text. (doc_id, h, rows): the smallest row of each component of
    near copies and how often it stands in the table; components without any doc_id have none.

    mark: the fingerprint of a text. propose: from the distinct (sid, fp) the pairs (u, v) of sets to be verified.
    """
    rows = written(sketches(docs, mark, words), "sketches")
    each = rows.groupBy("sid", "doc_id", "h").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h", "rows")).alias("first")
    sets = written(each.groupBy("sid").agg(first), "sets")
    keys = rows.groupBy("sid").agg(F.any_value("n").alias("n"), F.any_value("bands").alias("bands")).select("sid", "n", F.explode("bands").alias("key"))
    keys = written(keys, "keys")
    buckets = keys.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi")
    members = written(keys.join(buckets.hint("merge"), "key"), "members")  # a join, as a large bucket can be split in it

    proposed = written(propose(rows.select("sid", "fp").distinct()), "proposed")
    asked = members.select("sid").unionByName(proposed.select(F.explode(F.array("u", "v")).alias("sid"))).distinct().join(sets, "sid").select(F.col("first.h").alias("h"), F.col("first.doc_id").alias("d"))
    texts = docs.join(asked.hint("merge"), (docs.h == asked.h) & docs.doc_id.eqNullSafe(asked.d), "left_semi").select("body")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short(batches):
            found = [shingles(t.as_py(), words) for t in batch["body"]]
            yield pa.record_batch([pa.array(map(_name, found), pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["sid", "s"])

    whole = written(texts.mapInArrow(again, "sid long, s array<long>").dropDuplicates(["sid"]), "whole")
    ends = members.where("sid <> lo").select(F.col("sid").alias("u"), F.col("lo").alias("v"))
    ends = ends.unionByName(members.where("sid <> hi").select(F.col("hi").alias("u"), F.col("sid").alias("v"))).unionByName(proposed).distinct()
    links = written(_verified(ends, whole, least), "links")
    now = components(links)
    inner = members.where("sid <> lo AND sid <> hi")  # both ends have met all others of their bucket
    rooted = written(inner.join(now, inner.sid == now.u, "left").select("key", "sid", "n", F.coalesce("root", "sid").alias("root")), "rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = written(rooted.join(several.hint("merge"), "key", "left_semi").join(whole.hint("merge"), "sid"), "open")
    a, b = rest.alias("a"), rest.alias("b")
    alike = (F.col("a.n") >= least * F.col("b.n")) & (F.col("b.n") >= least * F.col("a.n"))
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.sid") > F.col("b.sid")) & (F.col("a.root") != F.col("b.root"))
    met = a.join(b.hint("merge"), apart & alike & (_similarity("a.s", "b.s") >= least))  # verified inside the join: no other pair becomes a row
    across = met.select(F.col("a.sid").alias("u"), F.col("b.sid").alias("v")).distinct()
    roots = components(written(links.unionByName(across), "links"))
    of = sets.join(roots, sets.sid == roots.u, "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first"))
    return of.where("NOT first.unknown").select("first.doc_id", "first.h", "first.rows")
