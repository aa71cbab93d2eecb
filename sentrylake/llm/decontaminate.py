"""Benchmark decontamination by winnowing.

Both sides become lower-case words. A window is 10 consecutive benchmark words (an item of 1 to 9 words is one
window of its own length L). Of the k-grams in a window (k = 5, or L if shorter) the one with the smallest hash is
the window's fingerprint. A document slides the same window and keeps the same minimum, so a shared span of a
window's length always shares a fingerprint: nothing that long can be missed. Where a document's fingerprint is in
the benchmark's set, the words of the window are compared as they are, and all confirmed windows together make
the hit spans (each extends as far as consecutive windows go on matching).

The benchmark's windows are dealt into blocks by hash, each of about `block_bytes`; a window that very many items share
is several rows, by item. A worker holds one block at a time. With several blocks it takes documents in groups of
GROUP_BYTES and opens the blocks one after the other for each group, so the documents are read once and written never.

Defined results: null or empty text has no words and no hits; a benchmark row with a null item_id or no words is
ignored; repeated rows give repeated results; an empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW, K = 10, 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
MANY = 10_000  # items of a row of windows
GROUP_BYTES = 64 << 20
_MEMO = 300_000

#: A-Z to lower case; 00-2F, 3A-60 and 7B-7F separate words; bytes from 80 on belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WordHashes(dict):
    """Word to a 64-bit hash; forgets when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _MIX
        out ^= out >> np.uint64(29)
        out += hashes[i : i + n]
    return out


def window_minima(hashes: np.ndarray, length: int) -> np.ndarray:
    """The smallest k-gram hash of every window of `length` words."""
    k = min(K, length)
    grams = _grams(hashes, k)
    n = len(hashes) - length + 1
    out = grams[:n].copy()
    for i in range(1, length - k + 1):
        np.minimum(out, grams[i : i + n], out=out)
    return out


class Index:
    """One block of the benchmark: for each window length the sorted fingerprints, and windows to items."""

    def __init__(self, rows: list[tuple[int, bytes, list[int]]]):
        memo, by_length = WordHashes(), {}
        self.items = {}
        for length, window, items in rows:
            self.items[length, window] = self.items.get((length, window), ()) + tuple(items)
            by_length.setdefault(length, set()).add(int(window_minima(memo.of(window.split(b" ")), length)[0]))
        self.prints = {n: np.array(sorted(x), np.uint64) for n, x in by_length.items()}

    def find(self, words: list[bytes], hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Confirmed windows as word intervals, and the items that they belong to."""
        spans, items = [], set()
        for length, prints in self.prints.items():
            if len(words) < length:
                continue
            minima = window_minima(hashes, length)
            at = np.searchsorted(prints, minima)
            at[at == len(prints)] = 0
            for s in np.flatnonzero(prints[at] == minima).tolist():
                owners = self.items.get((length, b" ".join(words[s : s + length])))
                if owners is not None:
                    spans.append((s, s + length))
                    items.update(owners)
        return spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(length, window, items): every distinct window and the items that have it, about MANY of them in a row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["body"].to_pylist(), strict=True):
                words = fold_words(text)
                length = min(len(words), WINDOW)
                if not length:
                    continue
                found = sorted({b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)})
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.record_batch([pa.array([length] * len(part), pa.int32()), pa.array(part, pa.binary()), pa.array([item] * len(part), pa.int64())], ["length", "window", "item"])

    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("body"))
    each = written(rows.mapInArrow(cut, "length int, window binary, item long").distinct(), "item-windows")
    shared = each.groupBy("length", "window").agg(F.count("*").alias("n")).where(F.col("n") > MANY)
    dealt = each.join(shared, ["length", "window"], "left").withColumn("deal", F.pmod(F.xxhash64("item"), F.coalesce(F.floor(F.col("n") / MANY), F.lit(0)) + 1))
    return dealt.groupBy("length", "window", "deal").agg(F.collect_list("item").alias("items")).drop("deal")


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _opened(blocks: list) -> Iterator[Index]:
    """The blocks one after the other; of several only one is held."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            del b._value  # the worker's copy; it is read again from the worker's disk


def _scanner(blocks: list, group_bytes: int):
    """Adds the hits to `spans`, `items` and `words` of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for group in _grouped(batches, group_bytes if len(blocks) > 1 else 0):
            spans: list[list] = [[[] for _ in range(b.num_rows)] for b in group]
            items: list[list] = [[set() for _ in range(b.num_rows)] for b in group]
            counts = [[0] * b.num_rows for b in group]
            for block in _opened(blocks):
                for g, batch in enumerate(group):
                    for i, text in enumerate(batch["_body"]):
                        words = fold_words(text.as_py())
                        found, owners = block.find(words, memo.of(words))
                        if found:
                            spans[g][i] = _merge(spans[g][i] + found)
                            items[g][i] |= owners
                        counts[g][i] = len(words)
            for batch, own_spans, own_items, own_counts in zip(group, spans, items, counts, strict=True):
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                del cols["_body"]
                cols |= {"_spans": pa.array([[x for pair in s for x in pair] for s in own_spans], pa.list_(pa.int64())), "_items": pa.array(list(map(sorted, own_items)), pa.list_(pa.int64())), "_words": pa.array(own_counts, pa.int64())}
                yield pa.record_batch(list(cols.values()), list(cols))

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", block_bytes: int = 48 << 20) -> DataFrame:
    """The columns `keep` with _words (count), _spans (flat start, end word pairs, merged) and _items (sorted ids)."""
    spark = docs.sparkSession
    windows = written(benchmark_windows(benchmark), "windows")
    # a window costs its words, the items that share it and the index entry
    total = windows.agg(F.sum(F.length("window") + 8 * F.size("items") + 150)).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    sent = []
    for b in range(blocks):
        block = windows.where(F.pmod(F.xxhash64("length", "window", F.col("items")[0]), F.lit(blocks)) == b)
        rows = [(r.length, bytes(r.window), list(r.items_)) for r in block.withColumnRenamed("items", "items_").toLocalIterator()]
        sent.append(spark.sparkContext.broadcast(Index(rows)))
        del rows
    empty = F.array().cast("array<bigint>")
    out = docs.select(*keep, F.col(text_col).cast("binary").alias("_body"))
    schema = out.drop("_body").withColumns({"_spans": empty, "_items": empty, "_words": F.lit(0).cast("long")}).schema
    return out.mapInArrow(_scanner(sent, GROUP_BYTES), schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, ["doc_id"])
    n_hit = F.expr("aggregate(sequence(0, greatest(size(_spans) div 2 - 1, 0)), 0L, (a, i) -> a + coalesce(get(_spans, 2 * i + 1) - get(_spans, 2 * i), 0L))")
    listed = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any word inside a benchmark window, columns and rows as they were."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # any column name may clash with ours
    found = find_contamination(docs.toDF(*plain), benchmark, plain, text_col=plain[names.index("text")])
    return found.where(F.size("_spans") == 0).select(*(F.col(p).alias(n) for p, n in zip(plain, names, strict=True)))


def digest_of_items(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
