"""Language-model scores of whole texts.

Two scores of a text's lower-case words and one end:
 base   unigram with additive smoothing over words, from exact counts over all training documents;
 score  the causal self-attention model of attention.py over subword ids: byte-pair merges of a public vocabulary
        within each word and the space before it.

Passes:
 1. All texts, whole, become groups of documents that are written down: their ids, the hashes (95 bits) of the group's
    words, and which word stands where. Of the training documents, words and ids are counted: each task's counts
    are dealt to BUCKETS by key as blocks of arrays, and those of a bucket are added up together.
 2. Over the training documents' ids, all of them: the pair table, of a fixed size, which gives the classes and embeddings.
 3. Training of the attention in ROUNDS rounds: the tasks' parameters after gradient steps through their share are
    averaged. Every window of every training document teaches, once.
 4. Over all groups: each document is scored whole, in overlapping windows; no text is read or split again. Counts of at
    most FREQUENT words are broadcast; every other word is looked up by a join, so no word is dropped and no broadcast grows.

Defined results: null and empty texts are one end; without training documents every count is 0; repeated rows give
repeated results; a null doc_id belongs to the training documents.
"""

from __future__ import annotations

import base64
import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import SCORED, Adam, Attention, Layout, previous, training_windows, windows
from .common import remove, written
from .toxicity import remainder

ROUNDS, RATE = 4, 0.004  # of training
BATCH, BLOCK = 64, 8_192  # windows of a step, and windows that are shuffled together
FREQUENT = 400_000
READ, SCORE = 500_000, 250_000  # words in a worker's memo: while it reads, and with a model beside it
PIECE = 1 << 18  # ids of a long document, or of a group, that are taught or scored at once
GROUP = 1_200_000  # bytes of the documents of a group, if it has several
WORD, ID, END, IDS, HELD = range(5)  # IDS and HELD: groups of training and of held-out documents
BUCKETS = 256  # of counts: a task that adds up holds its share of all blocks, and what it makes of one bucket
_COUNT = "kind byte, a long, b int, n long, ids binary"
_GROUP = "doc_ids array<long>, sizes binary, numbers binary, hashes binary"


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """95 bits of a word's XXH3, as a long and a non-negative int."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2)
    return raw[:, 0].astype(np.int64), (raw[:, 1] >> np.uint64(33)).astype(np.int32)


def _put(buffer: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """The buffer with `more` from place n on; doubled when full."""
    if n + len(more) > len(buffer):
        buffer = np.concatenate([buffer[:n], np.empty(max(len(more), len(buffer)), buffer.dtype)])
    buffer[n : n + len(more)] = more
    return buffer


class Words(dict):
    """Words to numbers in order of appearance, and by number their ids, hashes and logarithms. None, number 0, is the end.

    One lookup for each occurrence; all else is gathered from arrays.
    """

    def __init__(self, encode, end: int, keep: int, logs=None, end_log: float = 0.0):
        super().__init__()
        self.encode, self.keep, self.logs = encode, keep, logs
        self.new: list[bytes] = []
        self.size = np.ones(1, np.int64)  # ids of each word
        self.start = np.zeros(1, np.int64)
        self.flat, self.used = np.array([end], np.int32), 1
        self.a, self.b, self.log = np.zeros(1, np.int64), np.zeros(1, np.int32), np.array([end_log])
        self[None] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def numbers(self, docs: list[list]) -> np.ndarray:
        """Numbers of all words of documents, each closed by None."""
        out = np.fromiter(map(self.__getitem__, chain.from_iterable(docs)), np.int64, sum(map(len, docs)))
        if self.new:
            flat, size = self.encode(self.new)
            a, b = _hashes(self.new)
            n = len(self) - len(size)
            self.start = _put(self.start, n, self.used + np.cumsum(size) - size)
            self.size, self.a, self.b = _put(self.size, n, size), _put(self.a, n, a), _put(self.b, n, b)
            self.flat = _put(self.flat, self.used, flat)
            self.used += len(flat)
            if self.logs is not None:
                self.log = _put(self.log, n, self.logs(a, b))
            self.new = []
        return out

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.start[numbers] - before, size) + np.arange(int(size.sum()))]

    def forget(self) -> None:
        """Keep the older half of a full memo: it holds the common words."""
        n = self.keep // 2
        kept = list(islice(self.items(), n))
        self.clear()
        self.update(kept)
        self.used = int(self.start[n - 1] + self.size[n - 1])


def _encode(path: str):
    """Byte-pair merges of a public vocabulary within each of several words: (ids of all, how many each has)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    width[list(ranks.values())] = list(map(len, ranks))
    code = tiktoken.Encoding("words", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        try:
            text = (b" " + b" ".join(words)).decode()
        except UnicodeDecodeError:
            found = [code._encode_single_piece(b" " + w) for w in words]
            size = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size
        flat = np.array(code._core_bpe.encode_ordinary(text), np.int32)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # in bytes
        return flat, np.diff(np.searchsorted(np.cumsum(width[flat]), ends) + 1, prepend=0)

    return encode


_OPEN: dict[str, Words] = {}


def _words(run: str, path: str, end: int, keep: int) -> Words:
    """One table for each Python worker and run of the operator, so that it outlives a task."""
    if run not in _OPEN:
        _OPEN.clear()
        _OPEN[run] = Words(_encode(path), end, keep)
    return _OPEN[run]


def _let_go() -> None:
    """Once the texts are read: a worker's words, and the memory that Arrow keeps for later."""
    _OPEN.clear()
    pa.default_memory_pool().release_unused()


def _groups(texts: pa.Array) -> Iterator[slice]:
    """Places of consecutive texts of about GROUP bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP, "right")))
        yield slice(at, stop)
        at = stop


def _numbered(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different lower-case words of texts; of each place the number of its word from 1, 0 for an end; places of each text."""
    # A-Z only; words are runs of anything but x20 and x09-x0D; bytes that aren't UTF-8 stay
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())))
    flat = parts.flatten().view(pa.binary())
    lengths = np.diff(parts.offsets.to_numpy()).astype(np.int64)
    some = pc.binary_length(flat).to_numpy() > 0
    if not some.all():  # white space at either end
        before = np.concatenate([[0], np.cumsum(some)])
        stop = np.cumsum(lengths)
        lengths = before[stop] - before[stop - lengths]
        flat = flat.filter(pa.array(some))
    coded = flat.dictionary_encode()
    out = np.zeros(len(flat) + len(lengths), np.int32)
    lengths += 1
    word = np.ones(len(out), bool)
    word[np.cumsum(lengths) - 1] = False
    out[word] = coded.indices.to_numpy()
    out[word] += 1
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), out, lengths


def _blocks(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Counts n of keys (a, b): the buckets that have any, how many, and the arrays of each in one block."""
    a = a.astype(np.int64)
    bucket = (a & (BUCKETS - 1)).astype(np.int16)
    order, sizes = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=BUCKETS)
    columns, stops, at = (a[order], n[order].astype(np.int64), b[order].astype(np.int32)), np.cumsum(sizes), np.flatnonzero(sizes)
    return at, sizes[at], [b"".join(x[stops[i] - sizes[i] : stops[i]].tobytes() for x in columns) for i in at.tolist()]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (kind, a, ids), all there are of each bucket, to (kind, a, b, n): a bucket's keys and their counts added up."""
    held: dict[tuple[int, int], list[pa.Buffer]] = {}
    for batch in batches:
        for kind, bucket, block in zip(batch["kind"].to_pylist(), batch["a"].to_pylist(), batch["ids"], strict=True):
            held.setdefault((kind, bucket), []).append(block.as_buffer())
    for kind, bucket in list(held):
        parts = [(x, x.size // 20) for x in held.pop((kind, bucket))]
        a, n, b = (np.concatenate([np.frombuffer(x, t, m, k * m) for x, m in parts]) for t, k in ((np.int64, 0), (np.int64, 8), (np.int32, 16)))
        order = np.argsort(a)
        same = np.diff(a[order]) == 0
        if (np.diff(b[order])[same] != 0).any():  # the same long in two keys
            order = np.lexsort((b, a))
            same = np.diff(a[order]) == 0
        first = np.flatnonzero(np.concatenate([[True], ~same | (np.diff(b[order]) != 0)]))
        own = order[first]
        yield kind, a[own], b[own], np.add.reduceat(n[order], first)


def read_corpus(docs: DataFrame, path: str, end: int, vocabulary: int) -> DataFrame:
    """One pass over the texts of docs (body; doc_id and held if it has them): (kind, a, b, n, ids, and of a group more).

    Counts of word hashes, of ids and of ends in each task, without the held-out documents, in blocks of many: a their
    bucket, n how many, ids the keys and counts (summed() adds them up); and groups of documents
    with their ids, two or four bytes each: a the id before them, b the round of training that they belong to, sizes
    the words (ends with them) and the ids of each document, numbers and hashes as _numbered has them.
    """
    this_run, kind_of = uuid.uuid4().hex, np.uint16 if vocabulary < 1 << 16 else np.uint32
    more = {"doc_ids": pa.list_(pa.int64()), "sizes": pa.binary(), "numbers": pa.binary(), "hashes": pa.binary()}
    names = ["kind", "a", "b", "n", "ids", *more]

    def rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at, sizes, blocks = _blocks(a, b, n)
        none = [pa.nulls(len(at), t) for t in more.values()]
        return pa.record_batch([pa.array(np.full(len(at), kind, np.int8)), pa.array(at), pa.array(np.zeros(len(at), np.int32)), pa.array(sizes), pa.array(blocks, pa.binary()), *none], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(this_run, path, end, READ)
        seen = np.zeros(len(words), np.int64)
        ids, n_docs = np.zeros(vocabulary, np.int64), 0

        def hand_on() -> pa.RecordBatch:
            at = np.flatnonzero(seen[1:]) + 1
            return rows(WORD, words.a[at], words.b[at], seen[at])

        for batch, held in ((b.filter(b["held"] if h else pc.invert(b["held"])), h) for b in batches for h in (False, True)):
            for own in _groups(batch["body"]):
                doc_ids, texts = (batch[c].slice(own.start, own.stop - own.start) for c in ("doc_id", "body"))
                distinct, places, lengths = _numbered(texts)
                known = words.numbers([distinct])
                if len(seen) < len(words):
                    seen = np.concatenate([seen, np.zeros(len(words) - len(seen) + 10_000, np.int64)])
                numbers = np.concatenate([[0], known])[places]
                flat = words.ids(numbers)
                if not held:
                    seen[known] += np.bincount(places, minlength=len(known) + 1)[1:]
                    ids += np.bincount(flat, minlength=vocabulary)
                    n_docs += len(texts)
                raw = flat.astype(kind_of).tobytes()
                sizes = np.concatenate([lengths, np.add.reduceat(words.size[numbers], np.cumsum(lengths) - lengths)])
                short = places.astype(np.uint16) if len(known) < 1 << 16 else places
                place = [pa.array([x], t) for x, t in ((HELD if held else IDS, pa.int8()), (end, pa.int64()), (zlib.crc32(raw) % ROUNDS, pa.int32()), (len(flat), pa.int64()))]
                binary = [pa.array([x], pa.binary()) for x in (raw, sizes.tobytes(), short.tobytes(), words.a[known].tobytes() + words.b[known].tobytes())]
                yield pa.record_batch([*place, binary[0], pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), doc_ids), *binary[1:]], names)
                if len(words) > words.keep:
                    yield hand_on()
                    words.forget()
                    seen = np.zeros(len(words), np.int64)
        yield hand_on()
        at = np.flatnonzero(ids)
        yield rows(ID, at, np.zeros(len(at)), ids[at])
        yield rows(END, np.zeros(1, np.int64), np.zeros(1), np.array([n_docs]))

    absent = {c: x for c, x in (("doc_id", F.lit(None).cast("long")), ("held", F.lit(False))) if c not in docs.columns}
    return docs.withColumns(absent).select("doc_id", "body", "held").mapInArrow(read, f"{_COUNT}, {_GROUP}")


def summed(corpus: DataFrame) -> DataFrame:
    """kind, a, b, n: the counts of all tasks added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go()
        for kind, *columns in _added(batches):
            for i in range(0, len(columns[0]), 1 << 18):
                a, b, n = (x[i : i + (1 << 18)] for x in columns)
                yield pa.record_batch([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(n)], ["kind", "a", "b", "n"])

    return corpus.where(F.col("kind") < IDS).select("kind", "a", "ids").repartition("a").mapInArrow(add, "kind byte, a long, b int, n long")


def _unpacked(raw: pa.Scalar, n: int) -> np.ndarray:
    """n unsigned numbers of two or four bytes."""
    data = raw.as_buffer()
    return np.frombuffer(data, f"<u{data.size // n}").astype(np.int32)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """At most PIECE ids of a group and the one before them."""
    for batch in batches:
        for head, n, raw in zip(batch["a"].to_pylist(), batch["n"].to_pylist(), batch["ids"], strict=True):
            flat = _unpacked(raw, n)
            for i in range(0, n, PIECE):
                yield flat[i : i + PIECE], int(flat[i - 1]) if i else head


def pair_counts(pieces: DataFrame, layout: Layout, end: int) -> np.ndarray:
    """The pair table's counts over the whole corpus; its cells, of a fixed number, reach the driver."""
    sent, size = pieces.sparkSession.sparkContext.broadcast(layout), layout.n_rows * layout.width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)  # a task's share of the ids is far below 2**31
        for flat, head in _pieces(batches):
            np.add.at(total, sent.value.cells(previous(flat, end, layout.begin, head), flat).astype(np.intp), np.int32(1))
        at = np.flatnonzero(total)
        buckets, _, blocks = _blocks(at, np.zeros(len(at)), total[at])
        yield pa.record_batch([pa.array(np.zeros(len(blocks), np.int8)), pa.array(buckets), pa.array(blocks, pa.binary())], ["kind", "a", "ids"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, at, _, n in _added(batches):
            yield pa.record_batch([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([n.astype(np.float32).tobytes()], pa.binary())], ["at", "n"])

    found = pieces.select("a", "n", "ids").mapInArrow(count, "kind byte, a long, ids binary").repartition("a").mapInArrow(add, "at binary, n binary").toArrow()
    out = np.zeros(size, np.float32)
    for at, n in zip(found["at"], found["n"], strict=True):
        out[np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(n.as_buffer(), np.float32)
    return out


def train(model: Attention, pieces: DataFrame, end: int) -> int:
    """Gradient steps on every window of every training document, in ROUNDS rounds. Returns the number of windows.

    A round has its share of the pieces. Each task steps through its own from the round's parameters; the tasks'
    results are averaged by their windows, as grouped sums, and are the next round's parameters.
    """
    taught = 0
    for step in range(ROUNDS):
        sent = pieces.sparkSession.sparkContext.broadcast(model.for_training())
        rate = RATE * (1 - step / ROUNDS)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            own, done = sent.value.for_training(), 0
            by = Adam(own, rate)
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def steps() -> int:
                x, y = (np.concatenate(part) for part in zip(*held, strict=True))
                order = np.random.default_rng(17 + done).permutation(len(x))
                for i in range(0, len(order), BATCH):
                    by.step(x[order[i : i + BATCH]], y[order[i : i + BATCH]])
                return len(x)

            for flat, head in _pieces(batches):
                held.append(training_windows(flat, end, own.begin, head))
                if sum(len(x) for x, _ in held) >= BLOCK:
                    done += steps()
                    held = []
            if held:
                done += steps()
            if done:
                x = own.flat()
                yield pa.record_batch([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x * done), pa.array(np.full(len(x), done, np.int64))], ["at", "x", "n"])

        sums = pieces.where(F.col("b") == step).select("a", "n", "ids").mapInArrow(learn, "at int, x double, n long").groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
        found = sums.toArrow()  # a row for each parameter
        if found.num_rows:
            mean = np.zeros(found.num_rows)
            mean[found["at"].to_numpy()] = found["x"].to_numpy()
            model.set_flat(mean)
            taught += found["n"][0].as_py()
    return taught


def fit(corpus: DataFrame, counts: DataFrame, vocabulary: int, end: int) -> Attention:
    """The model from the whole training corpus; only counts of bounded kinds and its parameters reach the driver."""
    table = counts.where(F.col("kind") == ID).select("a", "n").toArrow()
    unigram = np.zeros(vocabulary, np.int64)
    unigram[table["a"].to_numpy()] = table["n"].to_numpy()
    pieces = corpus.where(F.col("kind") == IDS)
    layout = Layout(unigram)
    pairs = pair_counts(pieces, layout, end)
    model = Attention(layout, unigram, pairs.reshape(layout.n_rows, layout.width))
    train(model, pieces, end)
    return model


class Frequent:
    """Counts of the frequent words, by hash; of bounded size."""

    def __init__(self, counts: DataFrame):
        sizes, self.total = {}, 0
        words = counts.where(F.col("kind") == WORD)
        for r in words.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect():  # at most 63 rows
            sizes[r["k"]] = r["rows"]
            self.total += r["n"]
        self.distinct = sum(sizes.values())
        least, total = 64, 0
        for k in sorted(sizes, reverse=True):
            if total + sizes[k] > FREQUENT:
                break
            least, total = k, total + sizes[k]
        table = words.where(F.col("n") >= 2**least if least < 63 else F.lit(False)).select("a", "b", "n").toArrow()
        a, b, n = (table[c].to_numpy() for c in ("a", "b", "n"))
        order = np.lexsort((b, a))
        self.a, self.b, self.log = a[order], b[order], np.log10(n[order] + 0.1)

    def logs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log10(c + 0.1) of the words with these hashes, 0 (which it never is) if they aren't among the frequent."""
        if not len(self.a):
            return np.zeros(len(a))
        order, at = np.argsort(a), np.empty(len(a), np.int64)
        at[order] = np.searchsorted(self.a, a[order])  # in order, as each then begins where the one before it ended
        np.minimum(at, len(self.a) - 1, out=at)
        out = np.where((self.a[at] == a) & (self.b[at] == b), self.log[at], 0.0)
        twins = np.flatnonzero((self.a[at] == a) & (self.b[at] != b))  # the same long in two words
        for i in twins.tolist():
            for j in range(int(at[i]), int(np.searchsorted(self.a, a[i], "right"))):
                if self.b[j] == b[i]:
                    out[i] = self.log[j]
        return out


def _text_scores(model: Attention, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each document's ids; long ones in pieces that see the ids before them."""
    parts, heads, owner = [], [], []
    keep = SCORED + 1
    step = PIECE // SCORED * SCORED
    for i, d in enumerate(docs):
        for at in range(0, len(d), step):
            parts.append(d[at : at + step])
            heads.append(d[at - keep : at] if at else None)
            owner.append(i)
    out = np.zeros(len(docs))
    lo = 0
    while lo < len(parts):
        hi, size = lo, 0
        while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= PIECE):
            size += len(parts[hi])
            hi += 1
        ids, target, doc, first = windows(parts[lo:hi], model.begin, heads[lo:hi])
        got = np.bincount(doc, weights=model.log_probabilities(ids, target, first), minlength=hi - lo)
        np.add.at(out, owner[lo:hi], got)
        lo = hi
    return out / math.log(10)


def score(docs: DataFrame, path: str, end: int, vocabulary: int, fold: int = 10, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    # a null doc_id is outside the fold
    held = F.when(F.col("doc_id").isNull(), False).otherwise(remainder(F.col("doc_id"), fold) == held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")).withColumn("held", held)
    corpus = written(read_corpus(rows, path, end, vocabulary), "corpus")
    counts = written(summed(corpus), "counts")
    model = fit(corpus, counts, vocabulary, end)
    frequent = Frequent(counts)
    ends = sum(r["n"] for r in counts.where(F.col("kind") == END).select("n").collect())  # one row, or none
    total, distinct = frequent.total + ends, frequent.distinct + (ends > 0)
    floor, end_log = math.log10(total + 0.1 * (distinct + 1)), math.log10(ends + 0.1)
    sent = spark.sparkContext.broadcast((model, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go()
        net, known = sent.value
        part, seq = TaskContext.get().partitionId(), 0
        names = ["part", "seq", "doc_id", "held_out", "n_tokens", "known", "base", "score", "a", "b"]
        for batch in batches:
            for kind, total, raw, doc_ids, sizes, places, hashes in zip(*(batch[c] for c in ("kind", "n", "ids", "doc_ids", "sizes", "numbers", "hashes")), strict=True):
                n, data = len(doc_ids.values), hashes.as_buffer()
                lengths, spans = np.frombuffer(sizes.as_buffer(), np.int64).reshape(2, n)
                first = np.cumsum(lengths) - lengths
                numbers = _unpacked(places, int(lengths.sum()))
                different = data.size // 12
                a, b = np.frombuffer(data, np.int64, different), np.frombuffer(data, np.int32, different, 8 * different)
                logs = np.concatenate([[end_log], known.logs(a, b)])[numbers]
                rare = logs == 0
                few = np.add.reduceat(rare, first, dtype=np.int64)
                ids = np.split(_unpacked(raw, total.as_py()), np.cumsum(spans)[:-1])
                offsets = pa.array(np.concatenate([[0], np.cumsum(few)]).astype(np.int32))
                at = numbers[rare] - 1
                place = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), doc_ids.values, pa.array(np.full(n, kind.as_py() == HELD))]
                found = [pa.array(lengths), pa.array(lengths - few - int(ends == 0)), pa.array(np.add.reduceat(logs, first)), pa.array(_text_scores(net, ids))]
                yield pa.record_batch([*place, *found, pa.ListArray.from_arrays(offsets, pa.array(a[at])), pa.ListArray.from_arrays(offsets, pa.array(b[at]))], names)
                seq += n

    groups = corpus.where(F.col("kind") >= IDS).select("kind", "n", "ids", "doc_ids", "sizes", "numbers", "hashes")
    scored = written(groups.mapInArrow(run, "part int, seq long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, a array<bigint>, b array<int>"), "scored")
    remove(corpus)
    lookups = scored.select("part", "seq", F.explode(F.arrays_zip("a", "b")).alias("w")).select("part", "seq", "w.a", "w.b")
    words = counts.where(F.col("kind") == WORD).select("a", "b", "n")
    sums = lookups.join(words.hint("merge"), ["a", "b"], "left").groupBy("part", "seq").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more"), F.count("n").alias("found"))
    return scored.drop("a", "b").join(sums, ["part", "seq"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )
