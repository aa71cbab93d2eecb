"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Labels are given for documents, so tokens are labelled first: a word or a prefix of words (3 to 6 bytes) whose
document frequencies in toxic and clean training documents differ beyond chance marks tokens of toxic documents as
toxic; a token without such a feature is never tagged. The field has two states (clean, toxic), a weight for each such
feature, a bias and transitions; it is trained in numpy by gradient ascent on the conditional likelihood of token
sequences, all of them: equal ones are one with their number as its weight. For a document, forward-backward gives
every marked token's marginal; stretches of unmarked tokens are one matrix power. The expected number of different
toxic words and the largest marginal go through a logistic function fitted on the training documents.

Training reads at most SAMPLE labelled documents, the first by a hash of doc_id, and of a text over SAMPLE_BYTES bytes
four stretches that make up so many (documented bounds of the fit); near copies of an earlier training document don't
teach again. Scoring reads every whole text. Scores use the text alone.

Defined results: null and empty texts have no tokens and get the score of texts without toxic features; labels that
are null are ignored, of several labels of a document the largest holds; without any toxic training label every
score is 0; repeated rows give repeated results; a null doc_id isn't held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, SAMPLE_BYTES = 8_000, 65_536
SEGMENT, STEPS = 24, 120
MIN_DOCS, MIN_SHARE, MIN_SIGNAL = 4, 0.01, 4.5  # of toxic documents; MIN_SIGNAL grows with the number of features tried
THRESHOLD = 0.7
_MEMO = 300_000
#: A-Z to lower case; words are runs of a-z, 0-9 and bytes from 80 on.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def features(word: bytes) -> list[bytes]:
    """The word itself and its proper prefixes of 3 to 6 bytes."""
    return [b"=" + word, *(b"^" + word[:n] for n in range(3, 7) if len(word) > n)]


def _signal(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Signed root of the likelihood ratio: how far document frequencies a of toxic and b of clean differ."""
    rate = (a + b) / (toxic + clean)

    def part(x, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    g = part(a, toxic * rate) + part(b, clean * rate) + part(toxic - a, toxic * (1 - rate)) + part(clean - b, clean * (1 - rate))
    return np.sign(a / toxic - b / clean) * np.sqrt(np.maximum(2 * g, 0))


class Model:
    """Weights; small and of bounded size, so it may be broadcast."""

    def __init__(self, weights: dict[bytes, float], bias: float, trans: np.ndarray, logistic: np.ndarray):
        self.weights, self.bias, self.trans, self.logistic = weights, bias, trans, logistic
        self.memo: dict[bytes, float | None] = {}
        step = trans * np.array([1.0, math.exp(bias)])
        values, vectors = np.linalg.eig(step)
        order = np.argsort(-np.abs(values))
        self.ratio = float((values[order[1]] / values[order[0]]).real)
        p = vectors[:, order].real
        inverse = np.linalg.inv(p)
        self.lasting, self.fading = np.outer(p[:, 0], inverse[0]), np.outer(p[:, 1], inverse[1])

    def _weight(self, word: bytes) -> float | None:
        found = [self.weights[f] for f in features(word) if f in self.weights]
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        out = self.memo[word] = sum(found) + self.bias if found else None
        return out

    def _gap(self, n: int) -> np.ndarray:
        """The scaled matrix of n unmarked tokens."""
        return self.lasting + self.fading * self.ratio**n if n else np.eye(2)

    def marked(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(position, score) of the tokens with any feature."""
        memo = self.memo
        special = {w: x for w in set(words) if (x := memo[w] if w in memo else self._weight(w)) is not None}
        return [(i, special[w]) for i, w in enumerate(words) if w in special] if special else []

    def marginals(self, marks: list[tuple[int, float]], n: int) -> list[float]:
        """Probability of the toxic state at each marked token, by forward-backward."""
        if not marks:
            return []
        forward, last, v = [], -1, np.ones(2)
        for at, score in marks:
            gap = at - last - 1
            if last < 0:  # as in training, the first token has no transition
                v = np.array([1.0, math.exp(self.bias)]) @ self._gap(gap - 1) @ self.trans if gap else v
            else:
                v = (v @ self._gap(gap)) @ self.trans
            v = v * np.array([1.0, math.exp(min(score, 30.0))])
            v = v / v.sum()
            forward.append(v)
            last = at
        out, w, after = [], np.ones(2), n
        for (at, score), f in zip(reversed(marks), reversed(forward), strict=True):
            w = self._gap(after - at - 1) @ w
            both = f * w
            out.append(float(both[1] / both.sum()))
            w = self.trans @ (np.array([1.0, math.exp(min(score, 30.0))]) * w)
            w = w / w.sum()
            after = at
        return out[::-1]

    @staticmethod
    def summary(words: list[bytes], marks: list[tuple[int, float]], marginals: list[float]) -> tuple[float, float]:
        """Expected number of different toxic words (logarithm of one more), and the largest marginal."""
        most: dict[bytes, float] = {}
        for (at, _), p in zip(marks, marginals, strict=True):
            most[words[at]] = max(p, most.get(words[at], 0.0))
        return math.log1p(sum(most.values())), max(marginals, default=0.0)

    def score(self, words: list[bytes], marks: list[tuple[int, float]], marginals: list[float]) -> float:
        if len(self.logistic) == 0:
            return 0.0
        z = float(self.logistic[0] + self.logistic[1:] @ np.array(self.summary(words, marks, marginals)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


Segment = tuple[tuple[tuple[int, ...], ...], bool]


def _segments(docs: list[bytes], toxic: list[int], index: dict[bytes, int]) -> Counter[Segment]:
    """How often each stretch of SEGMENT tokens occurs: the features of every token, and whether those that have any are toxic."""
    memo: dict[bytes, tuple[int, ...]] = {}

    def found(word: bytes) -> tuple[int, ...]:
        if word not in memo:
            memo[word] = tuple(index[f] for f in features(word) if f in index)
        return memo[word]

    out: Counter[Segment] = Counter()
    for text, y in zip(docs, toxic, strict=True):
        own = [found(w) for w in text.split()]
        for i in range(0, len(own), SEGMENT):
            part = tuple(own[i : i + SEGMENT])
            out[part, bool(y) and any(part)] += 1
    return out


def fit_field(segments: Counter[Segment], n_features: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transition factors by gradient ascent (Adagrad) with a small quadratic penalty."""
    s, n = len(segments), SEGMENT
    real = np.zeros((s, n))
    y = np.zeros((s, n))
    times = np.array(list(segments.values()), float)[:, None]
    at, feature = [], []
    for i, (found, toxic) in enumerate(segments):
        real[i, : len(found)] = 1
        for j, fs in enumerate(found):
            if fs:
                y[i, j] = toxic
                at += [i * n + j] * len(fs)
                feature += fs
    at, feature = np.array(at, np.int64), np.array(feature, np.int64)
    many = np.repeat(times, n, axis=1).ravel()[at]  # of each feature's place
    theta = np.concatenate([np.zeros(n_features), [-4.0, 0.0, 0.0, 0.0]])  # weights, bias, then clean-toxic, toxic-clean, toxic-toxic
    history = np.full(len(theta), 1e-6)
    seen = np.bincount(feature, weights=y.ravel()[at] * many, minlength=n_features)
    pair = lambda a, b: (a[:, :-1] * b[:, 1:] * real[:, 1:] * times).sum()
    observed = np.concatenate([seen, [(y * real * times).sum(), pair(1 - y, y), pair(y, 1 - y), pair(y, y)]])
    for _ in range(STEPS):
        score = (np.bincount(at, weights=theta[feature], minlength=s * n).reshape(s, n) + theta[n_features]) * real
        t = np.exp(np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]))
        e = np.stack([np.ones((s, n)), np.exp(np.clip(score, -30, 30))], -1)
        alpha, beta = np.zeros((s, n, 2)), np.ones((s, n, 2))
        for j in range(n):
            v = e[:, j] if j == 0 else (alpha[:, j - 1] @ t) * e[:, j]
            if j:
                v = np.where(real[:, j : j + 1] > 0, v, alpha[:, j - 1])
            alpha[:, j] = v / v.sum(1, keepdims=True)
        for j in range(n - 2, -1, -1):
            w = (e[:, j + 1] * beta[:, j + 1]) @ t.T
            w = w / w.sum(1, keepdims=True)
            beta[:, j] = np.where(real[:, j + 1 : j + 2] > 0, w, 1.0)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        p = post[:, :, 1] * real
        two = alpha[:, :-1, :, None] * t * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
        two /= two.sum((2, 3), keepdims=True)
        two = (two * (real[:, 1:] * times)[:, :, None, None]).sum((0, 1))
        expected = np.concatenate([np.bincount(feature, weights=p.ravel()[at] * many, minlength=n_features), [(p * times).sum(), two[0, 1], two[1, 0], two[1, 1]]])
        grad = observed - expected - 0.05 * theta
        history += grad * grad
        theta = theta + 0.5 * grad / np.sqrt(history)
    return theta[:n_features], float(theta[n_features]), np.exp(np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (y - p) - 0.1 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _copies(docs: list[bytes]) -> list[bool]:
    """Whether a training document shares 3 of 8 minimum hashes of its 3-word shingles with an earlier one.

    Copies would make any of their words look typical.
    """
    odd = np.random.default_rng(5).integers(0, 2**63, 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    seen: set[tuple[int, int]] = set()
    out = []
    for text in docs:
        words = text.split()
        shingles = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles))
        own = {(i, int((h * m).min())) for i, m in enumerate(odd)}
        out.append(len(own & seen) >= 3)
        seen |= own
    return out


def fit(texts: list[bytes | None], toxic: list[int]) -> Model:
    docs = [(t or b"").translate(_FOLD) for t in texts]
    again = _copies(docs)
    docs, toxic = [d for d, c in zip(docs, again, strict=True) if not c], [y for y, c in zip(toxic, again, strict=True) if not c]
    n_toxic, n_clean = sum(toxic), len(toxic) - sum(toxic)
    nothing = Model({}, -4.0, np.ones((2, 2)), np.zeros(0))
    if not n_toxic or not n_clean:
        return nothing
    own = lambda text: {f for w in set(text.split()) for f in features(w)}
    first: Counter = Counter()
    for text, y in zip(docs, toxic, strict=True):
        if y:
            first.update(own(text))
    first = Counter({f: c for f, c in first.items() if c >= MIN_DOCS})
    other: Counter = Counter()
    for text, y in zip(docs, toxic, strict=True):
        if not y:
            other.update(f for f in own(text) if f in first)
    names = list(first)
    least = max(MIN_SIGNAL, math.sqrt(2 * math.log(max(len(names), 2))) + 0.5)  # beyond the largest of as many by chance
    a, b = np.array([first[f] for f in names], float), np.array([other[f] for f in names], float)
    signal = _signal(a, b, n_toxic, n_clean) if names else np.zeros(0)
    best = sorted((i for i in range(len(names)) if signal[i] >= least and a[i] >= MIN_SHARE * n_toxic and a[i] / n_toxic > 4 * b[i] / n_clean), key=lambda i: (-signal[i], names[i]))
    if not best:
        return nothing
    index = {names[i]: k for k, i in enumerate(best)}
    weights, bias, trans = fit_field(_segments(docs, toxic, index), len(index))
    model = Model({f: float(weights[k]) for f, k in index.items()}, bias, trans, np.zeros(0))
    x = []
    for text in docs:
        words = text.split()
        marks = model.marked(words)
        x.append(model.summary(words, marks, model.marginals(marks, len(words))))
    model.logistic = _fit_logistic(np.array(x), np.array(toxic, float))
    model.memo = {}
    return model


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the doc_id as text, modulo `by`; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % by, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, fold: int = 3, held_out: int = 1) -> Model:
    """Fit on labelled documents outside the held-out fold."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(remainder(F.col("doc_id"), fold) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = marks.orderBy(*order).limit(SAMPLE + SAMPLE // 4)  # bounded, so it may be broadcast; some may have no text
    body, quarter = F.col("text").cast("binary"), F.lit(SAMPLE_BYTES // 4)
    stretches = [F.substring(body, ((F.octet_length("text") - quarter) * i / 3 + 1).cast("int"), quarter) for i in range(4)]
    part = F.when(F.octet_length("text") <= SAMPLE_BYTES, body).otherwise(F.concat(*(x for s in stretches for x in (s, F.lit(b" ")))))
    rows = docs.where("text IS NOT NULL").select("doc_id", part.alias("body")).join(F.broadcast(first), "doc_id")
    sample = rows.orderBy(*order, "body").limit(SAMPLE).collect()
    return fit([bytes(r.body) for r in sample], [int(r.toxic > 0) for r in sample])


def tag(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with _score and _spans: flat start, end pairs of offending tokens in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            scores, spans = [], []
            for text in batch["_body"]:
                raw = text.as_py() or b""
                folded = raw.translate(_FOLD)
                words = folded.split()
                marks = field.marked(words)
                p = field.marginals(marks, len(words))
                scores.append(field.score(words, marks, p))
                bad = {at for (at, _), x in zip(marks, p, strict=True) if x >= 0.5}
                flat, last, chars = [], 0, 0
                if bad:
                    for i, m in enumerate(_WORD.finditer(folded)):
                        if i in bad:
                            chars += len(raw[last : m.start()].decode("utf-8", "replace"))
                            size = len(raw[m.start() : m.end()].decode("utf-8", "replace"))
                            flat += [chars, chars + size]
                            chars, last = chars + size, m.end()
                spans.append(flat)
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            del cols["_body"]
            cols |= {"_score": pa.array(scores, pa.float64()), "_spans": pa.array(spans, pa.list_(pa.int64()))}
            yield pa.record_batch(list(cols.values()), list(cols))

    rows = docs.select(*keep, F.col(text_col).cast("binary").alias("_body"))
    schema = rows.drop("_body").withColumns({"_score": F.lit(0.0), "_spans": F.array().cast("array<bigint>")}).schema
    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; then the offending spans as start:end, comma-joined."""
    found = tag(docs, train(docs, labels), ["doc_id"])
    pairs = F.transform(F.sequence(F.lit(0), F.size("_spans") - 2, F.lit(2)), lambda i: F.concat_ws(":", F.get("_spans", i.cast("int")), F.get("_spans", (i + 1).cast("int"))))
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
        F.when(F.size("_spans") > 0, F.array_join(pairs, ",")).otherwise("").alias("spans"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, columns and rows as they were."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    found = tag(docs.toDF(*plain), train(docs, labels), plain, plain[names.index("text")])
    return found.where(F.col("_score") < THRESHOLD).select(*(F.col(p).alias(n) for p, n in zip(plain, names, strict=True)))
