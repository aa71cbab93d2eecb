"""A small causal self-attention model over subword ids, in numpy.

P(next = j | context) = P(class of j | context) * P(j | class of j, current id). Classes group subwords with alike
neighbours. The class logits at a position are B[current id] + attention: one head over the current and earlier
positions of the window. B, the second factor, the classes and the embeddings of ids (leading components of how the
classes before and after them depart from their usual shares) come from counts over the whole training corpus; the
projections of embeddings to queries, keys and values, those of values to classes, and a bias by distance are trained
by gradients. Ids outside the TOP most frequent share one row, so the tables have a fixed size. When scoring, windows
overlap by half: each gives SCORED new positions and sees as many before them, so every token is scored once.
When training, windows lie end to end and every position is a target.
"""

from __future__ import annotations

import numpy as np

WINDOW, SCORED = 32, 16  # SCORED is half of WINDOW
DIM, EMBED, CLASSES, TOP = 16, 48, 64, 4_096
HUBS = 256  # the most frequent ids, whose places before and after an id tell its class
KAPPA = 20.0
_LOW, _MOST = np.float32(-1e9), np.float32(60)  # of a place that can't be seen; of a product of query and key
_GAP = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]  # from each place back to each
_FAR = np.maximum(_GAP, 0)


def windows(docs: list[np.ndarray], begin: int, heads: list[np.ndarray | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents (each closed by the end id) in one row: (ids, targets with -1 for none, documents, first).

    Window i shows places i * SCORED to i * SCORED + WINDOW and scores the targets of its second half. Before a
    document stand SCORED places of padding, or `heads`: the SCORED + 1 ids before a document that goes on. first[i]:
    whether the first half of window i is padding.
    """
    sizes = np.array([len(d) for d in docs])
    spans = (-(-sizes // SCORED) + 1) * SCORED
    starts = (np.cumsum(spans) - spans).astype(np.int64)
    flat = np.full(int(spans.sum()), begin, np.int32)
    target = np.full(len(flat), -1, np.int32)
    new = np.zeros(len(flat) // SCORED, bool)
    for i, (d, s) in enumerate(zip(docs, starts.tolist(), strict=True)):
        flat[s + SCORED + 1 : s + SCORED + len(d)] = d[:-1]
        target[s + SCORED : s + SCORED + len(d)] = d
        if heads and heads[i] is not None:
            flat[s : s + SCORED + 1] = heads[i]
        else:
            new[s // SCORED] = True
    return flat, target, np.repeat(np.arange(len(docs)), spans), new


def previous(flat: np.ndarray, end: int, begin: int, head: int | None = None) -> np.ndarray:
    """The id before each of consecutive documents' ids, each closed by the end id; `head` is the one before the first."""
    out = np.empty(len(flat), np.int64)
    out[1:] = flat[:-1]
    out[:1] = begin if head is None or head == end else head
    out[1:][flat[:-1] == end] = begin
    return out


def training_windows(flat: np.ndarray, end: int, begin: int, head: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and targets [n, WINDOW], -1 for none: windows lie end to end within a document."""
    before = previous(flat, end, begin, head)
    stop = np.flatnonzero(flat == end) + 1
    if not len(stop) or stop[-1] != len(flat):
        stop = np.append(stop, len(flat))
    start = np.concatenate([[0], stop[:-1]])
    counts = -(-(stop - start) // WINDOW)
    at = np.repeat((np.cumsum(counts) - counts) * WINDOW - start, stop - start)  # how far a document's ids move
    at += np.arange(len(flat))
    x, y = np.full(int(counts.sum()) * WINDOW, begin, np.int32), np.full(int(counts.sum()) * WINDOW, -1, np.int32)
    x[at], y[at] = before, flat
    return x.reshape(-1, WINDOW), y.reshape(-1, WINDOW)


class Layout:
    """Rows and columns of the pair table: TOP frequent ids, one row and column for the rest, one row for the begin."""

    def __init__(self, unigram: np.ndarray):
        self.vocabulary = self.begin = len(unigram)
        self.top = np.argsort(-unigram, kind="stable")[:TOP]
        self.rows = np.full(self.vocabulary + 1, TOP, np.int32)
        self.rows[self.top] = np.arange(len(self.top))
        self.rows[self.vocabulary] = TOP + 1
        self.columns = self.rows[:-1]
        self.n_rows, self.width = TOP + 2, TOP + 1

    def cells(self, before: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Flat index in the pair table of every id and the one before it."""
        return self.rows[before] * np.int32(self.width) + self.columns[flat]


def cluster(layout: Layout, pairs: np.ndarray, unigram: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of every id: k-means over what precedes and follows those of the table; all others share class 0."""
    out = np.zeros(len(unigram), np.int32)
    ids = layout.top[unigram[layout.top] >= 5]
    n = len(ids)
    if n < 2 * classes:
        out[ids] = 1 + np.arange(n) % (classes - 1)
        return out
    hubs = HUBS - 1
    parts = []
    for table, weight in ((pairs[:, :n].T, 1.0), (pairs[:n], 0.5)):  # before it, after it
        whole = table.sum(1, dtype=np.float64)[:, None]
        near = np.hstack([table[:, :hubs], whole - table[:, :hubs].sum(1, keepdims=True, dtype=np.float64)])
        parts.append(np.sqrt(np.maximum(near, 0) / np.maximum(whole, 1)) * weight)
    x = np.hstack(parts).astype(np.float32)
    mass = np.sqrt(unigram[ids].astype(np.float64))
    rng = np.random.default_rng(3)
    centre = x[np.sort(rng.choice(n, classes - 1, replace=False, p=mass / mass.sum()))]
    for _ in range(25):
        nearest = ((centre * centre).sum(1) - 2 * x @ centre.T).argmin(1)
        for c in range(classes - 1):
            own = nearest == c
            if own.any():
                centre[c] = np.average(x[own], axis=0, weights=mass[own])
    out[ids] = 1 + nearest
    return out


class Attention:
    def __init__(self, layout: Layout, unigram: np.ndarray, pairs: np.ndarray, seed: int = 11):
        """unigram: count of every id; pairs [n_rows, width]: counts of (current, next) as the layout has them."""
        classes, top, none = cluster(layout, pairs, unigram), layout.top, np.zeros(TOP - len(layout.top), np.int64)
        mass = np.bincount(classes, weights=unigram + 0.1, minlength=CLASSES)
        share = (unigram + 0.1) / mass[classes]
        rest = share[layout.columns == TOP].sum()
        of = np.concatenate([classes[top], none, [0]])  # class of each column
        prior = np.concatenate([share[top], none, [rest]])
        follow = np.zeros((layout.n_rows, CLASSES))
        for c in range(CLASSES):
            follow[:, c] = pairs[:, of == c].sum(1, dtype=np.float64)
        total = (mass / mass.sum()) if mass.sum() else np.full(CLASSES, 1 / CLASSES)
        used = mass > 0
        with np.errstate(divide="ignore"):
            self.base = np.where(used, np.log((follow + 2.0 * total) / (follow.sum(1, keepdims=True) + 2.0)), _LOW).astype(np.float32)
            self.inside = np.empty(pairs.shape, np.float32)
            for i in range(0, len(pairs), 256):  # in parts, as the table is large
                own = slice(i, i + 256)
                self.inside[own] = np.maximum(np.log((pairs[own] + KAPPA * prior) / (follow[own][:, of] + KAPPA)), -80)
            self.extra = np.where(layout.columns == TOP, np.log(share / max(rest, 1e-300)), 0).astype(np.float32)
        self.classes, self.rows, self.columns, self.begin = classes, layout.rows, layout.columns, layout.begin
        self.embedded = self._embed(pairs, follow, total, used)
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.normal(size=s) * 0.1).astype(np.float32)
        self.set({"qkv": small(EMBED + 1, 3 * DIM), "w": np.zeros((DIM, CLASSES), np.float32), "r": np.linspace(0, -1.5, WINDOW).astype(np.float32)})

    def _embed(self, pairs: np.ndarray, follow: np.ndarray, total: np.ndarray, used: np.ndarray) -> np.ndarray:
        """[n_rows, EMBED + 1]: leading components of the classes' logarithmic lift after and before an id, and a constant."""
        n = len(pairs)
        before, k = np.zeros((n, CLASSES)), np.full(n, -1)  # class of each row's id, for rows of one
        known = np.flatnonzero(self.columns < TOP)
        k[self.columns[known]] = self.classes[known]
        for c in range(CLASSES):
            before[:TOP, c] = pairs[k == c][:, :TOP].sum(0, dtype=np.float64)
        usual = np.where(used, total, 1.0)
        lift = [np.log((x + 10 * total + 1e-9) / (x.sum(1, keepdims=True) + 10) / usual) * used for x in (follow, before)]
        m = np.hstack(lift)
        mass = np.sqrt(follow.sum(1) + 1)
        m -= np.average(m, axis=0, weights=mass)
        values, vectors = np.linalg.eigh((m * mass[:, None]).T @ m)
        parts = m @ vectors[:, np.argsort(-values, kind="stable")[:EMBED]]
        scale = np.sqrt(np.average((parts * parts).mean(1), weights=mass)) or 1.0
        return np.hstack([parts / scale, np.ones((n, 1))]).astype(np.float32)

    def set(self, p: dict[str, np.ndarray]) -> None:
        """Take parameters, and lay out queries, keys and values by row."""
        self.p = p
        self.q, self.k, self.v = np.split(self.embedded @ p["qkv"], 3, axis=1)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in sorted(self.p)]).astype(np.float64)

    def shaped(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of x by parameter, in the order of flat()."""
        out, at = {}, 0
        for n in sorted(self.p):
            out[n] = x[at : at + self.p[n].size].reshape(self.p[n].shape)
            at += self.p[n].size
        return out

    def set_flat(self, x: np.ndarray) -> None:
        self.set(self.shaped(x.astype(np.float32)))

    def for_training(self) -> Attention:
        """A copy without what only scoring needs."""
        out = object.__new__(Attention)
        out.__dict__ = self.__dict__ | dict.fromkeys(("inside", "extra", "columns"))
        return out

    def _bias(self, first: int) -> np.ndarray:
        return np.where(_GAP[first:] >= 0, self.p["r"][_FAR[first:]], _LOW).astype(np.float32)

    def log_probabilities(self, ids: np.ndarray, target: np.ndarray, first: np.ndarray, batch: int = 256, attend: bool = True) -> np.ndarray:
        """Natural logarithm of the probability of every target, as windows() lays them out; 0 where there is none.

        attend: False leaves the attention out.
        """
        out, bias = np.zeros(len(target), np.float32), self._bias(SCORED)
        q, k, value = np.ascontiguousarray(self.q), np.ascontiguousarray(self.k), np.hstack([self.v, np.ones((len(self.v), 1), np.float32)])
        ones, at, n = np.ones(CLASSES, np.float32), self.rows[ids].astype(np.intp), len(ids) // SCORED - 1
        safe = np.maximum(target, 0)
        got = np.take(self.inside.ravel(), at * self.inside.shape[1] + self.columns[safe])
        got += self.extra[safe]
        of, row = self.classes[safe], np.arange(0, batch * SCORED * CLASSES, CLASSES)
        longest = lambda table: float(np.sqrt((table.astype(np.float64) ** 2).sum(1).max()))
        bounded = longest(q) * longest(k) < _MOST  # no product can need cutting

        def shown(table: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
            """Rows of a table by window, each gathered once."""
            rows = np.take(table, places, axis=0)
            a, b = rows.strides
            return np.lib.stride_tricks.as_strided(rows, (count, WINDOW, rows.shape[1]), (SCORED * a, a, b))

        for i in range(0, n, batch):
            count = min(batch, n - i)
            own = slice((i + 1) * SCORED, (i + 1 + count) * SCORED)
            here = at[own]
            z = np.take(self.base, here, axis=0)
            if attend:
                places = at[i * SCORED : own.stop]
                s = np.matmul(np.take(q, here, axis=0).reshape(count, SCORED, DIM), shown(k, places, count).transpose(0, 2, 1))
                if not bounded:
                    np.clip(s, -_MOST, _MOST, out=s)
                s += bias
                if len(new := np.flatnonzero(first[i : i + count])):
                    s[new, :, :SCORED] = _LOW
                np.exp(s, out=s)
                a = np.matmul(s, shown(value, places, count)).reshape(-1, DIM + 1)  # the last column adds up the weights
                z += (a[:, :DIM] / a[:, DIM:]) @ self.p["w"]
            got[own] += z.ravel()[row[: len(here)] + of[own]]
            np.exp(z, out=z)
            out[own] = np.log(z @ ones)
        np.subtract(got, out, out=out)
        out[target < 0] = 0
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean cross-entropy of the next id's class over training windows, and that mean."""
        n, at, target = len(x), self.rows[x.ravel()].astype(np.intp), y.ravel()
        place = np.zeros(len(self.embedded), np.intp)
        place[at] = 1
        different = np.flatnonzero(place)
        place[different] = np.arange(len(different))
        qkv = np.take(self.embedded[different] @ self.p["qkv"], place[at], axis=0).reshape(n, WINDOW, 3 * DIM)
        q, k, v = qkv[:, :, :DIM], qkv[:, :, DIM : 2 * DIM], qkv[:, :, 2 * DIM :]
        s = np.matmul(q, k.transpose(0, 2, 1))
        np.clip(s, -_MOST, _MOST, out=s)
        s += self._bias(0)
        np.exp(s, out=s)  # weights before they are divided by their sum, which the narrower arrays below are instead
        over = 1 / (s.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32))
        a = np.matmul(s, v).reshape(-1, DIM)
        a *= over[:, None]
        z = np.take(self.base, at, axis=0)
        z += a @ self.p["w"]
        np.exp(z, out=z)
        real = target >= 0
        unit = np.float32(1 / max(1, np.count_nonzero(real)))
        own = np.arange(0, z.size, CLASSES) + self.classes[target]
        total = z @ np.ones(CLASSES, np.float32)
        share = real * unit
        loss = -float(np.log(np.maximum(z.ravel()[own] / total, 1e-30)) @ share)
        z.ravel()[own] -= total
        share /= total  # z times share are the gradients of the logits; the narrower arrays are multiplied instead
        da = z @ self.p["w"].T
        da *= (share * over)[:, None]
        dot = np.einsum("ij,ij->i", da, a)
        a *= share[:, None]
        da = da.reshape(n, WINDOW, DIM)
        ds = np.matmul(da, v.transpose(0, 2, 1))
        ds -= dot.reshape(n, WINDOW, 1)
        ds *= s
        back = np.empty((n, WINDOW, 3 * DIM), np.float32)
        np.matmul(ds, k, out=back[:, :, :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=back[:, :, DIM : 2 * DIM])
        np.matmul(s.transpose(0, 2, 1), da, out=back[:, :, 2 * DIM :])
        # ds is 0 where no place is seen
        by_gap = np.bincount(_FAR.ravel(), weights=np.ones(n, np.float32) @ ds.reshape(n, -1), minlength=WINDOW)
        h = np.take(self.embedded, at, axis=0)
        return {"w": a.T @ z, "r": by_gap.astype(np.float32), "qkv": h.T @ back.reshape(-1, 3 * DIM)}, loss


class Adam:
    """Steps on a model's parameters, of which it takes a copy: models that had them in common keep theirs."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.steps = model, rate, 0
        self.x = model.flat().astype(np.float32)
        self.m, self.s = np.zeros_like(self.x), np.zeros_like(self.x)
        model.p = model.shaped(self.x)

    def step(self, x: np.ndarray, y: np.ndarray) -> float:
        grad, loss = self.model.gradients(x, y)
        self.steps += 1
        g = np.concatenate([grad[n].ravel() for n in sorted(grad)])
        self.m += np.float32(0.1) * (g - self.m)
        g *= g
        self.s += np.float32(0.01) * (g - self.s)
        by = np.sqrt(self.s / np.float32(1 - 0.99**self.steps))
        by += np.float32(1e-8)
        np.divide(self.m, by, out=by)
        by *= np.float32(self.rate * min(1.0, self.steps / 10) / (1 - 0.9**self.steps))
        self.x -= by
        return loss
