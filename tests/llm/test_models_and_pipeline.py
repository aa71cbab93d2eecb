"""Nearest neighbours, language-model scores and the pipeline."""

import base64
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from llm_cases import DATA, ODD
from test_near_copies import slow_kept
from test_text_operators import slow_spans, slow_tags, words
from test_tokens import check_packing

import corpus_pipeline
from sentrylake.llm import ann, attention, lm, queries, toxicity
from sentrylake.llm.common import tokenizer_path, written

# Neighbours


def slow_nearest(rows, every=50, k=5):
    """rows: (id, vector) of valid vectors."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize(("sf", "least"), [("sf0.001", 0.99), ("sf0.1", 0.95)])
def test_op1_recall(spark, sf, least):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = slow_nearest(rows)
    got = {}
    for r in queries.op1_hilbert_neighbours(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 5 for q in want]) >= least
    vectors = dict(rows)
    for q, found in got.items():
        a = np.array(vectors[q], float)
        for d, s in found:
            b = np.array(vectors[d], float)
            assert abs(s - a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) < 1e-12
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.0, 1.0, 1.0]), (7, []), (None, [1.0, 0.5])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(60)] + [(300 + i, [0.0, float(i + 1)]) for i in range(3)] + [(50, [2.0, 0.0]), (50, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'mine' AS v", "1 AS id", "2 AS curve", "3 AS score")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
    assert got[0] == [(50, 1.0), (50, 1.0), (100, 1.0), (101, 1.0), (102, 1.0)]
    assert sorted(got[50]) == sorted(2 * [(0, 1.0), (50, 1.0), (100, 1.0), (101, 1.0), (102, 1.0)])  # two rows ask
    assert got[100][:3] == [(0, 1.0), (50, 1.0), (50, 1.0)]
    assert got[300][:3] == [(301, 1.0), (302, 1.0), (6, round(0.5**0.5, 12))]
    few = spark.createDataFrame([(0, [1.0]), (1, [-2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:4] for r in ann.nearest(few).collect()] == [(0, 1, 1, -1.0)]
    assert ann.nearest(few.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["clustered", "flat"])
def test_recall_where_windows_are_a_part_of_the_table(spark, kind, monkeypatch):
    """20,000 vectors: in clusters three windows are far below 5 % of the rows; without structure they are larger."""
    monkeypatch.setattr(ann, "LEAST", 30)
    rng = np.random.default_rng(8)
    n = 20_000
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x = rng.normal(size=(400, 64))[rng.integers(0, 400, n)] + 0.15 * x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, window = {}, 0
    for r in ann.nearest(df, every=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        window = r.window
    want = slow_nearest(list(enumerate(x)), every=100)
    assert np.mean([len(got[q] & {a for a, _ in want[q]}) / 5 for q in want]) >= 0.9
    assert 3 * window < 0.05 * n and window < 100 if kind == "clustered" else window > 200


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * dims), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(side**dims))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# Language model


def slow_base(docs):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    counts, ends = Counter(), 0
    for d, t in docs:
        if not held[d]:
            counts.update((t or "").encode().lower().split())
            ends += 1
    total = sum(counts.values()) + ends
    floor = math.log10(total + 0.1 * (len(counts) + (ends > 0) + 1))
    out = []
    for d, t in docs:
        w = (t or "").encode().lower().split()
        out.append((d, held[d], len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), total, sum(math.log10(counts[x] + 0.1) - floor for x in w) + math.log10(ends + 0.1) - floor))
    return out


def check_base(rows, docs):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=str)
    assert got == sorted(((*x[:5], round(x[5], 4)) for x in slow_base(docs)), key=str)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 50])
def test_op10_base_is_exact(spark, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = queries.op10_attention_lm(spark, DATA).collect()
    check_base(rows, docs)
    assert all(r.score < 0 for r in rows)


def test_op10_is_better_than_the_base_on_held_out_texts(spark):
    rows = [r for r in queries.op10_attention_lm(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)
    assert sum(r.score > r.base_score for r in rows) > 0.8 * len(rows)


def test_every_window_of_every_training_text_teaches(spark):
    corpus = lm.read_corpus(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("CAST(text AS BINARY) AS body"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), 50_256, 50_257)
    pieces = written(corpus.where(f"kind = {lm.IDS}"), "pieces")
    flat = [(np.frombuffer(r.ids, np.uint16).astype(np.int32), r.a) for r in pieces.collect()]
    unigram = np.bincount(np.concatenate([f for f, _ in flat]), minlength=50_257)
    layout = attention.Layout(unigram)
    model = attention.Attention(layout, unigram, np.zeros((layout.n_rows, layout.width), np.float32))
    assert lm.train(model, pieces, 50_256) == sum(len(attention.training_windows(f, 50_256, layout.begin, head)[0]) for f, head in flat)


def test_tasks_start_from_the_parameters_of_the_round():
    model, sample = small_model()
    kept = model.flat()
    x, y = attention.training_windows(np.concatenate(sample), 49, model.begin)
    first = []
    for _ in range(2):
        own = model.for_training()
        attention.Adam(own, 0.01).step(x, y)
        first.append(own.flat())
    assert (model.flat() == kept).all() and (first[0] == first[1]).all() and (first[0] != kept).any()


def test_counts_go_in_blocks_and_add_up(spark):
    corpus = written(lm.read_corpus(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("CAST(text AS BINARY) AS body"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), 50_256, 50_257), "corpus")
    tasks = max(corpus.where(f"kind = {lm.END}").count(), 1)
    assert corpus.where(f"kind < {lm.IDS}").count() <= tasks * (2 * lm.BUCKETS + 1)
    words = Counter(w for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for w in (r.text or "").encode().lower().split())
    a, b = lm._hashes(list(words))
    got = {(r.kind, r.a, r.b): r.n for r in lm.summed(corpus).collect()}
    assert {k[1:]: n for k, n in got.items() if k[0] == lm.WORD} == dict(zip(zip(a.tolist(), b.tolist(), strict=True), words.values(), strict=True))
    assert got[lm.END, 0, 0] == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_blocks_tell_keys_of_the_same_long_apart():
    rng = np.random.default_rng(2)
    want, batches = Counter(), []
    for _ in range(3):
        a, b, n = rng.integers(-300, 300, 2_000), rng.integers(0, 3, 2_000), rng.integers(1, 9, 2_000)
        for k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
            want[k[:2]] += k[2]
        buckets, _, blocks = lm._blocks(a, b, n)
        batches.append(pa.record_batch([pa.array(np.full(len(blocks), 2, np.int8)), pa.array(buckets), pa.array(blocks, pa.binary())], ["kind", "a", "ids"]))
    got = [((x, y), z) for kind, *c in lm._added(iter(batches)) for x, y, z in zip(*map(np.ndarray.tolist, c), strict=True) if kind == 2]
    assert len(got) == len(want) and dict(got) == want


def test_language_model_odd_rows(spark, clashing, no_docs):
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    rows = lm.score(clashing, path, 50_256, 50_257).collect()
    check_base(rows, [x[:2] for x in ODD])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.score(no_docs, path, 50_256, 50_257).count() == 0
    alone = lm.score(clashing.where("doc_id = 30 OR doc_id IS NULL").limit(0).unionByName(clashing.where("doc_id = 4")), path, 50_256, 50_257)
    assert alone.count() == 1


def test_op10_reads_every_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    n = docs.count()
    scored = lm.score(docs.mapInArrow(counted, docs.schema), tokenizer_path("byte_bpe_multi_50k.tiktoken"), 50_256, 50_257)
    assert scored.count() == n == read.value


@pytest.mark.parametrize("group", [lm.GROUP, 100])
def test_groups_hold_the_words_and_ids_of_each_text(group, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", group)
    rng = np.random.default_rng(5)
    valid = [b"", None, b"  a  B c ", b"\t\n\x0b\x0c\r", b"a\x1cb \x1dc", "É ẞ \u00a0x\u0085 \u3000 \U0001f642 a".encode(), b"x" * 500 + b" <|endoftext|> It's 12-3", b"\x00 \x00b"]
    for texts in (valid, [*valid, *(rng.integers(0, 256, 90, np.uint8).tobytes() for _ in range(20))]):
        column, words = pa.array(texts, pa.binary()), lm.Words(lm._encode(tokenizer_path("byte_bpe_multi_50k.tiktoken")), 50_256, 1000)
        with open(tokenizer_path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            plain = tiktoken.Encoding("plain", pat_str=r"[\s\S]+", mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
        at = 0
        for own in lm._groups(column):
            different, places, lengths = lm._numbered(column.slice(own.start, own.stop - own.start))
            assert own.start == at and len(set(different)) == len(different)
            at = own.stop
            want = [w for t in texts[own] for w in [*(t or b"").lower().split(), None]]
            assert [different[i - 1] if i else None for i in places.tolist()] == want
            assert lengths.tolist() == [len((t or b"").split()) + 1 for t in texts[own]]
            numbers = np.concatenate([[0], words.numbers([different])]).astype(int)[places]
            assert words.ids(numbers).tolist() == [i for w in want for i in ([50_256] if w is None else plain._encode_single_piece(b" " + w))]
        assert at == len(texts)


def small_model():
    rng = np.random.default_rng(0)
    sample = [np.append(rng.integers(0, 30, rng.integers(5, 90)), 49).astype(np.int32) for _ in range(120)]
    flat = np.concatenate(sample)
    unigram = np.bincount(flat, minlength=50)
    layout = attention.Layout(unigram)
    before = attention.previous(flat, 49, 50)
    pairs = np.bincount(layout.cells(before, flat), minlength=layout.n_rows * layout.width)
    model = attention.Attention(layout, unigram, pairs.reshape(layout.n_rows, layout.width).astype(np.float32))
    x, y = attention.training_windows(flat, 49, layout.begin)
    by = attention.Adam(model, 0.01)
    for i in range(0, len(x), 32):
        by.step(x[i : i + 32], y[i : i + 32])
    model.set(model.p)
    return model, sample


def slow_score(model, doc):
    """Each token by itself: attention over the ids that its window shows, one position after the other."""
    past, total = attention.SCORED, 0.0
    shown = [model.begin, *doc[:-1].tolist()]
    for i, target in enumerate(doc.tolist()):
        first = max(0, i // attention.SCORED * attention.SCORED - past)
        row = [int(model.rows[j]) for j in shown[first : i + 1]]
        q, k, v = (model.embedded[row].astype(float) @ model.p["qkv"].astype(float)[:, n * attention.DIM : (n + 1) * attention.DIM] for n in range(3))
        weight = np.array([math.exp(min(60.0, max(-60.0, float(q[-1] @ k[j]))) + float(model.p["r"][len(row) - 1 - j])) for j in range(len(row))])
        logits = model.base[row[-1]] + (weight / weight.sum()) @ v @ model.p["w"]
        c = model.classes[target]
        total += logits[c] - math.log(np.exp(logits).sum()) + model.inside[row[-1], model.columns[target]] + model.extra[target]
    return total / math.log(10)


def test_scores_against_one_token_after_the_other():
    model, sample = small_model()
    assert np.abs(model.p["w"]).max() > 0
    assert np.allclose(lm._text_scores(model, sample[:20]), [slow_score(model, d) for d in sample[:20]], rtol=1e-4)


def test_gradients_against_differences():
    model, sample = small_model()
    x, y = attention.training_windows(np.concatenate(sample[:6]), 49, model.begin)
    grad, _ = model.gradients(x, y)
    rng = np.random.default_rng(4)
    for name in ("qkv", "w", "r"):
        turn = rng.normal(size=model.p[name].shape).astype(np.float32)
        kept, ends = model.p[name], []
        for step in (0.01, -0.01):
            model.p[name] = kept + np.float32(step) * turn
            ends.append(model.gradients(x, y)[1])
        model.p[name] = kept
        assert abs((ends[0] - ends[1]) / 0.02 - float((grad[name] * turn).sum())) < 0.02 * np.abs(grad[name] * turn).sum() + 1e-4


def test_training_windows_hold_every_target_once():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(0, 40, n), 49).astype(np.int32) for n in (0, 1, 30, 31, 32, 33, 200)]
    x, y = attention.training_windows(np.concatenate(docs), 49, 50)
    assert y[y >= 0].tolist() == np.concatenate(docs).tolist()
    assert x[y >= 0].tolist() == [i for d in docs for i in [50, *d[:-1].tolist()]]
    x, y = attention.training_windows(np.array([3, 4, 5]), 49, 50, 7)
    assert x[0, :3].tolist() == [7, 3, 4] and y[0, :3].tolist() == [3, 4, 5] and (y[0, 3:] == -1).all()


def test_probabilities_sum_to_one_and_see_only_the_past():
    model, sample = small_model()
    doc = sample[0][:20]
    for place in (0, 3, 17):
        chance = lambda d, at=place: math.exp(model.log_probabilities(*(attention.windows([d], model.begin)[i] for i in (0, 1, 3)))[attention.SCORED + at])
        p = []
        for j in range(50):
            d = doc.copy()
            d[place] = j
            p.append(chance(d))
        assert abs(sum(p) - 1) < 1e-4
        later = doc.copy()
        later[place + 1 :] = 7
        assert abs(chance(later) - chance(doc)) < 1e-9


def test_every_token_is_scored_once_and_pieces_agree(monkeypatch):
    model, sample = small_model()
    _, target, doc, _ = attention.windows(sample, model.begin)
    assert Counter(doc[target >= 0].tolist()) == {i: len(d) for i, d in enumerate(sample)}
    whole = lm._text_scores(model, sample)
    monkeypatch.setattr(lm, "PIECE", attention.SCORED * 2)
    assert np.allclose(whole, lm._text_scores(model, sample), atol=1e-4)


# Pipeline


def test_stages_keep_the_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    counts = [d.count() for d in seen]
    assert all(d.schema == docs.schema for d in seen[:-1])
    toxic = {r.doc_id for r in queries.op8_toxicity(spark, sf).where("predicted = 1").collect()}
    assert {r.doc_id for r in seen[1].collect()} == {r.doc_id for r in docs.collect()} - toxic
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    kept = {r.doc_id for r in seen[4].collect()}
    packed = seen[5].collect()
    assert {r.doc_id for r in packed} == kept
    whole = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_pipeline_stages_on_odd_and_empty_tables(spark, clashing, no_docs):
    for docs in (clashing, no_docs):
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, DATA)
            assert now.columns == docs.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
        assert {r.doc_id for r in rows} == ({1, 4, 6, 7, 8, None} if docs is clashing else set())


IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"


def slow_redacted(text):
    """Two rounds of replacing all spans, the first of overlapping ones."""
    for _ in range(2):
        spans = [(a, r, b, k) for a, r, b, k in slow_spans(text)]
        for m in re.finditer(IBAN, text):
            c = m[0].replace(" ", "")
            if 15 <= len(c) <= 34 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1:
                spans.append((m.start(), 4, m.end(), "iban"))
        for m in re.finditer(SSN, text):
            if re.search(r"(?i)ssn|social|security|taxpayer", text[max(0, m.start() - 40) : m.start()] + "\n" + text[m.end() : m.end() + 40]):
                spans.append((m.start(), 5, m.end(), "ssn"))
        out, at = [], 0
        for start, _, end, kind in sorted(spans):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        text = "".join(out) + text[at:]
    return text


def test_pipeline_against_brute_force(spark):
    """Every stage done slowly on the rows that the one before it kept."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(docs, labels)
    now = [(r.doc_id, r.text) for r in docs.collect()]
    if model.weights:
        now = [(d, t) for d, t in now if slow_tags(model, t)[0] < 0.7]
    kept = slow_kept(now)
    now = [(d, t) for d, t in now if d in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    known = {w[i : i + n] for _, t in items for w in [tuple(words(t))] for n in [min(10, len(w))] for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in known}
    clean = lambda w: not any(w[i : i + n] in known for n in sizes for i in range(len(w) - n + 1))
    now = [(d, t) for d, t in now if clean(tuple(words(t)))]
    now = [(d, slow_redacted(t)) for d, t in now]
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in now} and len(now) < docs.count()
    check_packing(rows, now)
