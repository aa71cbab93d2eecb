import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import DATA, ODD, SCHEMA
from tokenizers import Tokenizer

from sentrylake.llm import packing, queries, tokenstore
from sentrylake.llm.common import tokenizer_path
from sentrylake.llm.encode import Encoder


@cache
def encoder(name, words):
    return Encoder(tokenizer_path(name), 2, words)


@cache
def whole(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


NAMES = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]


@pytest.mark.parametrize(("name", "words"), NAMES)
def test_chunks_give_the_ids_of_the_whole_text(spark, name, words):
    own, ref = encoder(name, words), whole(name)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [x[1] for x in ODD]
    for text in texts:
        got = np.frombuffer(own.ids(text.encode() if text else None), "<u4").tolist()
        assert got == [*ref(text), 2]


@pytest.mark.parametrize(("name", "words"), NAMES)
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB9'st \n\t\r. 　́éΣ\x1c "), max_size=40))
def test_any_white_space(name, words, text):
    own, ref = encoder(name, words), whole(name)
    assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == [*ref(text), 2]


@pytest.mark.parametrize(("name", "words"), NAMES)
@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|> b", "<|startoftext|>a<|endoftext|>", "x<|endoftext|><|endoftext|>", "A <|ENDOFTEXT|> b", "<|endoftext|>\u3000Σ it's", "<|endoftext", "\n <|startoftext|> \t"])
def test_strings_of_added_tokens(name, words, text):
    assert np.frombuffer(encoder(name, words).ids(text.encode()), "<u4").tolist() == [*whole(name)(text), 2]


def expected_store(rows):
    ref, at, out = whole("word_bpe_49k.json"), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*ref(text), 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_op3_against_the_tokenizer(spark):
    got = sorted(tuple(r) for r in queries.op3_token_store(spark, DATA).collect())
    assert got == expected_store([(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])


def test_store_with_odd_rows_small_shards_and_keyed_access(spark, odd, tmp_path):
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(odd, path, tokenizer_path("word_bpe_49k.json"), shard_bytes=64)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in tokenstore.report(spark, path).collect()), key=key)
    assert got == sorted(expected_store([x[:2] for x in ODD]), key=key)
    ref = whole("word_bpe_49k.json")
    found = sorted((r.doc_id, list(r.ids)) for r in tokenstore.fetch(spark, path, [4, 5, 99, 8]).collect())
    assert found == sorted((x[0], [*ref(x[1]), 2]) for x in ODD if x[0] in (4, 5, 8))


def test_the_index_leads_to_every_document(spark, tmp_path, monkeypatch):
    """Many shards and buckets, a doc_id in several shards, absent keys, clashing columns, a shard of empty texts alone."""
    monkeypatch.setattr(tokenstore, "BUCKET", 50)
    monkeypatch.setattr(tokenstore, "RUN", 8)
    docs = [(i, f"text number {i} " * (i % 7)) for i in range(600)] + [(77, f"again {i}") for i in range(40)] + [(None, "no id"), (1_000, ""), (1_001, None), (1_002, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'mine' AS part", "1 AS body", "2 AS seq", "3 AS keys")
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(df, path, tokenizer_path("word_bpe_49k.json"), shard_bytes=200)
    assert spark.read.parquet(f"{path}/index").count() > 5
    ref = whole("word_bpe_49k.json")
    asked = [77, 0, 599, 1_000, 1_002, 5_000, -1]
    got = sorted((r.doc_id, list(r.ids)) for r in tokenstore.fetch(spark, path, asked).collect())
    assert got == sorted((d, [*ref(t), 2]) for d, t in docs if d in asked)
    assert len({(p, q) for d, p, q, _, _ in tokenstore.locate(spark, path, [77])}) > 1
    rows = [tuple(r) for r in tokenstore.report(spark, path).collect()]
    assert sorted((r[0], r[2], r[3]) for r in rows if r[0] is not None) == sorted((r[0], r[2], r[3]) for r in expected_store(docs) if r[0] is not None)
    assert sorted(rows, key=lambda r: r[1])[-1][1] + 1 == sum(r[2] for r in rows) and len(rows) == len(docs)


def test_empty_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(spark.createDataFrame([], SCHEMA), path, tokenizer_path("word_bpe_49k.json"))
    assert tokenstore.report(spark, path).count() == 0
    assert tokenstore.fetch(spark, path, [1]).count() == 0


def test_hash_index_is_minimal_and_perfect():
    keys = tokenstore.hashed(np.arange(-5_000, 20_000), np.zeros(25_000, bool), np.zeros(25_000, np.int64))
    index = tokenstore.HashIndex.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(25_000))


def check_packing(rows, docs, name="byte_bpe_50k.json"):
    """Every token once, no sequence over 1024, offsets gapless, pieces cut as stated; few sequences."""
    ref, by_doc, by_seq = whole(name), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    tokens = 0
    for doc, text in docs:
        ids = np.array([*ref(text), 2], "<u4")
        n = len(ids)
        tokens += n
        first = n % 1024 or min(n, 1024)
        cuts = [0, *range(first, n + 1, 1024)]
        want = [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc])
        assert sorted(set(got)) == want
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_seq), -(-tokens // 1024)


def test_op4_against_the_tokenizer(spark):
    rows = queries.op4_best_fit_packing(spark, DATA).collect()
    used, least = check_packing(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])
    assert used <= least * 1.02 + 1


def test_packing_odd_and_clashing_rows(spark, clashing):
    rows = packing.pack(clashing, tokenizer_path("byte_bpe_50k.json")).collect()
    check_packing(rows, {x[0]: x[:2] for x in ODD}.values())
    assert sum(r.doc_id == 5 for r in rows) == 2
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
def test_plans_place_every_piece_once(counts):
    plan = packing.Plan(counts, size=64, small=21, groups=6)
    seen, rooms = {}, []
    for m, room, slots in plan.runs:
        rooms.append((m, room))
        assert room == 64 - sum(n for n, _ in slots) >= 0
        for n, first in slots:
            seen.setdefault(n, []).extend(range(first, first + m))
    assert {n: sorted(x) for n, x in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
    bins = []  # plain best fit, one piece after the other
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        room = min((r for r in bins if r >= n), default=None)
        if room is not None:
            bins.remove(room)
        bins.append((64 if room is None else room) - n)
    assert sum(m for m, _ in rooms) <= len(bins) * 1.05 + 2
