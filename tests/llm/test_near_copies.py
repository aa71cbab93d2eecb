"""The pipeline's near-duplicate stage: five words, similarity of at least 0.8."""

import re

import pytest

from sentrylake.llm import jaccard, simhash

SCHEMA = "doc_id long, text string"


def slow_set(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_kept(docs):
    sets = list({slow_set(t) for _, t in docs})
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for d, t in docs:
        s = find(root[slow_set(t)])
        least[s] = min(d, least.get(s, d))
    return set(least.values())


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == slow_kept([tuple(r) for r in docs.collect()])


def test_near_copies_beyond_two_bits_are_found(spark):
    words = [f"w{i * i % 1009}" for i in range(120)]
    chain = [(k, " ".join(words[: 120 - 8 * k])) for k in range(6)]  # neighbours only are similar enough
    far = [(10, " ".join(words[:60] + [f"x{i}" for i in range(60)]))]
    bits = [((simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())) & (2**64 - 1)).bit_count() for (_, a), (_, b) in zip(chain, chain[1:], strict=False)]
    assert max(bits) > simhash.RADIUS
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(chain + far, SCHEMA)).collect()} == {0, 10}


@pytest.mark.parametrize("text", ["One two", "a b c d e", "a b c d e f a b c d e", " \n", "", None, "Été " * 400_000 + "end of it all now"])
def test_shingles(text):
    assert len(jaccard.shingles(text.encode() if text is not None else None)) == len(slow_set(text))


def test_a_repeated_doc_id_keeps_a_row_of_each_component(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey")
    kept = simhash.keep_one(spark.createDataFrame([(1, a), (1, b), (2, b), (0, c), (1, c), (3, a), (0, c)], SCHEMA))
    assert sorted(tuple(r) for r in kept.collect()) == [(0, c), (1, a), (1, b)]


def test_the_stage_proposes_by_simhash(spark, monkeypatch):
    """Fingerprints and their pivot tables make pairs of the stage, each within the radius and verified."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    asked, links = [], simhash.links

    def seen(prints):
        asked.append({r.fp for r in prints.collect()})
        return links(prints)

    monkeypatch.setattr(simhash, "links", seen)
    texts = [tuple(r) for r in docs.collect()]
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == slow_kept(texts)
    assert asked == [{simhash.fingerprint(t.encode() if t else None) for _, t in texts}]


def test_proposed_pairs_against_brute_force(spark):
    base = 0x0123456789ABCDEF
    prints = [(10, base), (11, base), (12, base), (20, base ^ 0b11), (21, base ^ 0b11), (30, base ^ 0b1111), (40, base ^ 0b11111111), (41, -1)]
    got = {tuple(sorted(r)) for r in simhash.proposed(spark.createDataFrame(prints, "sid long, fp long")).collect()}
    assert got == {(10, 11), (10, 12), (20, 21), (10, 20), (20, 30)}
