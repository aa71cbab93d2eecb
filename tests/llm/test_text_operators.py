"""Operators on texts against brute force, and their defined results for odd rows."""

import hashlib
import re
import zlib
from collections import Counter
from functools import partial
from pathlib import Path

import numpy as np
import pytest
import xxhash
from llm_cases import CLASHES, DATA, ODD
from pyspark.sql import functions as F

from sentrylake.llm import decontaminate, graph, licenses, pii, queries, reshard, simhash, toxicity
from sentrylake.llm.common import word_runs


def docs_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


# SimHash


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if ones[i] * 2 > len(shingles))


def slow_components(prints):
    """prints: list of (doc_id, fingerprint)."""
    root = {p: p for _, p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    keys = list(root)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return [(d, f"{p:016x}", least.get(find(p))) for d, p in prints]


def by_text(rows):
    return sorted(rows, key=str)


def test_op6_against_brute_force(spark):
    want = slow_components([(d, slow_print(t)) for d, t in docs_of(spark)])
    assert by_text(map(tuple, queries.op6_simhash_near_dedup(spark, DATA).collect())) == by_text(want)


def test_simhash_odd_rows(spark, clashing, no_docs):
    want = slow_components([(x[0], slow_print(x[1])) for x in ODD])
    assert by_text(map(tuple, simhash.near_duplicates(clashing).collect())) == by_text(want)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({w[2] for w in want if w[2] is not None})
    assert sum(r.doc_id is None for r in kept.collect()) == 1


def test_no_link_between_different_fingerprints_is_lost(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(-(2**63), 2**63 - 1, 60).tolist()
    prints = set(base)
    for b in base:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 4), replace=False).tolist()
            prints.add((b ^ sum(1 << f for f in flips) & (2**64 - 1)) if b >= 0 else ~((~b) ^ sum(1 << f for f in flips)))
    prints = [((p + 2**63) % 2**64) - 2**63 for p in prints]
    want = {(max(a, b), min(a, b)) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [1, 7, 50, 1000])
def test_long_texts_in_runs_have_the_same_fingerprint(monkeypatch, limit):
    text = " ".join(f"w{i * i % 977}" + "\n\t " * (i % 3) for i in range(3_000)).encode()
    assert [w for run in word_runs(text, limit) for w in run] == text.lower().split()
    whole = simhash.fingerprint(text)
    assert whole == (slow_print(text.decode()) + 2**63) % 2**64 - 2**63
    monkeypatch.setattr(simhash, "_LONG", 3)
    monkeypatch.setattr(simhash, "word_runs", partial(word_runs, limit=limit))
    assert simhash.fingerprint(text) == whole
    for few in (b"One  two", b"one", b" \n   "):
        assert simhash.fingerprint(few) == (slow_print(few.decode()) + 2**63) % 2**64 - 2**63


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.u: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 130)} | {201: 200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Decontamination


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        n = min(10, len(own))
        for i in range(len(own) - n + 1) if n and item is not None else ():
            for s in range(len(w) - n + 1):
                if w[s : s + n] == own[i : i + n]:
                    hit |= set(range(s, s + n))
                    found.add(item)
    return len(w), len(hit), len(found), decontaminate.digest_of_items(list(found)), bool(hit)


def test_op7_against_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    known = {}
    for i, t in items:
        own = words(t)
        n = min(10, len(own))
        for k in range(len(own) - n + 1):
            known.setdefault(tuple(own[k : k + n]), set()).add(i)
    lengths = {len(k) for k in known}
    want = []
    for d, t in docs_of(spark):
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                owners = known.get(tuple(w[s : s + n]))
                if owners:
                    hit |= set(range(s, s + n))
                    found |= owners
        want.append((d, len(w), len(hit), len(found), decontaminate.digest_of_items(list(found)), bool(hit)))
    assert any(x[-1] for x in want)
    assert sorted(map(tuple, queries.op7_benchmark_decontamination(spark, DATA).collect())) == sorted(want)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_odd_rows(spark, clashing, no_docs, block_bytes, monkeypatch):
    items = [(1, "ONE, two three!"), (2, None), (3, ""), (4, "x one two three four five six seven eight nine ten eleven y"), (5, "Été"), (5, "eleven"), (None, "one")] + [(i, "one two three") for i in range(10, 30)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    monkeypatch.setattr(decontaminate.find_contamination, "__defaults__", ("text", block_bytes))
    monkeypatch.setattr(decontaminate, "MANY", 1 if block_bytes == 300 else 10_000)
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 400)
    got = decontaminate.contamination_report(clashing, bench).collect()
    want = [(x[0], *slow_hits(x[1], items)) for x in ODD]
    assert by_text(map(tuple, got)) == by_text(want)
    left = decontaminate.drop_contaminated(clashing, bench)
    assert left.columns == clashing.columns
    assert by_text(r.doc_id for r in left.collect()) == by_text(w[0] for w in want if not w[-1])
    assert decontaminate.contamination_report(no_docs, bench).count() == 0
    assert decontaminate.contamination_report(clashing, bench.limit(0)).where("contaminated").count() == 0


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PII_CASES = [
    "mail a.b+c@d-e.co.uk, x@y, foo@bar@baz.com a@b.c+x@y.z", "ip 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111",
    "call +49 (30) 123-45678. or +1 2 +123456789012345678 +1-", "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001", "my ssn 123-45-6789; number 123-45-6789 666-12-3456", "é😀 a@b.de 😀 10.0.0.1 4111 1111 1111 1111",
    "9" * 5_000 + "@" + "a" * 3_000 + "." * 9, "1 1 " * 3_000, "a@b" + ".c" * 20_000, "+" * 2_000 + "1" + "(" * 2_000, None, "",
]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def slow_spans(text):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def pii_row(d, text):
    s = slow_spans(text)
    n = Counter(x[3] for x in s)
    return (d, *(n[k] for k in BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest())


def test_op2_against_brute_force(spark):
    got = queries.op2_pii(spark, DATA).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(pii_row(*x) for x in docs_of(spark))


def test_pii_cases(spark, clashing, no_docs):
    df = spark.createDataFrame(list(enumerate(PII_CASES)), "doc_id long, text string")
    got = pii.report(df).orderBy("doc_id").collect()
    assert [tuple(r)[:6] for r in got] == [pii_row(i, t) for i, t in enumerate(PII_CASES)]
    assert "iban:5:32" in got[4].spans and got[4].n_iban == 1
    assert got[5].spans == "ssn:7:18,ssn:27:38"  # a context word within 40 code points of both
    assert by_text(tuple(r)[:6] for r in pii.report(clashing).collect()) == by_text(pii_row(*x[:2]) for x in ODD)
    assert pii.report(no_docs).count() == 0


def test_scores_by_checksum_and_context_on_both_sides(spark):
    texts = ["123-45-6789 is my social number", "123-45-6789" + " " * 41 + "social", "social" + " " * 41 + "123-45-6789", "a@b.de 4111 1111 1111 1111 x@y.org credit", "123-45-6789 1 2 123-45-6788 3 ssn", "10.0.0.1 10.0.0.2 host"]
    got = [(r.spans, r.scores) for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [("ssn:0:11", "0.6"), ("", ""), ("", ""), ("email:0:6,card:7:26,email:27:34", "0.8,1.0,0.8"), ("ssn:0:11,ssn:16:27", "0.6,0.6"), ("ip:0:8,ip:9:17", "0.9,0.9")]


def test_texts_with_very_many_spans(spark):
    text = " ".join(f"é {i} u{i}@ex.com 10.0.{i % 300}.1" for i in range(5_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(pii.report(df).first())[:6] == pii_row(1, text)
    out, at = [], 0
    for start, rank, end, kind in slow_spans(text):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    assert pii.redact(df).first().text == "".join(out) + text[at:]


def test_redaction(spark, clashing, no_docs):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(PII_CASES)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[0].text.startswith("mail [EMAIL], x@y, foo@[EMAIL]")
    assert got[6].text == "é😀 [EMAIL] 😀 [IP] [CARD]"
    assert got[11].text is None and got[12].text == ""
    for i in (0, 1, 2, 4, 6):
        assert not slow_spans(got[i].text) and got[i].n_chars == len(got[i].text)
    same = pii.redact(clashing)
    assert same.columns == clashing.columns
    assert by_text(map(tuple, same.select("doc_id", "text").collect())) == by_text(x[:2] for x in ODD)
    assert pii.redact(no_docs).count() == 0


# Toxicity


def test_op8_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, sf).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    fold = [(truth[d], got[d].predicted) for d in truth if got[d].held_out]
    hit = sum(a and b for a, b in fold)
    assert hit / sum(a for a, _ in fold) > 0.85
    assert hit / sum(b for _, b in fold) > 0.95


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    weights = {b"=bad": 3.0, b"=vile": 1.5}
    trans = np.array([[1.0, 0.4], [0.5, 2.0]])
    model = toxicity.Model(weights, -2.0, trans, np.zeros(0))
    for _ in range(20):
        text = [[b"bad", b"vile", b"so", b"it"][i] for i in rng.integers(0, 4, 8)]
        marks = model.marked(text)
        total, toxic = 0.0, np.zeros(8)
        for code in range(256):
            y = [code >> i & 1 for i in range(8)]
            score = 1.0
            for i, w in enumerate(text):
                if i:
                    score *= trans[y[i - 1], y[i]]
                if y[i]:
                    score *= np.exp(-2.0 + weights.get(b"=" + w, 0.0))
            total += score
            toxic += score * np.array(y)
        got = model.marginals(marks, 8)
        assert np.allclose(got, [toxic[at] / total for at, _ in marks], atol=1e-6)


def test_toxicity_odd_rows(spark, clashing, no_docs):
    labels = spark.createDataFrame([(4, 1), (None, 1), (2, None), (6, 0), (6, 1)], "doc_id long, toxic int")
    rows = toxicity.report(clashing, labels).collect()
    assert len(rows) == len(ODD) and all(r.score == 0.0 and r.predicted == 0 and r.spans == "" for r in rows)
    assert toxicity.report(no_docs, labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(clashing, labels).columns == clashing.columns
    assert toxicity.drop_toxic(clashing, labels).count() == len(ODD)


def test_toxic_spans_are_code_point_offsets(spark):
    model = toxicity.Model({b"=idiot": 9.0}, -3.0, np.array([[1.0, 0.3], [0.5, 1.0]]), np.array([-4.0, 4.0, 4.0]))
    df = spark.createDataFrame([(1, "é😀 Idiot, and idiot!"), (2, "fine")], "doc_id long, text string")
    got = {r.doc_id: list(r._spans) for r in toxicity.tag(df, model, ["doc_id"]).collect()}
    text = "é😀 Idiot, and idiot!"
    assert [text[a:b] for a, b in zip(got[1][::2], got[1][1::2], strict=True)] == ["Idiot", "idiot"]
    assert got[2] == []


def slow_tags(model, text):
    """Score and spans of a text: forward-backward over every token, one after the other."""
    low = "".join(c if "a" <= c <= "z" or c.isdecimal() and c < "\x80" or c >= "\x80" else chr(ord(c) + 32) if "A" <= c <= "Z" else " " for c in text or "")
    tokens = [(m[0].encode(), m.start(), m.end()) for m in re.finditer("[^ ]+", low)]
    weights = [[model.weights[f] for f in toxicity.features(w) if f in model.weights] for w, _, _ in tokens]
    e = [np.array([1.0, np.exp(min(sum(w) + model.bias, 30.0))]) for w in weights]
    forward, backward = [], [np.ones(2)]
    for i, x in enumerate(e):
        v = x if i == 0 else (forward[-1] @ model.trans) * x
        forward.append(v / v.sum())
    for x in e[:0:-1]:
        v = model.trans @ (x * backward[-1])
        backward.append(v / v.sum())
    p = [(a * b / (a * b).sum())[1] for a, b in zip(forward, backward[::-1], strict=False)]
    most, top = {}, 0.0
    for (w, _, _), own, x in zip(tokens, weights, p, strict=True):
        if own:
            most[w], top = max(x, most.get(w, 0.0)), max(x, top)
    z = model.logistic @ np.array([1.0, np.log1p(sum(most.values())), top])
    spans = [f"{a}:{b}" for (_, a, b), own, x in zip(tokens, weights, p, strict=True) if own and x >= 0.5]
    return 1 / (1 + np.exp(-z)), ",".join(spans)


def test_scores_and_spans_against_every_token(spark, clashing):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    assert model.weights
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.report(docs, labels).collect():
        score, spans = slow_tags(model, texts[r.doc_id])
        assert abs(r.score - score) < 1e-6 and r.spans == spans
    own = toxicity.Model({b"=one": 4.0, b"=word": 2.0, b"^tim": 3.0}, -3.0, np.array([[1.0, 0.3], [0.5, 1.5]]), np.array([-4.0, 3.0, 3.0]))
    got = [(r._score, ",".join(f"{a}:{b}" for a, b in zip(r._spans[::2], r._spans[1::2], strict=True))) for r in toxicity.tag(clashing, own, ["doc_id"]).collect()]
    want = [slow_tags(own, x[1]) for x in ODD]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert abs(a[0] - b[0]) < 1e-6 and a[1] == b[1]
    assert any(s for _, s in got)


def test_segments_are_all_counted_and_weigh_as_many():
    index = {b"=bad": 0, b"=vile": 1}
    docs = [b"so bad it is " * 30, b"fine words here " * 40, b"bad", b"vile and bad " * 9, b""]
    found = toxicity._segments(docs, [1, 0, 0, 1, 0], index)
    assert sum(found.values()) == sum(-(-len(d.split()) // toxicity.SEGMENT) for d in docs)
    assert max(found.values()) > 1
    weights, bias, trans = toxicity.fit_field(found, 2)
    listed = [k for k, n in found.items() for _ in range(n)]
    same = {(tuple(s), t, i): 1 for i, (s, t) in enumerate(listed)}

    class Rows(dict):
        """Every stretch as a row of its own."""

        def __iter__(self):
            return ((s, t) for s, t, _ in self.keys())

    each = toxicity.fit_field(Rows(same), 2)
    assert np.allclose(weights, each[0]) and np.isclose(bias, each[1]) and np.allclose(trans, each[2])


def test_long_labelled_texts_teach_by_stretches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 400)
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.extend(zip(texts, toxic, strict=True)))
    long = " ".join(f"w{i:04d}" for i in range(500))
    held = [d for d in range(40) if zlib.crc32(str(d).encode()) % 3 != 1][:2]
    toxicity.train(spark.createDataFrame([(held[0], long), (held[1], "short one")], "doc_id long, text string"), spark.createDataFrame([(d, 1) for d in held], "doc_id long, toxic int"))
    got = sorted(t for t, _ in seen)
    assert got[0] == b"short one" and len(got[1]) == 404
    assert got[1].startswith(b"w0000 w0001") and got[1].endswith(b"w0499 ") and b"w0170" in got[1]


# Resharding


def check_shards(rows, docs, shards=40):
    sizes, slots, texts = Counter(), {}, {}
    assert len(rows) == len(docs)
    assert by_text((r.doc_id, r.size, r.text_crc32) for r in rows) == by_text((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        texts.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, texts


def test_op5_sizes_and_slots(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sizes, _ = check_shards(queries.op5_flow_resharding(spark, "/root/testdata/sf0.01").collect(), docs)
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean


def test_resharding_odd_rows(spark, clashing, no_docs):
    check_shards(reshard.report(spark, clashing).collect(), [x[:2] for x in ODD])
    assert reshard.report(spark, no_docs).count() == 0


def test_equal_texts_stay_together_unless_they_fill_a_shard(spark):
    docs = [(i, f"text {i % 700} " * 20) for i in range(3_000)] + [(10_000 + i, "hot") for i in range(9_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sizes, texts = check_shards(reshard.report(spark, df).collect(), docs)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    assert sum(len(s) > 1 for s in texts.values()) == 1


def test_a_cold_text_in_the_bucket_of_a_hot_one_stays_together(spark):
    hot = "hot text"
    bucket = lambda texts: [(r.t, r.b) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", reshard._bucket(F.xxhash64("t")).alias("b")).collect()]
    own = bucket([hot])[0][1]
    cold = next(t for t, b in bucket([f"cold {i}" for i in range(200_000)]) if b == own)
    docs = [(1, hot)] * 3_000 + [(i, hot) for i in range(3_000)] + [(i, cold) for i in range(30)] + [(i, f"text {i % 70} " * 20) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sizes, texts = check_shards(reshard.report(spark, df).collect(), docs)
    assert len(texts[zlib.crc32(hot.encode())]) > 20
    assert all(len(s) == 1 for t, s in texts.items() if t != zlib.crc32(hot.encode()))
    assert max(sizes.values()) < 1.2 * min(sizes.values())


def test_only_shards_that_change_are_written(spark, clashing, tmp_path):
    """Four shards of a layout on disk, one of them far too large: the shards that have what they should keep their files."""
    docs = [(i, f"text number {i} " * 4) for i in range(4_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old = reshard.write_layout(df, f"file://{tmp_path}/old", 4)
    sizes = {r["shard"]: r["n"] for r in old.rows(spark).groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    weights = [sizes[0] - 20_000, sizes[1], sizes[2], sizes[3] + 20_000]
    new, changed = reshard.reshard(spark, old, f"file://{tmp_path}/new", weights=weights)
    assert changed == {0, 3}
    assert {p.name for p in (tmp_path / "new").glob("shard=*")} == {"shard=0", "shard=3"}
    rows = new.numbered(spark).select("row.doc_id", "row.text", "size", "shard", "slot").collect()
    assert sorted((r.doc_id, r.text) for r in rows) == docs
    for shard in range(4):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
        assert abs(sum(r["size"] for r in rows if r.shard == shard) - weights[shard]) < 200
    before = {(r.row.doc_id, r.slot) for r in old.numbered(spark).where("shard IN (1, 2)").collect()}
    assert before == {(r.doc_id, r.slot) for r in rows if r.shard in (1, 2)}
    fewer, _ = reshard.reshard(spark, new, f"file://{tmp_path}/fewer", 2)
    assert sorted(r.row.doc_id for r in fewer.numbered(spark).collect()) == [d for d, _ in docs]
    assert {r.shard for r in fewer.numbered(spark).select("shard").distinct().collect()} == {0, 1}
    odd = reshard.write_layout(clashing, f"file://{tmp_path}/odd", 3)
    assert by_text(tuple(r.row) for r in odd.numbered(spark).collect()) == by_text(map(tuple, clashing.collect()))


def test_scattered_equal_texts_meet(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(2_000)], "doc_id long, text string")
    old = reshard.write_layout(df, f"file://{tmp_path}/old", 3)
    moved = old.rows(spark).select("h", "size", "row", (F.col("row.doc_id") % 3).cast("int").alias("shard"))
    reshard._write(moved, f"file://{tmp_path}/mixed")
    new, _ = reshard.reshard(spark, reshard.Layout({f"file://{tmp_path}/mixed": [0, 1, 2]}, old.schema), f"file://{tmp_path}/new", 3)
    rows = new.numbered(spark).collect()
    assert len(rows) == 2_000 and len({(r.row.text, r.shard) for r in rows}) == 40


def test_flow_prefers_the_same_rack():
    assert reshard.transfers([9, 1, 1, 1, 1], [5, 1, 2, 1, 4]) == {(0, 2): 1, (0, 4): 3}
    assert reshard.transfers([6, 0, 0, 0], [2, 2, 0, 2], lambda i: i // 2) == {(0, 1): 2, (0, 3): 2}
    assert reshard.transfers([4, 4, 0, 0], [2, 2, 2, 2], lambda i: i % 2) == {(0, 2): 2, (1, 3): 2}


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(2)
    for _ in range(30):
        old = rng.integers(0, 50, 6).tolist()
        new = [sum(old) // 8 + (j < sum(old) % 8) for j in range(8)]
        moves = reshard.transfers(old, new)
        assert sum(moves.values()) == sum(max(0, o - n) for o, n in zip(old, new, strict=False))
        for j, n in enumerate(new):
            kept = old[j] - sum(f for (i, _), f in moves.items() if i == j) if j < 6 else 0
            assert kept + sum(f for (_, b), f in moves.items() if b == j) == n


# Licences


def test_license_cases(spark, clashing, no_docs):
    cases = {
        "Released under the MIT Licence": ("MIT", "MIT"),
        "Copyright (c) 2020 Someone\n\nReleased under the  *MIT* license!": ("MIT", "MIT"),
        "story\n  licensed under CC BY-NC 4.0\nRELEASED UNDER THE MIT LICENSE.\nmore": (None, "CC-BY-NC-4.0,MIT"),
        "Released under the MIT License and more": (None, ""),
        "# Copyright (c) 2020 Jane Doe\n# Licensed under the MIT License.": ("MIT", "MIT"),
        " * Copyright Jane Doe\n *\n * SPDX-License-Identifier: GPL-3.0-or-later\n */": ("GPL-3.0", "GPL-3.0"),
        "import x\n\n# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU General Public\n# License as published by the Free Software Foundation, either\n# version 3 of the License, or (at your option) any later\n# version.\n#\n# more": (None, "GPL-3.0"),
        "// The MIT one\n// copyright notice and this\nLicensed under the MIT License.": (None, "MIT"),
        "": (None, ""),
        None: (None, ""),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = licenses.scan(df).orderBy("doc_id").collect()
    assert [(r.license_id, r.part_licenses) for r in got] == list(cases.values())
    rows = licenses.scan(clashing).collect()
    assert by_text(map(tuple, rows)) == by_text((x[0], hashlib.sha256(licenses.canonical_py(x[1] or "").encode()).hexdigest(), None, "") for x in ODD)
    assert licenses.scan(no_docs).count() == 0
    assert len(CLASHES) > 0


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence files on this machine")
def test_entire_texts_are_known(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [Path("/usr/share/common-licenses", f).read_text() for f in files]
    changed = [" * " + t.replace("\n", "\n * ").replace("license", "Licence") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts + changed)), "doc_id long, text string")
    assert [r.license_id for r in licenses.scan(df).orderBy("doc_id").collect()] == [*files.values()] * 2


def test_op9_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(queries.ORACLE["op9_license_scan"]).fetchall()
    got = queries.op9_license_scan(spark, DATA).select("doc_id", "canonical_sha256", "license_id", "part_licenses").collect()
    assert sorted(map(tuple, got)) == sorted(want)
