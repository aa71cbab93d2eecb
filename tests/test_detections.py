"""Scenarios and properties of the detections, on small events made here."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sentrylake.functions.windows import with_window
from sentrylake.operators import compare, dictionary, exact, partitioning, space_saving
from sentrylake.plans import engine, queries
from sentrylake.schema import Sketches, Thresholds
from sentrylake.sources import capture

SCHEMA = "seq long, ts_ms long, source long, actor long, action string, outcome string"
T = Thresholds(60_000, 5, 3, 2)


def events(spark, rows):
    return spark.createDataFrame([(i, *r, "UNKNOWN") for i, r in enumerate(rows)], SCHEMA)


def found(spark, rows, kind, t=T, impl="exact"):
    return sorted((r.key, r.window_id) for r in engine.alerts(events(spark, rows), t, impl).where(F.col("type") == kind).collect())


@pytest.mark.parametrize("impl", ["exact", "sketch"])
def test_a_burst_alerts_once(spark, impl):
    assert found(spark, [(1000, 7, 100, "LOGIN")] * 20, "BRUTE_FORCE", impl=impl) == [(7, 0)]


def test_only_logins_count(spark):
    assert found(spark, [(1000, 7, None, "COMMAND")] * 20, "BRUTE_FORCE") == []


def test_distinct_users_not_attempts(spark):
    assert found(spark, [(1000, 7, 100, "LOGIN")] * 20, "USER_ENUMERATION") == []
    assert found(spark, [(1000, 7, i, "LOGIN") for i in range(20)], "USER_ENUMERATION") == [(7, 0)]


def test_each_window_starts_anew(spark):
    rows = [(1000, 7, 1, "LOGIN")] * 20 + [(90_000, 7, 1, "LOGIN")] * 20
    assert found(spark, rows, "BRUTE_FORCE") == [(7, 0), (7, 1)]


def test_ranking_counts_all_actions_in_order(spark):
    rows = [(0, s, None, "CONNECT") for s, n in ((1, 10), (2, 5), (3, 3)) for _ in range(n)]
    ranked = engine.ranking(events(spark, rows), T).orderBy("rank").collect()
    assert [(r.source, r.n) for r in ranked] == [(1, 10), (2, 5)]


def test_a_missing_source_is_a_source(spark):
    assert found(spark, [(0, None, 1, "LOGIN")] * 6, "BRUTE_FORCE") == [(None, 0)]


def test_windows_round_toward_zero(spark):
    rows = events(spark, [(t, 1, 1, "LOGIN") for t in (-60_000, -59_999, 59_999, 60_000)])
    assert [r.window_id for r in with_window(rows, 60_000).orderBy("seq").collect()] == [-1, 0, 0, 1]


def test_crossing_is_the_event_that_reaches_the_threshold(spark):
    rows = with_window(events(spark, [(0, 1, i % 4, "LOGIN") for i in range(9)]), 60_000)
    assert [r.seq for r in exact.brute_force_crossing(rows, 5).collect()] == [4]
    assert [r.seq for r in exact.user_enumeration_crossing(rows, 3).collect()] == [2]


def test_counter_lookup_and_top_k(spark):
    df = spark.createDataFrame([(1, 4), (1, 3), (2, 9), (3, 2)], "source long, d long")
    table = exact.counts(df, ["source"], F.col("d"))
    keys = spark.createDataFrame([(1,), (5,)], "source long")
    assert sorted((r.source, r.n) for r in exact.lookup(keys, table, ["source"]).collect()) == [(1, 7), (5, 0)]
    assert [r.source for r in exact.global_top_k(table, 2).collect()] == [2, 1]
    assert exact.global_top_k(table, 10).count() == 3
    assert exact.global_top_k(table, -1).count() == 0


def test_distinct_counts_ignore_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, 4), (1, 4), (1, None), (2, 1), (2, 2)], "source long, v long")
    assert sorted((r.source, r.n) for r in exact.distinct_counts(df, ["source"], "v").collect()) == [(1, 1), (2, 2)]


def test_dictionary_gives_ids_by_first_appearance(spark):
    rows = [(i, k) for i, k in enumerate(["b", "a", None, "b", "c", "a"])]
    ids = dictionary.encode(spark.createDataFrame(rows, "seq long, k string"), "k")
    assert {r.k: r.id for r in ids.collect()} == {"b": 0, "a": 1, "c": 2}
    back = dictionary.decode(spark.range(4), ids, "k").orderBy("id").collect()
    assert [r.k for r in back] == ["b", "a", "c", None]


def zipfish(spark, n=4_000):
    return events(spark, [(i * 50, (i * i * 7 + i // 3) % 97 % (1 + i % 40), i % 13, "LOGIN" if i % 5 else "CONNECT") for i in range(n)])


@pytest.mark.parametrize("parts", [2, 4, 8, 16])
def test_partitioned_rankings_equal_the_whole(spark, parts):
    own = with_window(zipfish(spark), 60_000)
    a = sorted(map(tuple, exact.top_attackers(own, 5).collect()))
    b = sorted(map(tuple, partitioning.merged_top_k(own, 5, parts).select("window_id", "source", "n", "rank").collect()))
    assert a == b


def test_no_event_is_lost_and_shares_add_up(spark):
    load = partitioning.load(zipfish(spark), 8).collect()
    assert sum(r.events for r in load) == 4_000
    assert {r.part for r in load} == set(range(8))
    share = partitioning.largest_share(zipfish(spark), 8).first()
    assert share.share == max(r.events for r in load) / 4_000
    with pytest.raises(ValueError, match="power of two"):
        partitioning.load(zipfish(spark), 6)


def test_agreement_and_overlap(spark):
    alert = lambda rows: spark.createDataFrame(rows, "type string, key long, window_id long")
    a = alert([("BRUTE_FORCE", 1, 0), ("BRUTE_FORCE", 2, 0), ("USER_ENUMERATION", None, 0), ("TOP_ATTACKERS", 9, 0)])
    b = alert([("BRUTE_FORCE", 1, 0), ("BRUTE_FORCE", 3, 0), ("USER_ENUMERATION", None, 0)])
    got = {r.type: (r.matched, r.extra, r.missed) for r in compare.agreement(a, b).collect()}
    assert got == {"BRUTE_FORCE": (1, 1, 1), "USER_ENUMERATION": (1, 0, 0)}
    assert {r.tag for r in compare.feed(a, b).collect()} == {"both", "exact_only", "sketch_only"}
    assert compare.feed(a, b, 2).count() == 2
    assert compare.overlap_of([1, 2, 3, 4], [4, 3, 9]) == 0.5
    assert compare.overlap_of([], [1]) == 1.0


def test_sketch_engine_with_room_equals_exact(spark):
    t, s = Thresholds(60_000, 20, 4, 5), Sketches(4096, 4, 42, 14, 512)
    a, b = engine.alerts(zipfish(spark), t), engine.alerts(zipfish(spark), t, "sketch", s)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError, match="impl"):
        engine.alerts(zipfish(spark), t, "other")


def test_space_saving_bounds(spark):
    stream = list(itertools.chain.from_iterable((i, 10_000 + i % 5, i + 50_000) for i in range(3_000)))
    s = space_saving.Summary(64)
    for k in stream:
        s.add(k)
    rows = s.rows()
    true = {k: 600 for k in range(10_000, 10_005)}
    assert len(rows) == 64
    assert {r[0] for r in rows[:5]} == set(true)
    assert all(n >= true.get(k, 1) and n - e >= 1 for k, n, e in rows)
    with pytest.raises(ValueError, match="capacity"):
        space_saving.Summary(0)


def by_heap(stream, capacity):
    """(key, count, error) in the order of a binary min-heap of triples, kept by swaps."""
    heap, where = [], {}

    def swap(a, b):
        heap[a], heap[b] = heap[b], heap[a]
        where[heap[a][2]], where[heap[b][2]] = a, b

    def down(i):
        while 2 * i + 1 < len(heap):
            j = min((c for c in (2 * i + 1, 2 * i + 2) if c < len(heap)), key=lambda c: (heap[c][0], c))
            if heap[i][0] <= heap[j][0]:
                return
            swap(i, j)
            i = j

    for k in stream:
        if k in where:
            heap[where[k]][0] += 1
            down(where[k])
        elif len(heap) < capacity:
            heap.append([1, 0, k])
            i = where[k] = len(heap) - 1
            while i and heap[(i - 1) // 2][0] > heap[i][0]:
                swap(i, (i - 1) // 2)
                i = (i - 1) // 2
        else:
            least, _, old = heap[0]
            del where[old]
            heap[0], where[k] = [least + 1, least, k], 0
            down(0)
    return [(k, n, e) for n, e, k in heap]


@pytest.mark.parametrize("capacity", [1, 4, 7, 64])
def test_space_saving_evicts_in_the_order_of_the_heap(spark, capacity):
    rng = random.Random(5)
    stream = [rng.randrange(5) if i % 4 == 0 else 100 + rng.randrange(500) for i in range(4_000)]
    s = space_saving.Summary(capacity)
    for k in stream:
        s.add(k)
    want = by_heap(stream, capacity)
    assert s.heap == [k for k, _, _ in want]
    assert sorted(s.rows()) == sorted(want)
    few = space_saving.Summary(4)
    for k in range(100):
        few.add(k)
    assert sorted(few.rows()) == [(96, 25, 24), (97, 25, 24), (98, 25, 24), (99, 25, 24)]
    windowed = spark.createDataFrame([(0, i, k) for i, k in enumerate(stream)], "window_id long, seq long, source long")
    assert sorted((r.source, r.n, r.error) for r in space_saving.summaries(windowed, capacity).collect()) == sorted(want)


def test_space_saving_is_exact_below_capacity(spark):
    own = with_window(zipfish(spark), 60_000)
    a = sorted((r.window_id, r.source, r.n) for r in exact.top_attackers(own, 5).collect())
    for parts in (1, 4):
        b = sorted((r.window_id, r.source, r.n) for r in space_saving.top(own, 5, 128, parts).collect())
        assert a == b
    assert space_saving.native(own, ["window_id"], "source", 5, 1000).count() == len(a)


def many_sources(spark):
    """Two windows of 700 and 40 sources, whose counts grow with the source."""
    rows = [(w, k) for w, n in ((0, 700), (1, 40)) for k in range(n) for _ in range(1 + k % 7 + k // 100)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame([(i, w * 60_000, k, 1, "LOGIN", "FAILURE") for i, (w, k) in enumerate(rows)], "seq long, ts_ms long, source long, actor long, action string, outcome string")


def test_space_saving_without_eviction_is_exact_above_capacity(spark):
    own = with_window(many_sources(spark), 60_000)
    parts = space_saving.parts_without_eviction(own, 64)
    assert parts > 8 and space_saving.parts_without_eviction(own, 700) == 1
    want = sorted((r.window_id, r.source, r.n, r["rank"], 0) for r in exact.top_attackers(own, 5).collect())
    assert sorted((r.window_id, r.source, r.n, r["rank"], r.error) for r in space_saving.top(own, 5, 64, parts).collect()) == want
    assert sorted((r.window_id, r.source, r.n, r["rank"], r.error) for r in space_saving.top(own, 5, 64).collect()) != want
    with pytest.raises(ValueError, match="positive"):
        space_saving.parts_without_eviction(own, 0)


def test_sketch_rankings_without_eviction_agree_with_exact_ones(spark):
    ev, small = many_sources(spark), Sketches(capacity=64)
    a, b = engine.ranking(ev, T), engine.ranking(ev, T, "sketch", small, evict=False)
    assert {r.overlap for r in compare.overlap(a, b, ["window_id"]).collect()} == {1.0}
    sides = compare.side_by_side(a, b).collect()
    assert len(sides) == a.count() and all(r.exact_rank == r.sketch_rank and r.exact_n == r.sketch_n for r in sides)


@pytest.mark.parametrize("query", ["space_saving_exact_regime", "topk_overlap", "ranking_side_by_side"])
def test_rankings_of_queries_are_exact_with_more_sources_than_counters(spark, tmp_path, query):
    rows = spark.range(18_000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "IF(id < 9000, id, id DIV 2 * 7 % 9000) AS user_id", "'error' AS event_type", "concat('{\"k\": ', id % 50, '}') AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    want = {r.source: (r["rank"], r.n) for r in exact.top_attackers(with_window(capture.events(spark, str(tmp_path)), queries.DAY), 5).collect()}
    got = queries.QUERIES[query](spark, str(tmp_path)).collect()
    if query == "topk_overlap":
        assert [r.overlap for r in got] == [1.0]
    elif query == "space_saving_exact_regime":
        assert {r.source: (r["rank"], r.n) for r in got} == want and {r.error for r in got} == {0}
    else:
        assert {r.source: (r.sketch_rank, r.sketch_n) for r in got} == {r.source: (r.exact_rank, r.exact_n) for r in got} == want
