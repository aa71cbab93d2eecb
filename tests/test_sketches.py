"""Pinned vectors and statistical properties of hashes and sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.functions import hashing, labels
from sentrylake.operators import cms, compare, hll, memory


def test_seeds_and_fmix32_vectors(spark):
    assert [s - (1 << 32) if s >= 1 << 31 else s for s in hashing.seeds(42)] == [-1170105035, 234785527]
    a, b = hashing.seeds(42)
    df = spark.createDataFrame([(k,) for k in (0, 1, 2, 7, 49_999)], "k long").select("k", hashing.fmix32(F.col("k"), a).alias("a"), hashing.fmix32(F.col("k"), b).alias("b"))
    got = {r.k: (r.a, r.b) for r in df.collect()}
    assert [got[k][0] for k in (0, 1, 2, 7, 49_999)] == [3256477277, 1156374041, 1213885204, 1634770344, 36701614]
    assert [got[k][1] for k in (0, 1, 2)] == [2802347019, 2219106434, 2526467083]


def test_splitmix64_against_numpy(spark):
    keys = [0, 1, 2, -1, 2**31, 123_456_789_012]
    got = {r.k: r.h for r in hashing.with_splitmix64(spark.createDataFrame([(k,) for k in keys], "k long"), "k", "h").collect()}
    with np.errstate(over="ignore"):
        for k in keys:
            z = np.int64(k).astype(np.uint64) + np.uint64(hashing.GOLDEN64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(hashing.SPLITMIX[0])
            z = (z ^ (z >> np.uint64(27))) * np.uint64(hashing.SPLITMIX[1])
            assert got[k] == int((z ^ (z >> np.uint64(31))).astype(np.int64))
    assert got[0] & (2**64 - 1) == 0xE220A8397B1DCDAF
    assert got[1] & (2**64 - 1) == 0x910A2DEC89025CC1


def slow_alerts(events, threshold, width, depth=4):
    """The incremental alerts of one sketch, event by event. events: (window_id, source, seq), sources that are not null."""
    a, b = hashing.seeds(42)

    def mixed(key, seed):
        h = (key & hashing.M32) ^ (seed & hashing.M32)
        h = (h ^ h >> 16) * hashing.FMIX[0] & hashing.M32
        h = (h ^ h >> 13) * hashing.FMIX[1] & hashing.M32
        return h ^ h >> 16

    cells, out = {}, set()
    for w, s, _ in sorted(events, key=lambda e: e[2]):
        mine = [(w, i, ((mixed(s, a) + i * (mixed(s, b) | 1)) & 0x7FFFFFFF) % width) for i in range(depth)]
        for c in mine:
            cells[c] = cells.get(c, 0) + 1
        if min(cells[c] for c in mine) >= threshold:
            out.add((width, w, s))
    return out


@pytest.mark.parametrize(("threshold", "widths", "slice_size"), [(6, [64, 128, 1024], 1 << 18), (3, [48, 30, 7], 50), (1, [5], 1), (4, [8 + i for i in range(70)], 300)])
def test_alerts_of_many_widths_against_a_loop(spark, threshold, widths, slice_size):
    rng = np.random.default_rng(4)
    windows = [None, -1, 0, 3]
    events = [(windows[int(w)], int(s), i) for i, (w, s) in enumerate(zip(rng.integers(0, 4, 1_500), rng.zipf(1.3, 1_500) % 400, strict=True))]
    df = spark.createDataFrame(events, "window_id long, source long, seq long")
    want = set().union(*(slow_alerts(events, threshold, w) for w in widths))
    assert {tuple(r) for r in cms.alerts_by_width(df, threshold, widths, 4, 42, slice_size).collect()} == want


def test_false_rates_count_alerts_and_read_no_event_twice_for_a_width(spark):
    """One row goes to the cells of a sketch row, not one for each width; nothing is broadcast."""
    rng = np.random.default_rng(8)
    events = [(int(w), int(s), i) for i, (w, s) in enumerate(zip(rng.integers(0, 3, 2_000), rng.integers(0, 600, 2_000), strict=True))]
    df = spark.createDataFrame([(*e, "LOGIN") for e in [*events, *((0, None, 2_000 + i) for i in range(6))]], "window_id long, source long, seq long, action string")
    exact = {(w, s) for w, s, _ in events if sum(e[:2] == (w, s) for e in events) >= 4}
    widths = [64 << i for i in range(17)]
    found = compare.false_rates(df, 4, widths)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 2  # sketch rows, and widths of the finished rows
    got = {r.width: (r.exact_alerts, r.extra, r.lost) for r in found.collect()}
    assert got == {w: (len(exact) + 1, len(slow_alerts(events, 4, w)) - len(exact), 0) for w in widths}  # and the null source


def draws(spark, n, keys):
    return spark.range(n).select(F.lit(0).cast("long").alias("window_id"), F.pmod(F.xxhash64("id"), F.lit(keys)).alias("source"), F.col("id").alias("seq"))


def test_count_min_never_underestimates_and_wider_is_better(spark):
    errors = {}
    for width in (256, 4096):
        got = cms.estimates(draws(spark, 40_000, 4_000), ["window_id"], "source", width, 4, 42)
        row = got.select(F.min(F.col("estimate") - F.col("n")).alias("low"), F.sum(F.col("estimate") - F.col("n")).alias("e")).first()
        assert row.low >= 0
        errors[width] = row.e
    assert errors[4096] < errors[256]


def test_count_min_without_collisions_and_its_bound(spark):
    one = spark.createDataFrame([(0, 42, i) for i in range(7)], "window_id long, source long, seq long")
    assert cms.estimates(one, ["window_id"], "source", 4096, 5, 42).first().estimate == 7
    width, depth = cms.sizes(0.001, 0.01)
    assert (width, depth) == (2719, 5)
    got = cms.estimates(draws(spark, 50_000, 5_000), ["window_id"], "source", width, depth, 42)
    assert got.where(F.col("estimate") - F.col("n") > 50).count() < 100
    for bad in ((0, 0.1), (1, 0.1), (0.1, 0), (0.1, 1)):
        with pytest.raises(ValueError, match="between"):
            cms.sizes(*bad)
    with pytest.raises(ValueError, match="positive"):
        cms.cells(one, ["window_id"], "source", 0, 4, 42)


def test_incremental_alerts_lie_between_exact_and_close(spark):
    own = draws(spark, 3_000, 500)
    exact = {r.source for r in own.groupBy("source").count().where("count >= 12").collect()}
    near = {r.source for r in cms.incremental_alerts(own, 12, 64, 4, 42).collect()}
    close = {r.source for r in cms.close_alerts(own, 12, 64, 4, 42).collect()}
    assert exact <= near <= close

    # event by event, as a loop
    a, b = hashing.seeds(42)
    keys = own.select("seq", "source", hashing.fmix32(F.col("source"), a).alias("a"), hashing.fmix32(F.col("source"), b).alias("b")).orderBy("seq").collect()
    cells, loop = {}, set()
    for r in keys:
        mine = [(i, ((r.a + i * (r.b | 1)) & 0x7FFFFFFF) % 64) for i in range(4)]
        for c in mine:
            cells[c] = cells.get(c, 0) + 1
        if min(cells[c] for c in mine) >= 12:
            loop.add(r.source)
    assert near == loop
    assert near == {r.source for r in cms.incremental_alerts(own, 12, 64, 4, 42, slice_size=100).collect()}


def values(spark, n):
    return spark.range(n).select(F.lit(1).alias("source"), F.col("id").alias("actor"))


def test_hyperloglog_estimates(spark):
    get = lambda df, p: hll.estimates(df, ["source"], "actor", p).first().estimate
    same = values(spark, 1).unionByName(values(spark, 1))
    assert get(same, 12) == 1
    assert abs(get(values(spark, 50), 12) - 50) <= 2
    for n in (1_000, 20_000, 200_000):
        assert abs(get(values(spark, n), 12) - n) < 4 * 1.04 / 64 * n
    errors = [abs(get(values(spark, 20_000), p) - 20_000) for p in (6, 14)]
    assert errors[1] < errors[0]
    assert hll.estimates(values(spark, 5).where("false"), ["source"], "actor", 8).count() == 0


def test_hyperloglog_keys_are_apart_and_sizes_checked(spark):
    df = values(spark, 30).unionByName(spark.range(3).select(F.lit(2).alias("source"), F.col("id").alias("actor")))
    assert {r.source: r.estimate for r in hll.estimates(df, ["source"], "actor", 14).collect()} == {1: 30, 2: 3}
    assert [hll.precision_for(e) for e in (0.5, 0.065, 0.01, 0.001)] == [4, 8, 14, 16]
    for p in (3, 17):
        with pytest.raises(ValueError, match="precision"):
            hll.check(p)


def test_memory_model(spark):
    ns = [0, 1, 2, 3, 6_144, 6_145, 98_304, 98_305, 786_432, 786_433]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", memory.slots(F.col("n")).alias("s"), memory.exact_count(F.col("n")).alias("b")).collect()
    assert {r.n: r.s for r in got} == {n: memory.slots_of(n) for n in ns}
    assert {r.n: r.b for r in got}[6_144] == 96 << 10
    assert {r.n: r.b for r in got}[6_145] == 192 << 10
    assert memory.space_saving(4096) == 144 << 10
    assert memory.count_min(2048, 4) == 64 << 10


def test_labels(spark):
    cases = {
        "203.0.113.201": "203.0.113.x", "2001:db8:1:2:3:4:5:6": "2001:db8:1::x", "": "unknown", " ": "unknown", "\t": "unknown", None: "unknown",
        "::1": "::1", "::ffff:1.2.3.4": "::ffff::x", "host": "host", "1.2.3.": "1.2.3.x",
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: r.l for r in df.select("a", labels.masked(F.col("a")).alias("l")).collect()} == cases
    ids = spark.range(5_000).select(labels.synthetic(F.col("id")).alias("l"))
    assert ids.distinct().count() == 5_000
    assert spark.range(1).select(labels.synthetic(F.lit(65_536 + 255)).alias("l")).first().l == "198.19.0.256"
    sizes = {0: "0", 512: "512 B", 2048: "2 KB", 2100: "2.1 KB", 200_000: "195 KB", 3 << 20: "3 MB", 3_500_000: "3.3 MB"}
    shown = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", labels.readable_bytes(F.col("n")).alias("t"), labels.chart_ceiling(F.col("n")).alias("c"))
    got = shown.collect()
    assert {r.n: r.t for r in got} == sizes
    assert {r.n: r.c for r in got}[200_000] == 200 * 1024 and {r.n: r.c for r in got}[0] == 1024
    shown = spark.createDataFrame([(0, 5), (1, 4), (10, 4)], "s long, e long").select(memory.ratio(F.col("s"), F.col("e")).alias("t"))
    assert [r.t for r in shown.collect()] == [None, 0.25, 2.5]
