"""Captures, synthetic events, replay and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sentrylake.functions.windows import with_window
from sentrylake.operators import exact
from sentrylake.plans import engine, queries, report, sizing
from sentrylake.schema import Thresholds
from sentrylake.sources import capture, replay, zipf
from sentrylake.streaming import detect

SMALL = "/root/testdata/sf0.001"


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def test_normalisation(spark, tmp_path):
    lines = [
        {"eventid": "cowrie.login.failed", "src_ip": "192.0.2.77", "username": "pi", "epoch": 1600000000500, "timestamp": "2020-09-13T12:26:41.000000Z"},
        "",
        {"eventid": "cowrie.login.success", "src_ip": "192.0.2.78", "username": "{oracle}", "epoch": 1600000001000.9},
        {"eventid": "cowrie.client.kex", "src_ip": "192.0.2.77", "timestamp": "no time"},
        {"eventid": "cowrie.session.connect", "username": "", "timestamp": "2020-09-13T12:26:42.999999Z"},
        {"eventid": "cowrie.session.file_download.failed", "src_ip": {"a": 1}, "username": None, "epoch": 5},
        {"eventid": "cowrie.session.closed", "src_ip": "", "username": [1], "epoch": 6, "other": [1, 2]},
        {"eventid": "cowrie.command.input", "src_ip": "[x", "username": 17, "epoch": 7},
    ]
    want = [
        (1600000000500, "192.0.2.77", "pi", "LOGIN", "FAILURE"),
        (1600000001000, "192.0.2.78", "{oracle}", "LOGIN", "SUCCESS"),
        (1600000002999, None, None, "CONNECT", "UNKNOWN"),
        (5, None, None, "FILE_TRANSFER", "FAILURE"),
        (6, None, None, "DISCONNECT", "UNKNOWN"),
        (7, "[x", "17", "COMMAND", "UNKNOWN"),
    ]
    (tmp_path / "in").mkdir()
    path = write(tmp_path / "in" / "a.json", lines)
    got = capture.normalize(capture.read_capture(spark, path)).orderBy("seq").drop("seq").collect()
    assert [tuple(r) for r in got] == want
    stream = capture.normalize(capture.stream_capture(spark, str(tmp_path / "in")))
    assert sorted(tuple(r) for r in detect.drain(stream.drop("seq"), "append").collect() if r.source) == sorted(w for w in want if w[1])


def test_bad_lines_and_missing_times_fail(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed"):
        capture.normalize(capture.read_capture(spark, write(tmp_path / "b.json", ['{"eventid": "cowrie.login.failed"', "{}"]))).collect()
    none = write(tmp_path / "c.json", [{"eventid": "cowrie.login.failed"}])
    with pytest.raises(Exception, match="neither epoch nor timestamp"):
        capture.normalize(capture.read_capture(spark, none)).collect()


def test_zipf_goldens(spark):
    df = zipf.zipf_events(spark, 2_000, 100, 0.8, 9, 120_000, 0, 600_000).cache()
    assert [(r.ts_ms, r.source, r.actor) for r in df.orderBy("seq").limit(3).collect()] == [(0, 586, 48), (5, 896, 57), (10, 270, 13)]
    found = {r.type: r.n for r in engine.alerts(df, Thresholds()).groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert found == {"BRUTE_FORCE": 2_172, "USER_ENUMERATION": 4_466, "TOP_ATTACKERS": 200}
    state = {r.type: (r.matched, r.extra, r.missed) for r in report.snapshot(df, Thresholds()).collect()}
    assert state == {"BRUTE_FORCE": (2_172, 0, 0), "USER_ENUMERATION": (4_371, 0, 95)}
    df.unpersist()


def slow_zipf(users, seed, n):
    """(uniform, user) of n events, one draw after the other."""
    state, out = (seed ^ zipf.LCG_A) & zipf.MASK, []

    def draw(bits):
        nonlocal state
        state = (state * zipf.LCG_A + zipf.LCG_C) & zipf.MASK
        return state >> (48 - bits)

    for _ in range(n):
        uniform = ((draw(26) << 27) + draw(27)) / (1 << 53)
        while True:
            bits = draw(31)
            if not users & (users - 1):
                chosen = (users * bits) >> 31
                break
            chosen = bits % users
            if bits - chosen + users - 1 < 1 << 31:
                break
        out.append((uniform, chosen))
    return out


@pytest.mark.parametrize("users", [200, 1 << 16, 700_001])
def test_zipf_draws_against_a_loop(spark, users):
    """With 700,001 users some are drawn again, which moves all later draws."""
    want = slow_zipf(users, 42, 30_000)
    steps = zipf.cumulative(500, 0.8)
    for parts in (1, 7):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(parts))
        got = [(r.source, r.actor) for r in zipf.zipf_events(spark, 500, users, 0.8, 42, 30_000, 0, 1_000).orderBy("seq").collect()]
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        assert got == [(min(int(steps.searchsorted(u)), 499), c) for u, c in want]
    assert (len(zipf.shifts(zipf._again(spark, users, 42, 90_000))) > 3) == (users == 700_001)


def test_sizing_reports(spark, tmp_path):
    """The published rows."""
    rows = [(r["keys"], r.exact_bytes, r.sketch_bytes, r.memory_ratio, r.overlap_pct) for r in sizing.rankings(spark, [1_000, 5_000]).collect()]
    assert rows == [(1_000, 24 << 10, 144 << 10, 6.0, 100.0), (5_000, 96 << 10, 144 << 10, 1.5, 100.0)]
    found = sizing.counters(spark, [1_000])
    replay.write_csv(found, f"file://{tmp_path}/csv")
    r = found.first()
    assert (r.exact_bytes, r.sketch_bytes, round(r.memory_ratio, 2), round(r.false_pct, 2)) == (24 << 10, 64 << 10, 2.67, 1.85)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first()["width"] == "2048"


def test_zipf_shape(spark):
    one = zipf.zipf_events(spark, 500, 50, 1.1, 42, 5_000, 0, 1_000)
    assert one.exceptAll(zipf.zipf_events(spark, 500, 50, 1.1, 42, 5_000, 0, 1_000)).count() == 0
    assert one.exceptAll(zipf.zipf_events(spark, 500, 50, 1.1, 43, 5_000, 0, 1_000)).count() > 0
    heads = zipf.zipf_events(spark, 1_000, 64, 1.2, 3, 20_000, 0, 1).groupBy("source").count()
    assert heads.agg(F.max("count")).first()[0] > 20 * 20
    flat = zipf.zipf_events(spark, 100, 10, 0.0, 5, 20_000, 0, 1).groupBy("source").count()
    assert flat.agg(F.max("count")).first()[0] < 1.5 * 200
    for bad in ((0, 1, 0.5), (1, 0, 0.5), (1, 1, -1.0)):
        with pytest.raises(ValueError, match="must"):
            zipf.zipf_events(spark, *bad, 1, 10, 0, 1)


def test_replay(spark):
    with pytest.raises(ValueError, match="positive"):
        replay.fixed_rate(spark, spark.range(1), 0)
    rows = spark.createDataFrame([(0, 0), (1, 100), (2, 10_100)], "seq long, ts_ms long")
    due = [r.wall_ms for r in replay.scaled_delays(rows, 2.0).orderBy("seq").collect()]
    assert due == [0.0, 50.0, 300.0]
    began = time.time()
    stored = spark.range(20).select(F.col("id").alias("seq"), F.lit(1).alias("v"))
    query = replay.fixed_rate(spark, stored, 10).writeStream.format("memory").queryName("replayed").start()
    while spark.table("replayed").count() < 20 and time.time() - began < 60:
        time.sleep(0.3)
    query.stop()
    assert spark.table("replayed").count() == 20
    assert time.time() - began >= 1.0


def test_streams_equal_batches(spark):
    for name in ("brute_force", "user_enumeration"):
        a = sorted(map(str, queries.QUERIES[name](spark, SMALL).collect()))
        assert sorted(map(str, queries.QUERIES[f"stream_{name}"](spark, SMALL).collect())) == a
    a = sorted(map(str, queries.QUERIES["brute_force_crossing"](spark, SMALL).collect()))
    assert sorted(map(str, queries.QUERIES["stream_crossing_alerts"](spark, SMALL).collect())) == a


def test_stream_over_many_files_alerts_once(spark, tmp_path):
    events = queries.capture.events(spark, SMALL)
    for i in range(4):
        events.where(F.col("seq") % 4 == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = detect.stream_of(spark, f"file://{tmp_path}/in")
    got = detect.drain(detect.crossing_alerts(stream, queries.DAY, 6, "60 days"), "append")
    want = exact.brute_force(with_window(events, queries.DAY), 6)
    assert sorted((r.window_id, r.source) for r in got.collect()) == sorted((r.window_id, r.source) for r in want.collect())


def test_files_in_reverse_order_of_time_lose_nothing(spark, tmp_path):
    events = queries.capture.events(spark, SMALL)
    middle = events.approxQuantile("ts_ms", [0.5], 0.0)[0]
    for later in (True, False):
        events.where((F.col("ts_ms") > middle) == later).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)  # files are taken by the time of their writing
    stream = detect.stream_of(spark, f"file://{tmp_path}/in")
    windowed = with_window(events, queries.DAY)
    counts = detect.drain(detect.activity_counts(stream, queries.DAY, queries.SPAN))
    assert sorted(map(str, exact.top_k(counts, 5, ["window_id"]).collect())) == sorted(map(str, exact.top_attackers(windowed, 5).collect()))
    got = detect.drain(detect.crossing_alerts(stream, queries.DAY, 6, queries.SPAN), "append").collect()
    assert sorted((r.window_id, r.source, r.seq) for r in got) == sorted((r.window_id, r.source, r.seq) for r in exact.brute_force_crossing(windowed, 6).collect())
    users = detect.drain(detect.user_enumeration_sketch(stream, queries.DAY, 5, queries.SPAN)).collect()
    assert sorted((r.window_id, r.source, r.n) for r in users) == sorted((r.window_id, r.source, r.n) for r in exact.user_enumeration(windowed, 5).collect())


def test_rankings_of_closed_windows_are_written(spark, tmp_path):
    """All windows but the last, which no later event closes."""
    stream = queries.capture.from_events(detect.stream_of(spark, f"{SMALL}/events.parquet"))
    query = detect.write_rankings(detect.activity_counts(stream, queries.DAY), 5, f"file://{tmp_path}/out", f"file://{tmp_path}/state", availableNow=True)
    query.awaitTermination()
    assert detect.throughput(query) > 0
    got = sorted((r.window_id, r.source, r.n, r["rank"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    want = sorted((r.window_id, r.source, r.n, r["rank"]) for r in queries.QUERIES["top_attackers"](spark, SMALL).collect())
    assert got == [w for w in want if w[0] < want[-1][0]]


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    replay.write_csv(df, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns == ["x", "y"]
    assert replay.to_json(df).first().json == '{"x":1,"y":"a"}'
