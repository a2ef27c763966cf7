"""Stateful streams: late and disordered events, timers without input, keys apart."""

import datetime

import pytest
from pyspark.sql import functions as F

from skein.plans import live
from skein.streaming import events, stateful


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


@pytest.fixture
def fed(spark, tmp_path):
    """A stream of some batches of rows (event_id, seconds, user_id, event_type, value), one a file."""

    def feed(*batches):
        stateful.with_store(spark)
        path = f"{tmp_path}/in"
        for rows in batches:
            spark.createDataFrame([(i, at(s), u, t, v, "") for i, s, u, t, v in rows], events.EVENTS).coalesce(1).write.mode("append").parquet(path)
        return events.read_events(spark, path, 1)

    return feed


END = [(-1, 10_000_000, -1, "", 0.0)]


def run(stream, tmp_path):
    return events.run_to_table(stream, f"{tmp_path}/out").collect()


@pytest.mark.parametrize("count_rejected", [False, True])
def test_limits_by_event_time_and_drop_late_calls(fed, tmp_path, count_rejected):
    calls = fed(
        [(1, 0, 1, "a", 0.0), (3, 20, 1, "a", 0.0), (2, 10, 1, "a", 0.0), (9, 0, 2, "a", 0.0), (10, 5, 1, "b", 0.0)],  # in no order
        [(4, 65, 1, "a", 0.0), (5, 75, 1, "a", 0.0), (11, 2000, 3, "c", 0.0)],
        [(7, 1990, 3, "c", 0.0)],
        [(6, 30, 1, "a", 0.0)],  # behind the watermark of 2000 - 600, up to which all has been decided
        END,
    )
    out = stateful.limited(calls.select(F.col("event_type").alias("path"), F.col("user_id").alias("client"), "event_id", "ts"), 2, 60, count_rejected)
    got = {r.event_id: r.allowed for r in run(out, tmp_path)}
    # 1 at 0 and 2 at 10 pass, 3 at 20 doesn't; 4 at 65 meets 2, and 3 if rejected calls count; 5 at 75 meets 4, and 3
    assert got == {1: True, 2: True, 3: False, 4: not count_rejected, 5: not count_rejected, 7: True, 9: True, 10: True, 11: True}


def test_both_limits_in_one_stream(spark, fed, sf_dir, tmp_path):
    """As by two streams; the query reads its events as one."""
    calls = fed([(1, 0, 1, "a", 0.0), (3, 20, 1, "a", 0.0), (2, 10, 1, "a", 0.0)], [(4, 65, 1, "a", 0.0), (5, 75, 1, "a", 0.0), (11, 2000, 3, "c", 0.0)], END)
    out = stateful.limited_both(calls.select(F.col("event_type").alias("path"), F.col("user_id").alias("client"), "event_id", "ts"), 2, 60)
    got = {r.event_id: (r.allowed, r.allowed_of_all) for r in run(out, tmp_path)}
    assert got == {1: (True, True), 2: (True, True), 3: (False, False), 4: (True, False), 5: (True, False), 11: (True, True)}


def test_the_limits_query_runs_one_stream(spark, sf_dir, monkeypatch):
    runs = []
    monkeypatch.setattr(live, "_run", lambda out, run=live._run: runs.append(1) or run(out))
    assert live.stream_limited(spark, sf_dir).columns and len(runs) == 1


def test_leases_are_lost_by_a_timer_without_input(fed, tmp_path):
    stream = fed([(1, 0, 1, "begin", 0.0), (2, 100, 1, "beat", 0.0), (3, 0, 2, "begin", 0.0), (4, 300, 2, "end", 0.0), (5, 50, 3, "beat", 0.0)], [(6, 250, 2, "beat", 0.0), (7, 5000, 4, "begin", 0.0)], END)
    rows = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("kind"))
    got = {(r.key, (r.ended_us - r.began_us) // 1_000_000, r.status) for r in run(stateful.leases(rows, 300, "stale"), tmp_path)}
    assert got == {(1, 400, "stale"), (2, 300, "done"), (4, 300, "stale")}


def test_rings_and_caches_by_event_time(fed, tmp_path):
    stream = fed([(k, 10 * k, 1, "q", float(v)) for k, v in ((3, 5), (1, 9), (2, 1))], [(4, 40, 1, "q", 2.0), (5, 45, 2, "z", float("nan"))], END)
    rings = run(stateful.recent(stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", "value"), 2), tmp_path)
    assert {(r.event_id, r.held, r.highest) for r in rings} == {(1, 1, 9.0), (2, 2, 9.0), (3, 2, 5.0), (4, 2, 5.0), (5, 1, None)}
    hits = run(stateful.cached(stream.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "ts"), 25), f"{tmp_path}/2")
    assert {(r.event_id, r.hit, r.source_id) for r in hits} == {(1, False, 1), (2, True, 1), (3, True, 1), (4, False, 4), (5, False, 5)}


def test_arrival_is_out_of_order_and_whole(spark, sf_dir):
    rows = events.run_to_table(live.arriving(spark, sf_dir).select("event_id", F.input_file_name().alias("f"), "ts"), f"{live.new_path(spark, 'seen')}").collect()
    assert len(rows) == 1 + spark.read.parquet(f"{sf_dir}/events.parquet").count()
    late = [a for a in rows for b in rows[:50] if a.f != b.f]
    assert late


def test_keys_of_one_bucket_stay_apart(fed, tmp_path, monkeypatch):
    """Keys share a piece of state, and a null key is one of them; each has its own events, lease and timer."""
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    stream = fed([(1, 0, 1, "begin", 0.0), (2, 5, None, "begin", 0.0), (3, 200, 1, "beat", 0.0), (4, 0, 2**60 + 1, "begin", 0.0)], [(5, 100, None, "end", 0.0), (6, 5000, 3, "begin", 0.0)], END)
    rows = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("kind"))
    out = stateful.leases(rows, 300)
    assert "bucket" in out._jdf.queryExecution().analyzed().toString()
    got = {(r.key, (r.ended_us - r.began_us) // 1_000_000, r.status) for r in run(out, tmp_path)}
    assert got == {(1, 500, "orphaned"), (None, 95, "done"), (2**60 + 1, 300, "orphaned"), (3, 300, "orphaned")}
