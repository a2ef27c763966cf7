"""Series operators by stretches of time against one pass over each key."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import series


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = []
    for k in range(1500):  # key 1 has a third of all events; gaps of days without any
        key = 1 if k % 3 == 0 else r.choice([2, 3, 4, None])
        out.append((k, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=r.choice([r.randint(0, 86400 * 3), 86400 * 20 + r.randint(0, 7000)])), key, "error" if r.random() < 0.8 else "view", r.choice([None, r.random() * 50])))
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(r[2], []).append(r)
    return out


@pytest.mark.parametrize("stretch", [60, 3600, 86_400, 10**9])
def test_moving_average_is_the_recurrence(events, rows, stretch):
    want = {}
    for k, own in by_key(rows).items():
        for r in own:
            if r[4] is not None:
                want[k] = r[4] if k not in want else 0.3 * r[4] + 0.7 * want[k]
    got = {r.user_id: r.ema for r in series.moving_average(events, "user_id", stretch=stretch).collect()}
    assert got == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("stretch", [60, 3600, 86_400, 10**9])
def test_failure_runs_go_over_stretches(events, rows, stretch):
    want = []
    for k, own in by_key(rows).items():
        run = []
        for r in [*own, (None, None, None, "view", None)]:
            if r[3] == "error":
                run.append(r[0])
            elif run:
                want.append((k, min(run), len(run), min(60.0, 10 * 2.0 ** (min(len(run), 10) - 1))))
                run = []
    got = [tuple(r) for r in series.failure_runs(events, "user_id", F.col("event_type") == "error", stretch).collect()]
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r))
    assert order(got) == order(want)


def test_progress_sends_few_events_a_key(events, rows):
    out = series.progress(events, "user_id", 4)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        own = by_key(rows)[r.user_id]
        assert (r.n, r.errors, r.latest, r.recent) == (len(own), sum(x[3] == "error" for x in own), own[-1][3], ",".join(str(x[0]) for x in own[-4:]))
