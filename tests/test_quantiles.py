"""Percentiles by selection against numpy, with ranges that must be cut more than once."""

import random

import numpy as np
import pytest

from skein.operators import quantiles

WANTED = {"least": 0.0, "low": 0.013, "median": 0.5, "p95": 0.95, "p99": 0.99, "most": 1.0}


@pytest.mark.parametrize("limit", [1, 3, 20, 100_000])
def test_percentiles_match_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "CUTS", 4)
    r = random.Random(1)
    groups = {"one": [5.0], "two": [1.0, 2.0], "ties": [3.0] * 90 + [1.0] * 5 + [9.0] * 5, "steps": [float(r.randint(0, 4)) for _ in range(200)], "many": [r.gauss(0, 1) for _ in range(500)], None: [r.random() for _ in range(70)]}
    rows = [(k, 1, v) for k, own in groups.items() for v in own] + [("one", 1, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, j int, x double").repartition(3)
    got = {r.k: r for r in quantiles.percentiles(df, ["k", "j"], "x", WANTED, limit).collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        assert [got[k][c] for c in WANTED] == pytest.approx(list(np.quantile(own, list(WANTED.values()))), abs=1e-12)


def test_no_buffer_holds_a_group(spark):
    df = spark.createDataFrame([("a", float(k % 1000)) for k in range(3000)], "k string, x double")
    out = quantiles.with_percentiles(df.groupBy("k").count(), df, ["k"], "x", {"p50": 0.5})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and out.first().p50 == 499.5
    assert quantiles.percentiles(df.where("false"), ["k"], "x", {"p": 0.5}).count() == 0
