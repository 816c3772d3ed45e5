"""Exact percentiles of groups of any size, against sorting."""

import math
import random

import pytest

from lexspark.operators import analytics


def _plain(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    a, b = v[math.floor(at)], v[math.ceil(at)]
    return v[max(math.ceil(p * len(v)), 1) - 1], pytest.approx(a + (b - a) * (at - math.floor(at)), abs=2e-6)


@pytest.mark.parametrize("p", [0.0, 0.01, 0.5, 0.95, 0.999, 1.0])
def test_percentiles(spark, p):
    rnd = random.Random(7)
    groups = {n: [rnd.choice((rnd.random(), rnd.randrange(5), 10 ** rnd.randrange(9))) for _ in range(n)] for n in (1, 2, 3, 7, 60, 80, 700, 3000, 30_000)}
    groups[-1] = [4.0] * 2000
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [(None, 1.0), (None, 2.0), (5, None)]
    got = {r.k: (r.nearest, r.linear) for r in analytics.percentiles(spark.createDataFrame(rows, "k long, v double").repartition(6), "v", ["k"], p).collect()}
    assert set(got) == {None, *groups}
    for k, own in groups.items():
        assert got[k] == _plain(own, p), k


def test_no_task_gets_a_whole_group(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id % 3 as k", "cast(id * 7919 % 5000 as double) as v")
    got = analytics.percentiles(rows, "v", ["k"], 0.95)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    monkeypatch.setattr(analytics, "FEW_GROUPS", 2)  # more groups than are handed to all tasks
    assert sorted(map(tuple, analytics.percentiles(rows, "v", ["k"], 0.95).collect())) == sorted(map(tuple, got.collect()))
