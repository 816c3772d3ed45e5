"""Centroid clustering against a plain version that measures every distance."""

import hashlib
import math
import random

import numpy as np
import pytest

from lexspark.llm import centroids


def _plain(rows, k=16, rounds=3, dims=64):
    kept = [(i, tuple(max(-(2**27), min(2**27, math.floor(64 * float(x)))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    c = [x for _, x in start[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    assign = lambda: [min((far(x, y), n) for n, y in enumerate(c)) for _, x in kept if c]
    for _ in range(rounds):
        got = assign()
        for n in range(len(c)):
            own = [x for (_, x), (_, m) in zip(kept, got) if m == n]
            if own:
                c[n] = tuple(sum(col) // len(own) for col in zip(*own))
    got = assign()
    each = {n: sum(d for d, m in got if m == n) for n in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((-1 if i is None else i), n, d, each[n], sum(each.values()), sha[n]) for (i, _), (d, n) in zip(kept, got))


def _got(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.select("vec_id", *centroids.MADE).collect())


SCHEMA = "vec_id long, embedding array<double>, cluster string, `a.b` string, x string"


def test_is_the_plain_version(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(rnd.choice((-1, 1)), 0.3) for _ in range(64)]) for i in range(150)]
    rows += [(200 + i, [0.25] * 64) for i in range(40)] + [(7, [0.0] * 64), (7, [0.0] * 64), (None, [0.5] * 64), (301, [1e300] + [0.0] * 63), (302, [-1e300] * 64)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [None] + [1.0] * 63), (405, [math.nan] + [1.0] * 63), (406, [math.inf] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, "mine", "own", "own") for r in rows], SCHEMA)
    for parts in (1, 7):
        out = centroids.cluster(df.repartition(parts))
        assert _got(out) == _plain(rows)
    assert sorted(out.columns) == sorted(["vec_id", "embedding", "a.b", "x", *centroids.MADE]) and {r["a.b"] for r in out.collect()} == {"own"}
    assert "mine" in {r["cluster"] for r in centroids.cluster(df, prefix="z_").collect()}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [1.0] * 64)], [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)
    assert _got(centroids.cluster(df)) == _plain(rows)


def test_partial_distances_keep_ties_and_results():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-3, 4, (5000, 64)), rng.integers(-3, 4, (16, 64))
    c[9] = c[2]
    x[:100] = c[9]
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    for order in (np.arange(64), rng.permutation(64)):
        for step in (1, 8, 64):
            k, d = centroids.nearest(x, c, order, step)
            assert (k == full.argmin(1)).all() and (d == full.min(1)).all()
