"""Vector projections, and the inverted-file index against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import search, vectors

FULL = lambda df, q, k, where=None: [(r.id, r.score, r["rank"]) for r in search.ranked(search.semantic(df, "id", "v", q, where), "id", k).orderBy("rank").collect()]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 2
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * 0.4).round(3)
    rows = [(i, [float(v) for v in x[i]], int(i % 7)) for i in range(900)]
    rows += [(900 + i, rows[i][1], 3) for i in range(30)]  # equal vectors: ties go by id
    rows += [(1000, [0.0] * 16, 1), (1001, [0.0] * 16, 2), (1002, [1.0] * 5, 1), (1003, None, 1), (1004, [], 2)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(5).cache(), x


@pytest.mark.parametrize("where", [None, "label = 3", "id > 890", "label > 50", "id % 97 = 0"])
def test_index_is_a_full_scan(points, where):
    df, x = points
    index = vectors.VectorIndex(df, "id", "v")
    rng = np.random.default_rng(1)
    test = None if where is None else F.expr(where)
    pruned = 0
    for q in [x[0], x[17] * -1, rng.normal(size=16), np.ones(16)]:
        for k in (1, 10, 60):
            got, read = index.search([float(v) for v in q], k, test)
            assert [(r.id, r.score, r["rank"]) for r in got.orderBy("rank").collect()] == FULL(df, [float(v) for v in q], k, test)
            assert read["rows"] == df.count() and read["rows_read"] <= read["rows"] and read["lists_read"] <= read["lists"]
            pruned += read["lists_read"] < read["lists"]
    assert where is not None or pruned


def test_index_prunes_what_is_far(points):
    df, x = points
    _, read = vectors.VectorIndex(df, "id", "v").search([float(v) for v in x[3]], 10)
    assert read["rows_read"] < 0.5 * read["rows"]


@pytest.mark.parametrize("q", [[0.0] * 16, [1.0] * 5, [float("nan")] * 16])
def test_odd_queries(points, q):
    df, _ = points
    got, read = vectors.VectorIndex(df, "id", "v").search(q, 5)
    assert read["lists_read"] == read["lists"] and str([(r.id, r.score) for r in got.orderBy("rank").collect()]) == str([(a, b) for a, b, _ in FULL(df, q, 5)])


def test_empty_index(spark):
    df = spark.createDataFrame([], "id long, v array<double>, label int")
    got, read = vectors.VectorIndex(df, "id", "v").search([1.0, 2.0], 5)
    assert got.collect() == [] and read["rows"] == 0


def test_projection_reasons_and_plan(spark):
    h, g = "a" * 64, "b" * 64
    versions = spark.createDataFrame([(f"v{i}", i, h, "en") for i in range(8)] + [("v8", 8, "short", "en"), ("v9", 9, None, "en")], "version_id string, article_id long, content_hash string, lang string")
    good = lambda v, a, **over: ({"version_id": v, "article_id": a, "content_hash": h, "provider": "p", "model": "m", "dimensions": 2, "input_hash": g, "embedding": [3.0, 4.0]} | over)
    rows = [good("v0", 0), good("v1", 99), good("v2", 2, content_hash=g), good("v3", 3, provider=None), good("v4", 4, model="x", dimensions=3), good("v5", 5, input_hash="B" * 64), good("v6", 6), good("v6", 6), good("v8", 8, content_hash="short"), good("v9", 9)]
    artifacts = spark.createDataFrame([tuple(r.values()) for r in rows], "version_id string, article_id long, content_hash string, provider string, model string, dimensions int, input_hash string, embedding array<double>")
    got = vectors.projection(versions, artifacts, ["lang"], "p", "m", 2)
    said = {r.id: (r.reason, r.detail) for r in got.collect()}
    assert said == {0: (None, None), 1: ("stale_artifact", "article_id"), 2: ("stale_artifact", "content_hash"), 3: ("stale_artifact", "provider"), 4: ("stale_artifact", "model"), 5: ("stale_artifact", "input_hash"), 6: ("duplicate_artifact", None), 7: ("missing_artifact", None), 8: ("stale_artifact", "content_hash"), 9: ("stale_artifact", "content_hash")}
    first = got.where("id = 0").first()
    assert first["values"] == [0.6, 0.8] and len(first.fingerprint) == 64
    current = spark.createDataFrame([(0, first.fingerprint), (1, "x"), (7, "y"), (50, "z")], "id long, fingerprint string")
    assert sorted(map(tuple, vectors.plan(current, got).collect())) == [(0, "unchanged", None), (1, "removed", "stale_artifact:article_id"), (7, "removed", "missing_artifact"), (50, "removed", "unpublished")]
    assert [tuple(r) for r in vectors.plan(current.where("id = 0").withColumn("fingerprint", F.lit("old")), got).collect()] == [(0, "changed", None)]
    assert [tuple(r) for r in vectors.plan(current.limit(0), got).collect()] == [(0, "added", None)]
    other = vectors.projection(versions.withColumn("lang", F.lit("de")), artifacts, ["lang"], "p", "m", 2).where("id = 0").first()
    assert other.fingerprint != first.fingerprint
    m = vectors.manifest(got).first()
    assert (m.records, m.missing, m.stale, m.duplicate) == (1, 1, 7, 1)
