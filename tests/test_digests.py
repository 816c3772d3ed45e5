"""The tree of hashes: the same under any partitioning, and a plain version of it."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import digests


def _sha(*parts):
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _plain(rows):
    """[(key, hash)] -> hashes of the nodes of each level."""
    at, levels = sorted(rows), []
    while at and (not levels or len(at) > 1):
        out, held = [], ""
        for i, (k, h) in enumerate(at):
            held += h
            if i + 1 == len(at) or at[i + 1][0] != k and h.endswith("00"):
                out, held = [*out, (k, _sha("node/v1", str(len(levels) + 1), held))], ""
        at = out
        levels.append([h for _, h in at])
    return levels


def _rows(n):
    return [(i * 7 % n, _sha("row", str(i * 7 % n))) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 5, 3001])
def test_tree_is_the_plain_one(spark, n):
    rows = _rows(n)
    want = _plain(rows)
    for parts in (1, 3, 40):
        df = spark.createDataFrame(rows, "k long, hash string").repartition(parts)
        nodes = digests.tree(df, ["k"])
        got = nodes.orderBy("level", "last").collect()
        assert [[r["hash"] for r in got if r.level == k + 1] for k in range(len(want))] == want and len(got) == sum(map(len, want))
        assert sum(r.rows for r in got if r.level == 1) == n
        root = digests.table_digest(nodes, "t").first()
        assert (root.n_rows, root["hash"]) == (n, _sha("table/v1", "t", str(n), want[-1][0] if want else ""))


def test_equal_keys_lie_in_one_leaf(spark):
    rows = [(i // 3, _sha("row", str(i % 700))) for i in range(2100)] + [(5, _sha("x", str(i))[:-2] + "00") for i in range(9)] * 2
    want = _plain(rows)
    for parts in (1, 9):
        nodes = digests.tree(spark.createDataFrame(rows, "k long, hash string").repartition(parts), ["k"])
        assert [r["hash"] for r in nodes.orderBy("level", "last").collect()] == [h for level in want for h in level]


def test_many_partitions_share_leaves(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    rows = _rows(2000)
    try:
        for parts in ("1", "60"):  # about 33 rows a task: no leaf lies within one
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = spark.createDataFrame(rows, "k long, hash string")
            assert [r["hash"] for r in digests.tree(df, ["k"]).where("level = 1").orderBy("last").collect()] == _plain(rows)[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_changed_ranges_hold_what_differs(spark):
    rows = dict(_rows(4000))
    a = digests.tree(spark.createDataFrame(list(rows.items()), "k long, hash string"), ["k"])
    rnd = random.Random(2)
    changed = {k: _sha("other", str(k)) for k in rnd.sample(sorted(rows), 3)} | {9999: _sha("new")}
    other = {k: h for k, h in (rows | changed).items() if k != 17}
    b = digests.tree(spark.createDataFrame(list(other.items()), "k long, hash string"), ["k"])
    spans = [(r["first"].k, r["last"].k) for r in digests.changed_ranges(a, b).collect()]
    assert all(any(x <= k <= y for x, y in spans) for k in [*changed, 17])
    assert sum(r.rows for r in digests.changed_ranges(a, b).where("side = 'a'").collect()) < 2500
    assert digests.changed_ranges(a, a).count() == 0


def test_rows_tell_null_from_empty_and_order_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (1, "null", "x")], "k long, b string, a string")
    hashes = [r[0] for r in df.select(digests.row_hash("t", {"b": F.col("b"), "a": F.col("a")})).collect()]
    assert len(set(hashes)) == 3 and hashes[0] == _sha("row/v1", "t", '{"a":"x","b":null}')
