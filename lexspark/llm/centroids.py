"""Centroid clustering of vectors with partial-distance search, in whole numbers throughout.

A vector takes part if it has exactly ``DIMS`` components, none null, NaN or infinite; each
component x becomes floor(64 * x).  Centroids start as the vectors with the smallest sha256 of
"1:<id>"; each round assigns every vector to its nearest centroid (squared distance, ties to the
smaller number) and replaces each centroid that has vectors by their floor(sum / count).

Search goes through the dimensions from the largest variance to the smallest.  The centroid that
is nearest after the first ``STEP`` of them is measured to the end, and its distance is the
bound: any other centroid is left as soon as its partial distance is strictly above, and those
that stay are measured over all dimensions.  The order changes the work, never the result.

Each round is one narrow pass in which a task sums up its own vectors, so a shuffle holds one row
a centroid and task, whatever share of the vectors one centroid has; only the centroids (``k`` rows)
come to the driver.  What is returned is a narrow plan over the caller's table.

Null and unusable vectors have no row.  A null id is never a start and is clustered like
others; equal vectors and repeated ids are separate rows, and equal start hashes go by the vectors.
With fewer vectors than ``k`` there are fewer centroids; empty tables give empty results.
Components beyond 2**27 either way count as that, so that distances stay within a long.  The
caller's columns are kept, whatever their names, but for those named like results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import _text as T

DIMS, SCALE = 64, 64
CENTROIDS, ROUNDS, SEED = 16, 3, 1
STEP = 8
LARGEST = 2**27
BLOCK = 4096
MADE = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}


def _whole(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector takes part, and their components as whole numbers."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    ok = np.isfinite(x).all(axis=1)  # a null component comes as NaN
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(SCALE * x[ok]), -LARGEST, LARGEST)
    return rows[ok], whole.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Of each line of x: number of its nearest centroid, and the squared distance."""
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    c = centroids[:, order]
    for at in range(0, len(x), BLOCK):
        v = x[at : at + BLOCK][:, order]
        partial = ((v[:, None, :step] - c[None, :, :step]) ** 2).sum(axis=2)
        bound = ((v - c[partial.argmin(axis=1)]) ** 2).sum(axis=1)
        row, k = np.nonzero(partial <= bound[:, None])
        d = partial[row, k]
        for i in range(step, len(order), step):
            d = d + ((v[row, i : i + step] - c[k, i : i + step]) ** 2).sum(axis=1)
            stay = d <= bound[row]
            row, k, d = row[stay], k[stay], d[stay]
        best = np.lexsort((k, d, row))
        best = best[np.append(True, np.diff(row[best]) > 0)]  # the bound's own centroid stays, so every vector is here
        cluster[at : at + BLOCK], distance[at : at + BLOCK] = k[best], d[best]
    return cluster, distance


def _sums(found: DataFrame, partial, names: list[str]) -> list:
    """The rows of ``partial`` (a number and sums for each task) summed up by number."""
    schema = "number long, " + ", ".join(f"{n} decimal(38,0)" for n in names)
    return found.mapInArrow(partial, schema).groupBy("number").agg(*(F.sum(n).alias(n) for n in names)).collect()


def _batch(numbers, columns, names) -> pa.RecordBatch:
    big = lambda x: pa.array([int(v) for v in x], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *(big(c) for c in columns)], names=["number", *names])


def _lines(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _spread(kept: DataFrame, dims: int) -> np.ndarray:
    """Dimensions from the largest variance of all vectors to the smallest (ties: as they come)."""
    names = ["n", "total", "squares"]

    def run(batches):
        n, total, squares = 0, np.zeros(dims, object), np.zeros(dims)
        for batch in batches:
            x = _lines(batch, dims)
            n, total, squares = n + len(x), total + x.sum(axis=0).astype(object), squares + (x.astype(np.float64) ** 2).sum(axis=0)
        if n:
            yield _batch(np.arange(dims), [[n] * dims, total, squares], ["n", "total", "squares"])

    found = {r.number: float(r.squares) / float(r.n) - (float(r.total) / float(r.n)) ** 2 for r in _sums(kept, run, names)}
    return np.array(sorted(range(dims), key=lambda i: (-found.get(i, 0.0), i)))


def _assigned(kept: DataFrame, centroids: np.ndarray, order: np.ndarray):
    """Of each centroid that has vectors: their number, summed distance and summed components."""
    dims, k = centroids.shape[1], len(centroids)
    names = ["n", "distance", *(f"s{i}" for i in range(dims))]

    def run(batches):
        n, far, total = np.zeros(k, np.int64), np.zeros(k, object), np.zeros((k, dims), object)
        for batch in batches:
            x = _lines(batch, dims)
            cluster, distance = nearest(x, centroids, order)
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                own = cluster == c
                total[c] = total[c] + x[own].sum(axis=0).astype(object)
                far[c] = far[c] + sum(distance[own].tolist())
        some = np.flatnonzero(n)
        if len(some):
            yield _batch(some, [n[some], far[some], *total[some].T], names)

    return {r.number: r for r in _sums(kept, run, names)}


def fit(kept: DataFrame, k: int, rounds: int, dims: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Centroids, the order of dimensions, and each centroid's inertia. kept: x, start (text or null)."""
    first = kept.where("start is not null").orderBy("start", "x").limit(k).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), dims)
    if not len(first):
        return centroids, np.arange(dims), {}
    order = _spread(kept.select("x"), dims)
    for _ in range(rounds):
        for number, r in _assigned(kept.select("x"), centroids, order).items():
            centroids[number] = [int(r[f"s{i}"]) // int(r.n) for i in range(dims)]
    return centroids, order, {number: int(r.distance) for number, r in _assigned(kept.select("x"), centroids, order).items()}


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, prefix: str = "") -> DataFrame:
    """The usable rows of ``vectors`` with cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = vectors.sparkSession
    T.lean(spark)
    whole = T.column(vector).cast("array<double>")

    def ints(batches):
        for batch in batches:
            rows, x = _whole(batch.column(1), dims)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], names=["start", "x"])

    scratch = T.Scratch(spark)
    try:
        start = F.sha2(F.concat(F.lit(f"{seed}:"), T.column(key).cast("string")).cast("binary"), 256)
        kept = vectors.select(start.alias("start"), whole.alias("x")).mapInArrow(ints, "start string, x array<int>")
        centroids, order, inertia = fit(scratch.save(kept, "vectors"), k, rounds, dims)
    finally:
        scratch.close()
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def assign(batches):
        for batch in batches:
            rows, x = _whole(batch.column(batch.num_columns - 1), dims)
            number, distance = nearest(x, centroids, order) if len(centroids) else (np.zeros(0, np.int64),) * 2
            rows = rows[: len(number)]  # without a single start there are no centroids and no rows
            kept = [c.take(pa.array(rows)) for c in batch.columns[:-1]]
            yield [*kept, pa.array(number, pa.int32()), pa.array(distance), pa.array([inertia[c] for c in number.tolist()], pa.int64()), pa.array([total] * len(rows), pa.int64()), pa.array([digests[c] for c in number.tolist()], pa.string())]

    made = {f"{prefix}{name}": kind for name, kind in MADE.items()}
    own = T.columns(vectors, made)
    return T.mapped(vectors.select(*own, whole.alias(T.unused(vectors))), assign, ", ".join(f"`{name}` {kind}" for name, kind in made.items()), inputs=1)
