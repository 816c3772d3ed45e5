"""Vector projections (what a vector service should hold, and what has to change there) and an
inverted-file index whose results are those of a full scan."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from lexspark import shared
from lexspark.functions import text
from lexspark.operators import digests, search

HEX64 = r"^[0-9a-f]{64}$"
QUANTUM = 2**20


# -- projection


def stale_detail(version: dict[str, Column], artifact: dict[str, Column], provider: str, model: str, dimensions: int) -> Column:
    """The first field in which an artifact doesn't fit its version, null if all do."""
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    tests = {
        "article_id": same(artifact["article_id"], version["article_id"]),
        "content_hash": F.coalesce(version["content_hash"].rlike(HEX64), F.lit(False)) & same(artifact["content_hash"], version["content_hash"]),
        "provider": same(artifact["provider"], F.lit(provider)),
        "model": same(artifact["model"], F.lit(model)),
        "dimensions": same(artifact["dimensions"], F.lit(dimensions)),
        "input_hash": F.coalesce(artifact["input_hash"].rlike(HEX64), F.lit(False)),
    }
    return F.coalesce(*(F.when(~ok, F.lit(name)) for name, ok in tests.items()))


def fingerprint(metadata: dict[str, Column], values: Column) -> Column:
    """sha256 of the metadata as JSON (names in order, nulls written out) and of the unit vector in steps of 2**-20."""
    whole = F.array_join(F.transform(values, lambda x: F.round(x * QUANTUM).cast("long").cast("string")), ",")
    return F.sha2(F.concat_ws("\n", digests.canonical(metadata), whole), 256)


def projection(versions: DataFrame, artifacts: DataFrame, metadata: list[str], provider: str, model: str, dimensions: int) -> DataFrame:
    """A row a published version: id, version_id, reason, detail and, where reason is null, values (a unit
    vector) and fingerprint. Reasons: missing_artifact, duplicate_artifact, stale_artifact (detail: the field).

    versions: version_id, article_id, content_hash and ``metadata``; artifacts: version_id, article_id, content_hash,
    provider, model, dimensions, input_hash, embedding."""
    fields = ("article_id", "content_hash", "provider", "model", "dimensions", "input_hash", "embedding")
    # several artifacts of a version are an error of its own, found map-side
    one = artifacts.groupBy("version_id").agg(F.count("*").alias("n"), F.first(F.struct(*fields)).alias("a"))
    j = versions.join(one, "version_id", "left")
    detail = stale_detail({c: F.col(c) for c in ("article_id", "content_hash")}, {c: F.col(f"a.{c}") for c in fields}, provider, model, dimensions)
    reason = F.when(F.col("n").isNull(), "missing_artifact").when(F.col("n") > 1, "duplicate_artifact").when(detail.isNotNull(), "stale_artifact")
    j = j.withColumns({"reason": reason, "detail": F.when(reason == "stale_artifact", detail)})
    good = F.col("reason").isNull()
    j = j.withColumn("values", F.when(good, text.l2_normalize(F.col("a.embedding"), dimensions)))
    said = {c: F.col(c) for c in metadata} | {"content_hash": F.col("content_hash"), "input_hash": F.col("a.input_hash"), "version_id": F.col("version_id"), "model": F.lit(model), "provider": F.lit(provider)}
    return j.select(F.col("article_id").alias("id"), "version_id", "reason", "detail", "values", F.when(good, fingerprint(said, F.col("values"))).alias("fingerprint"))


def manifest(projected: DataFrame) -> DataFrame:
    """records, missing, stale, duplicate and a digest of ids and fingerprints: one row. The digest is a tree's root,
    so it is the same under any partitioning and no task sees all records."""
    good = projected.where("reason is null")
    root = digests.table_digest(digests.tree(good.select("id", F.sha2(F.concat_ws("\n", F.col("id").cast("string"), "fingerprint"), 256).alias("hash")), ["id"]), "vectors")
    counts = projected.agg(*(F.count_if(F.col("reason") == f"{k}_artifact").alias(k) for k in ("missing", "stale", "duplicate")))
    return root.select(F.col("n_rows").alias("records"), "hash").crossJoin(F.broadcast(counts))  # one row each


def plan(current: DataFrame, projected: DataFrame) -> DataFrame:
    """id, change (added, changed, unchanged, removed), reason: what has to be done to a service that holds
    ``current`` (id, fingerprint). The reason of a removal is that of the omission, or unpublished."""
    was = current.select("id", F.col("fingerprint").alias("was"))
    j = projected.select("id", "reason", "detail", "fingerprint").join(was, "id", "full")
    now, old = F.col("fingerprint").isNotNull(), F.col("was").isNotNull()
    change = F.when(now & ~old, "added").when(now & (F.col("fingerprint") != F.col("was")), "changed").when(now, "unchanged").when(old, "removed")
    why = F.when(~now, F.coalesce(F.concat_ws(":", "reason", "detail"), F.lit("")))
    return j.where(now | old).select("id", change.alias("change"), F.when(why == "", "unpublished").otherwise(why).alias("reason"))


# -- index


class VectorIndex:
    """Unit vectors in lists around centroids; a query reads the lists that can hold one of its best.

    Centroids are fitted on at most ``SAMPLE`` vectors a list (what they are affects the work, never a result);
    every vector is indexed, sorted by list and by its distance to the list's centroid. By the triangle
    inequality a vector x of a list with centroid c is no nearer to a query q than |d(q, c) - d(x, c)|. The
    lists nearest to the query are read until they hold k matching vectors; the k-th distance t then rules out
    all lists but those with a bound within t, and of those all rows but the ones at d(q, c) - t to d(q, c) + t, which
    Parquet's row groups skip. What is left is measured in full."""

    SAMPLE, LISTS, STEPS = 64, 4096, 8
    SLACK = 1e-6

    def __init__(self, vectors: DataFrame, key: str, vector: str, lists: int | None = None, seed: int = 7):
        spark = vectors.sparkSession
        self.key, self.vector = key, vector
        rows = vectors.count()
        lists = max(1, min(self.LISTS, lists or math.isqrt(rows)))
        some = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0")
        share = min(1.0, 2.0 * self.SAMPLE * lists / max(rows, 1))
        drawn = [r.v for r in some.sample(share, seed).limit(self.SAMPLE * lists).collect()] if share < 1 else [r.v for r in some.limit(self.SAMPLE * lists).collect()]
        self.centroids = self._fit(drawn, lists, seed)
        places = spark.sparkContext.broadcast(self.centroids)

        def assign(batches):
            for batch in batches:
                v = batch.column(batch.num_columns - 1)
                number, far = _placed(v, places.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(number, pa.int32()), pa.array(far)], names=[*batch.schema.names[:-1], "list_", "far_"])

        schema = StructType([*vectors.schema.fields]).add("list_", IntegerType()).add("far_", DoubleType())
        placed = vectors.withColumn("v_", F.col(vector).cast("array<double>")).mapInArrow(assign, schema)
        self.rows = shared.keep(placed.repartitionByRange("list_", "far_").sortWithinPartitions("list_", "far_"), "vector-index")
        # at most LISTS rows and the one of vectors without direction (-1)
        self.lists = {r.list_: (r.n, r.lo, r.hi) for r in self.rows.groupBy("list_").agg(F.count("*").alias("n"), F.min("far_").alias("lo"), F.max("far_").alias("hi")).collect()}

    @classmethod
    def _fit(cls, drawn: list, lists: int, seed: int) -> np.ndarray:
        width = max(map(len, drawn), default=1)
        x = np.array([v for v in drawn if len(v) == width and None not in v], float).reshape(-1, width)
        norm = np.linalg.norm(x, axis=1)
        x = x[(norm > 0) & np.isfinite(norm)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if not len(x):
            return np.zeros((0, width))
        c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
        for _ in range(cls.STEPS):
            own = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
        return c

    def search(self, query: list[float], k: int, where: Column | None = None) -> tuple[DataFrame, dict[str, int]]:
        """key, score, rank of the k nearest by cosine (ties by key) among the rows of a predicate, and how many lists
        and rows there are and were read."""
        q = np.asarray(query, float)
        norm = np.linalg.norm(q)
        scored = lambda rows: search.semantic(rows, self.key, self.vector, list(query), where)
        plain = [n for n in self.lists if n >= 0]
        if norm == 0 or not np.isfinite(norm) or not plain or self.centroids.shape[1] != len(q):
            return search.ranked(scored(self.rows), self.key, k), {"lists": len(self.lists), "lists_read": len(self.lists), "rows": self.count, "rows_read": self.count}
        gap = np.linalg.norm(self.centroids - q / norm, axis=1)
        bound = {n: max(0.0, gap[n] - self.lists[n][2], self.lists[n][1] - gap[n]) for n in plain}
        order = sorted(plain, key=lambda n: (gap[n], n))
        first, size, found = [], 0, []
        step = 1
        while len(first) < len(order):  # a narrow predicate needs more lists: twice as many each time
            first = order[: len(first) + step]
            step = len(first)
            size = sum(self.lists[n][0] for n in first)
            if size >= k:
                found = scored(self.rows.where(F.col("list_").isin(first))).orderBy(F.desc("score"), F.asc(self.key)).limit(k).collect()
                if len(found) == k:
                    break
        # scores are rounded to six digits: all that may round to the k-th one's are wanted
        t = math.sqrt(max(0.0, 2 - 2 * found[-1].score) + 4 * self.SLACK) if len(found) == k else math.inf
        rest = [n for n in order if n not in set(first) and bound[n] <= t]
        # vectors without direction have a score of 0, and those of another width a score of their own
        odd = [-1] if -1 in self.lists else []
        spans = self.rows.sparkSession.createDataFrame([(n, float(gap[n] - t), float(gap[n] + t)) for n in rest], "list_ int, from_ double, to_ double")
        rows = self.rows.where(F.col("list_").isin([*first, *odd]))
        if rest:
            near = self.rows.where(F.col("list_").isin(rest)).join(F.broadcast(spans), "list_").where("far_ between from_ and to_").select(*self.rows.columns)
            rows = rows.unionByName(near)
        read = [*first, *rest, *odd]
        return search.ranked(scored(rows), self.key, k), {"lists": len(self.lists), "lists_read": len(read), "rows": self.count, "rows_read": sum(self.lists[n][0] for n in read)}

    @property
    def count(self) -> int:
        return sum(n for n, _, _ in self.lists.values())


def _placed(column: pa.Array, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List and distance of each vector; -1 for those without direction or of another width."""
    number, far = np.full(len(column), -1, np.int32), np.zeros(len(column))
    width = centroids.shape[1]
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == width) if len(centroids) else np.zeros(0, np.int64)
    if len(at):
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        norm = np.linalg.norm(x, axis=1)
        good = (norm > 0) & np.isfinite(norm)
        at, x = at[good], x[good] / norm[good][:, None]
        near = x @ centroids.T
        own = near.argmax(axis=1) if len(x) else np.zeros(0, np.int64)
        number[at], far[at] = own, np.linalg.norm(x - centroids[own], axis=1) if len(x) else 0
    return number, far
