"""Diffs, digests, ledgers and list parity."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checksum(*cols) -> Column:
    """sha256 of the columns as text, null told from empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols)), 256)


def diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key, change (added, changed, removed): one full join on the key, comparing checksums."""
    a, b = old.select(key, checksum(*cols).alias("x")), new.select(key, checksum(*cols).alias("y"))
    out = a.join(b, key, "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return out.select(key, F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))


def symmetric_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side; distinct on both sides."""
    tagged = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
    cols = a.columns
    return tagged.groupBy(*cols).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = hi").select(*cols, F.when(F.col("lo") == 1, "left").otherwise("right").alias("side"))


def set_digest(df: DataFrame, by: str, key: str) -> DataFrame:
    """Per group: count and sha256 of its ordered ids (a group's ids must fit in a row). The form is given: a hash of ids joined
    in order is sequential, so it can't be the root of a tree; for sets of any size see ``digests`` and ``unordered_digest``."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").cast("binary"), 256).alias("digest"))


def unordered_digest(df: DataFrame, key: str, *by: str) -> DataFrame:
    """Of sets of any size (one for each group): count and sum of hashes, which combine map-side."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.md5(F.concat_ws(":", F.count("*"), F.sum(F.xxhash64(key).cast("decimal(38,0)"))).cast("binary")).alias("digest"))


def overlay(stock: DataFrame, changes: DataFrame, key: str, seq: str, deleted: str) -> DataFrame:
    """Stock with ordered increments laid over it: the last write of each key wins, tombstones go."""
    cols = [c for c in stock.columns if c != key]
    both = stock.withColumn(seq, F.lit(-1).cast("long")).withColumn(deleted, F.lit(False)).unionByName(changes)
    last = both.groupBy(key).agg(F.max_by(F.struct(deleted, *cols), seq).alias("r"))
    return last.where(~F.col(f"r.{deleted}")).select(key, *(F.col(f"r.{c}").alias(c) for c in cols))


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key, the one of smallest order (an aggregate, so copies combine map-side)."""
    cols = df.columns
    return df.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*cols), order).alias("r"), F.count("*").alias("copies")).select("r.*", "copies")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """New keys in; known ones with their counter raised and the other columns of new."""
    rest = [c for c in old.columns if c not in (*keys, counter)]
    a = old.select(*keys, F.col(counter).alias("_n"), F.struct(*rest).alias("_old"))
    b = new.select(*keys, F.struct(*rest).alias("_new"))
    j = a.join(b, keys, "full")
    n = F.coalesce("_n", F.lit(0)) + F.when(F.col("_new").isNotNull(), 1).otherwise(0)
    return j.select(*keys, n.alias(counter), *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in rest))


def parity(lists: DataFrame, observed: str, expected: str, k: int) -> DataFrame:
    """Ranked-list parity per row: overlap at k, same set, same order, common prefix."""
    a, b = F.slice(observed, 1, k), F.slice(expected, 1, k)
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)).cast("int"))
    prefix = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(1).alias("on")), lambda s, x: F.struct((s["n"] + s["on"] * x).alias("n"), (s["on"] * x).alias("on")), lambda s: s["n"])
    return lists.withColumns({"overlap": F.size(F.array_intersect(a, b)) / F.greatest(F.size(b), F.lit(1)), "same_set": F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b)), "same_order": a == b, "prefix": prefix})


# -- hash-chained ledger


def _entry(previous: str, payload: str) -> str:
    return hashlib.sha256(f"{previous}\n{payload}".encode()).hexdigest()


def chain(events: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """Hash-chained entries per key. Each needs the one before, so it runs in order per key;
    events of a key are streamed in sorted partitions, not gathered into a group."""
    rows = events.select(key, order, payload.alias("payload")).repartition(key).sortWithinPartitions(key, order)

    def run(batches):
        last_key, last = None, ""
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key], pdf["payload"]):
                last = _entry("" if k != last_key else last, p)
                last_key = k
                out.append(last)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "payload": pdf["payload"], "entry_hash": out})

    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", entry_hash string")


def verify_chain(ledger: DataFrame, key: str, order: str) -> DataFrame:
    """Per key: entries, and those whose hash doesn't follow from the entry before."""
    w = Window.partitionBy(key).orderBy(order)
    want = F.sha2(F.concat(F.coalesce(F.lag("entry_hash").over(w), F.lit("")), F.lit("\n"), F.col("payload")), 256)
    return ledger.withColumn("ok", want == F.col("entry_hash")).groupBy(key).agg(F.count("*").alias("entries"), F.count_if(~F.col("ok")).alias("broken"))
