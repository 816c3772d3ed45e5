"""Digests of rows, tables and databases by a tree of hashes over ordered rows.

Rows are dealt by ranges of their key and sorted.  A leaf ends behind every key whose (last) hash ends in
``END`` (one in 256), so where leaves end is said by the rows and not by partitions: the tree is the same
however the table lies, and a changed row changes its own leaf (and at most the next) and the nodes above it.
The nodes of a level are cut and hashed in the same way into the next level's, until one is left.

A task hashes the leaves that lie within it; the beginnings and ends that it shares with its
neighbours (two a task at most) are put together afterwards.  No key's rows are gathered in a row, and a leaf is a few
hundred hashes.  Keys are meant to be unique; rows of equal keys are ordered by their hashes, and lie in one leaf."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from lexspark import shared

END = "00"
ROW, NODE, TABLE, DATABASE = "row/v1", "node/v1", "table/v1", "database/v1"


def canonical(columns: dict[str, Column]) -> Column:
    """A row as JSON with its names in order and nulls written out."""
    return F.to_json(F.struct(*(columns[c].alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def row_hash(table: str, columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(F.lit(f"{ROW}\n{table}\n"), canonical(columns)), 256)


def _node(level: int, hashes: str) -> str:
    return hashlib.sha256(f"{NODE}\n{level}\n{hashes}".encode()).hexdigest()


def _cut(level: int):
    """first, last, hash, rows in order -> whole nodes, and the pieces at a task's edges (their hashes on end, no hash)."""
    names = ["first", "last", "rows", "children", "hash", "piece", "task", "place", "closed"]
    plain = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches):
        task, edge, held, rows, kind = TaskContext.get().partitionId(), True, [], 0, None
        first = last = None

        def out(items):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*items), [kind, kind, *plain])], names=names)

        def end(made):
            """Close the leaf behind the key that has just ended, if its hash says so."""
            nonlocal edge, held, rows
            if held and held[-1].endswith(END):
                digests = "".join(held)
                made.append((first, last, rows, len(held), None, digests, task, 0, True) if edge else (first, last, rows, len(held), _node(level, digests), None, None, None, None))
                edge, held, rows = False, [], 0

        made = []
        for batch in batches:
            kind = batch.column(0).type
            for low, high, h, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if high != last:
                    end(made)
                first, last = first if held else low, high
                held.append(h)
                rows += n
            if made:
                yield out(made)
                made = []
        end(made)  # equal keys are in one task, so its last key ends here
        if held:
            made.append((first, last, rows, len(held), None, "".join(held), task, 0 if edge else 1, False))
        if made:
            yield out(made)

    return run


def _level(nodes: DataFrame, level: int) -> DataFrame:
    """first, last, hash, rows -> the same and children of the nodes over them."""
    key = nodes.schema["last"].dataType
    schema = StructType([StructField("first", key), StructField("last", key), *(StructField(c, LongType()) for c in ("rows", "children")), *(StructField(c, StringType()) for c in ("hash", "piece")), *(StructField(c, IntegerType()) for c in ("task", "place")), StructField("closed", BooleanType())])
    sorted_ = nodes.select("first", "last", "hash", "rows").repartitionByRange("last").sortWithinPartitions("last", "hash")
    cut = shared.keep(sorted_.mapInArrow(_cut(level), schema), "digest-level")
    pieces = cut.where("piece is not null")
    # which node a piece belongs to: as many have ended before it; two narrow rows a task
    number = pieces.select("task", "place", "closed").withColumn("node", F.coalesce(F.sum(F.col("closed").cast("int")).over(Window.orderBy("task", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.struct("task", "place")
    joined = pieces.join(number.drop("closed"), ["task", "place"]).groupBy("node").agg(
        F.min_by("first", place).alias("first"), F.max_by("last", place).alias("last"), F.sum("rows").alias("rows"), F.sum("children").alias("children"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", "place", "piece"))), lambda p: p["piece"]), "").alias("hashes"),
    )
    joined = joined.select("first", "last", F.sha2(F.concat(F.lit(f"{NODE}\n{level}\n"), F.col("hashes")), 256).alias("hash"), "rows", "children")
    return cut.where("piece is null").select("first", "last", "hash", "rows", "children").unionByName(joined)


def tree(rows: DataFrame, keys: list[str]) -> DataFrame:
    """level, first, last (keys as structs), hash, rows, children of all nodes over rows (keys, hash); leaves are of level 1.

    The last level has one node (none for an empty table)."""
    key = F.struct(*keys)
    level, nodes, out = 0, rows.select(key.alias("first"), key.alias("last"), "hash", F.lit(1).cast("long").alias("rows")), None
    while True:
        level += 1
        nodes = shared.keep(_level(nodes, level), "digest-nodes")
        named = nodes.select(F.lit(level).alias("level"), "first", "last", "hash", "rows", "children")
        out = named if out is None else out.unionByName(named)
        if nodes.limit(2).count() < 2:
            return out


def table_digest(nodes: DataFrame, name: str) -> DataFrame:
    """table, n_rows, hash: one row."""
    root = nodes.agg(F.max_by(F.struct("hash", "rows"), "level").alias("r"))
    count = F.coalesce("r.rows", F.lit(0)).alias("n_rows")
    return root.select(F.lit(name).alias("table"), count, F.sha2(F.concat_ws("\n", F.lit(TABLE), F.lit(name), count.cast("string"), F.coalesce("r.hash", F.lit(""))), 256).alias("hash"))


def database_digest(tables: DataFrame) -> DataFrame:
    """The digest of tables' digests, by their names: table (null), n_rows, hash."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "table", "n_rows", "hash")))  # a line for each table
    return tables.agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.concat(F.lit(f"{DATABASE}\n"), F.array_join(lines, "\n")), 256).alias("hash")).select(F.lit(None).cast("string").alias("table"), "n_rows", "hash")


def changed_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """side (a or b), first, last, rows: the leaves of each tree that the other has not. Every row that differs
    between the two tables lies in one of them, so only these ranges need comparing."""
    leaf = lambda nodes: nodes.where("level = 1")
    own = [leaf(x).join(leaf(y).select("hash"), "hash", "left_anti").select(F.lit(s).alias("side"), "first", "last", "rows") for s, x, y in (("a", a, b), ("b", b, a))]
    return own[0].unionByName(own[1])


def database(tables: dict[str, tuple[DataFrame, list[str], dict[str, Column]]]) -> DataFrame:
    """table, n_rows, hash of each table (rows, keys, columns), and of all together (table null)."""
    out = None
    for name, (df, keys, columns) in tables.items():
        nodes = tree(df.select(*keys, row_hash(name, columns).alias("hash")), keys)
        one = table_digest(nodes, name)
        out = one if out is None else out.unionByName(one)
    return out.unionByName(database_digest(out))
