"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but little-endian ids, documents on end, each followed by an
end-of-document id; there is no index.  Files are cut into blocks anywhere, within
documents too, and each block is a row that reads its own range of bytes.  Each block is
searched for separators in one vectorised comparison, and gives the length before its first
separator, the lengths between its separators, and the length after its last.  Blocks are
stitched with a prefix scan over (file, block): the separators in all blocks before say which
document of the file a piece belongs to, and pieces of one document are added up.  The scan
has two levels (blocks within groups of ``GROUP``, then groups), so no task sees more than one
file's groups.

Empty documents (two separators on end) count 0 tokens.  Ids after a file's last separator
are a document that was not ended, reported with ended = false.  Empty files have no
documents; empty blocks and null blocks count as no ids.  Null texts are written as empty
documents, repeated rows each; a very long text spans many blocks.  Empty tables write no
file; extra columns of docs are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm import _text as T
from lexspark.llm.bpe import SLICE, automaton, size

GROUP = 1024
BLOCK_BYTES = 1 << 20


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, ids: blocks of the raw token files of a folder or path that Spark can list.

    Spark lists paths and lengths only; each block is a row of its own that is read by its range
    (from a local path, or by Arrow's file systems)."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length"))
    n = F.ceil(F.col("length") / block_bytes) - 1
    ranges = listed.where("length > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("block"))

    def read(batches):
        for batch in batches:
            for file, k in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = _opened(file)
                with system.open_input_file(at) as f:
                    f.seek(k * block_bytes)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([f.read(block_bytes)], pa.binary())], names=["file", "block", "ids"])

    return ranges.repartition(T.fold(spark), "file", "block").mapInArrow(read, "file string, block long, ids binary")


def _opened(file: str):
    """The file system of a path as Spark lists it, and the path within."""
    if file.startswith("file:") or file.startswith("/"):
        return fs.LocalFileSystem(), "/" + file.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(file)


def name_of(file):
    """A token file's own name, without its folder."""
    return F.element_at(F.split(file, "/"), -1)


def write_files(docs: DataFrame, tokenizer: str, separator: int) -> tuple[str, DataFrame, int]:
    """Tokenise whole texts into flat files in the shared folder, one for each task.

    An added token written out in a text is encoded as its bytes; a separator that is an ordinary
    id of the vocabulary is refused.  Returns the folder, the order of documents (file, doc,
    doc_id) that the producer knows, and the width of an id in bytes, which follows from the
    vocabulary.  A file counts only if its task's rows of that order were committed, so attempts
    that were lost or ran twice leave nothing but files that nobody asks for."""
    spark = docs.sparkSession
    T.lean(spark)
    folder = f"{T.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    width = 2 if max(size(tokenizer), separator + 1) <= 1 << 16 else 4

    def run(batches):
        machine = automaton(tokenizer)
        name, doc, out = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0, None
        system, at = _opened(folder)
        for batch in batches:
            for part in T.slices(batch, most=SLICE, own=automaton):
                ids, first = machine.encode([x or "" for x in part.column(1).to_pylist()], added=False)
                if (ids == separator).any():
                    raise ValueError(f"{separator} is an ordinary id, so it can't end documents")
                if out is None:
                    system.create_dir(at, recursive=True)
                    out = system.open_output_stream(f"{at}/{name}")
                out.write(np.insert(ids, first[1:], separator).astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([doc], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))], names=["file", "doc", "doc_ids"])
                doc += part.num_rows
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = T.materialize(rows.mapInArrow(run, "file string, doc long, doc_ids array<long>"), "order")
    order = kept.select("file", "doc", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("doc") + F.col("i")).alias("doc"), "doc_id")
    return folder, order, width


def counts(docs: DataFrame, tokenizer: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, file, doc, n_tokens, ended: texts are written as flat files, which are scanned again."""
    spark = docs.sparkSession
    folder, order, width = write_files(docs, tokenizer, separator)
    T.until_end(spark, folder)
    files = order.select("file").distinct()
    if not files.limit(1).count():
        return order.select("doc_id", "file", "doc", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("boolean").alias("ended"))
    blocks = read_blocks(spark, folder, block_bytes).withColumn("file", name_of("file"))
    found = count(blocks.join(files, "file", "left_semi"), separator, width)
    return order.join(found, ["file", "doc"], "left").select("doc_id", "file", "doc", "n_tokens", "ended")


def _pieces(separator: int, width: int):
    kind = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            out = []
            for ids in batch.column(2).to_pylist():
                x = np.frombuffer(ids or b"", f"<u{width}")
                at = np.flatnonzero(x == separator)
                out.append(np.diff(np.concatenate([[-1], at, [len(x)]])) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) - 1 for x in out], pa.int64()), pa.array(out, kind)], names=["file", "block", "seps", "pieces"])

    return run


def count(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """file, doc (its number in the file, from 0), n_tokens, ended.  A block's length is a
    multiple of ``width`` bytes."""
    # pieces are kept, so that blocks are searched once for the scan and for the sums
    found = T.materialize(blocks.select("file", "block", "ids").mapInArrow(_pieces(separator, width), "file string, block long, seps long, pieces array<long>"), "pieces")
    grouped = found.withColumn("g", F.floor(F.col("block") / GROUP))
    over = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    base = grouped.groupBy("file", "g").agg(F.sum("seps").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0)))
    within = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = grouped.withColumn("inner", F.coalesce(F.sum("seps").over(within), F.lit(0))).join(base.select("file", "g", "base"), ["file", "g"])
    pieces = scanned.select("file", "seps", (F.col("base") + F.col("inner")).alias("before"), F.posexplode("pieces").alias("i", "n"))
    whole = pieces.select("file", (F.col("before") + F.col("i")).alias("doc"), "n", (F.col("i") < F.col("seps")).alias("closed"), ((F.col("i") > 0) & (F.col("i") < F.col("seps"))).alias("inside"))
    # documents within one block are whole; only those that touch a block's edge are added up
    edge = whole.where("not inside").groupBy("file", "doc").agg(F.sum("n").alias("n_tokens"), F.max("closed").alias("ended"))
    out = whole.where("inside").select("file", "doc", F.col("n").alias("n_tokens"), F.lit(True).alias("ended")).unionByName(edge)
    return out.where("ended or n_tokens > 0")
