"""Vectorised word scanning and small job helpers shared by the corpus operators.

Words are maximal runs of bytes outside a separator table.  The contract's word
``[^\\x20\\x09-\\x0D]+`` is a byte-level notion too (no UTF-8 continuation byte is a
separator), so all scanning happens on UTF-8 buffers without decoding.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1_000_000
ARROW_ROWS = 1_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators for terms: everything in ASCII but letters and digits.
NONTERM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_VAL = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective): spreads every bit of x over the word."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POW = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        have = np.ones(max(n, SLICE_BYTES + 1), np.uint64)
        have[1:] = base
        np.cumprod(have, out=have)
        _POW[int(base)] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Caches that operators fill in a worker. Workers live on and go from operator to operator, so
#: another operator's tasks give them back.
HELD: list = []
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES, own=None):
    """Cut a batch into runs of rows of about ``most`` bytes of text (one row at least). ``own`` is the
    cache of HELD that the operator itself needs."""
    for cache in HELD:
        if cache is not own:
            cache.cache_clear()
    _, off = utf8(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    # a worker lives on; what it doesn't need now is given back
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def spans(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the number of words before it (n+1 long)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~sep[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < len(buf)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each word: a random value per byte times a power of its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    value = _VAL[_LOWER] if lower else _VAL
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value[buf] * powers(_BASE, len(buf)), out=run[1:])
    return mix((run[ends] - run[starts]) * powers(_INV, len(buf))[starts])


def scan(column: pa.Array, lower: bool = True, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column, and for each text the number of words before it."""
    buf, off = utf8(column)
    starts, ends, first = spans(buf, off, sep)
    return hashes(buf, starts, ends, lower), first


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words of one text; row of the text of each."""
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out *= _BASE
        out += h[k : k + total]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = row[:total] == row[n - 1 :]
    return mix(out[ok]), row[:total][ok]


def fold(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or (in local mode only, where every task can read
    it) a temporary one of our own where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexspark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def cleaning(spark: SparkSession):
    """Within, Spark deletes an execution's shuffle files when it ends: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def lean(spark: SparkSession) -> None:
    """Texts are long: send Python workers no more than ARROW_ROWS of them at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Tables of ``materialize``, which plans that were handed out read: they go when the driver ends.
_MADE: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session's JVM has ended before: nothing can be done from here
            return


def until_end(spark: SparkSession, path: str) -> str:
    """The path, which is deleted when the driver ends."""
    _MADE.append((spark, path))
    return path


class Scratch:
    """Tables of one job in a folder of their own within the shared folder; ``close`` deletes them
    once what is returned has been written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.path}/{name}-{uuid.uuid4().hex}")

    def close(self) -> None:
        _delete(self.spark, self.path)


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write as Parquet in the shared folder and read it back, until the driver ends."""
    return _written(df, until_end(df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"))


def column(name: str) -> Column:
    """A column by its whole name: dots and backticks in it are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame, without=()) -> list[Column]:
    """The columns of df, except those named (in any case) like one of ``without``."""
    clash = {x.lower() for x in without}
    return [column(c) for c in df.columns if c.lower() not in clash]


def unused(df: DataFrame, stem: str = "_x") -> str:
    """A prefix that no column of df begins with."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(stem.lower()) for c in taken):
        stem += "_"
    return stem


def mapped(df: DataFrame, run, more: str, inputs: int = 0) -> DataFrame:
    """df with the columns of a DDL string, as ``run`` yields them: lists of arrays for batches whose
    columns have names of our own (the text column's is "text"), so that the caller's may be any.
    The last ``inputs`` columns of df are for ``run`` alone."""
    names = ["text" if c.lower() == "text" else f"c{k}" for k, c in enumerate(df.columns)]
    kept, made = len(names) - inputs, StructType.fromDDL(more).fields
    schema = StructType()
    for name, f in [*zip(names[:kept], df.schema.fields), *((f"r{k}", f) for k, f in enumerate(made))]:
        schema.add(name, f.dataType, True, f.metadata)

    def whole(batches):
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.toDF(*names).mapInArrow(whole, schema).toDF(*df.columns[:kept], *(f.name for f in made))


def pack_sorted(x: np.ndarray) -> bytes:
    """A sorted list of 64-bit values: differences, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_ids(x: np.ndarray) -> bytes:
    """Ids of which few differ: a table of them and places in it, compressed."""
    table, at = np.unique(x, return_inverse=True)
    kind = np.uint8 if len(table) < 256 else np.uint16 if len(table) < 65536 else np.uint32
    raw = np.array([len(table), np.dtype(kind).itemsize], np.int64).tobytes() + table.astype(np.int64).tobytes() + at.astype(kind).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack_ids(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, width = np.frombuffer(raw, np.int64, 2)
    table = np.frombuffer(raw, np.int64, int(n), 16)
    return table[np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[int(width)], offset=16 + 8 * int(n))]


def pack_places(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32: byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_places(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def tasks(docs: DataFrame, text_bytes: int) -> int:
    """Shuffle partitions so that each has about ``text_bytes`` of text, and no fewer than the session's:
    what a task holds does not grow with the corpus."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(fold(docs.sparkSession), -(-int(size) // text_bytes))


def held_out(doc_id, mod: int):
    """True where crc32 of doc_id as text is divisible by mod (null ids count as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 0, F.lit(True))
