"""The folder that driver and executors share, for derived tables such as a search index."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexspark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_KEPT: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def until_end(spark: SparkSession, path: str) -> str:
    """The path, which is deleted when the driver ends."""
    _KEPT.append((spark, path))
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage is cut. Deleted when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _KEPT.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_path(spark: SparkSession, path: str, schema, folder: str) -> DataFrame:
    """What has been written to a path within a folder of the shared one, which goes when the driver ends."""
    _KEPT.append((spark, folder))
    return spark.read.schema(schema).parquet(path)


def keep_folder(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """df, which reads a folder of the shared one that goes when the driver ends."""
    _KEPT.append((spark, folder))
    return df


@atexit.register
def _clear() -> None:
    for spark, path in _KEPT:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session's JVM has ended before
            return
