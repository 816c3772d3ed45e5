"""Queries that run streams to their end over the driver's tables, with their oracles."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark import shared
from lexspark.functions import text
from lexspark.plans.catalogue import ORACLES, QUERIES
from lexspark.streaming import jobs, stages

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession):
    """The state store that timers need, for the streams within."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _table(spark: SparkSession, schema, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is a folder or one file (a stream reads folders)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    source = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return source.parquet(f"{folder}/{name}")
    return source.option("pathGlobFilter", name).parquet(folder)


def _registered(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


@_registered(ORACLES["rate_limit_fixed_window"])
def rate_limit_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter as a stream that is drained: what the batch says of the same events. A last event of nobody's,
    far behind all others, moves the watermark past them."""
    path = f"{shared.shared_dir(spark)}/limited-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    last = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"))
    last.write.parquet(f"{path}/last")
    both = _table(spark, events.schema, sf_dir, "events.parquet").unionByName(spark.readStream.schema(events.schema).parquet(f"{path}/last"))
    with _state_store(spark):
        limited = jobs.rate_limit_stream(both, "user_id", "ts", "event_id", 3600, 3)
        limited.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return shared.keep_path(spark, f"{path}/out", limited.schema, path)


_WORDS = "len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"


@_registered(
    f"""SELECT CAST(doc_id AS VARCHAR) AS article, CASE WHEN trim(text) = '' THEN 'crawl' WHEN {_WORDS} < 20 THEN 'normalize' WHEN lang = 'de' AND doc_id % 5 = 0 THEN 'public-judgment' ELSE 'search' END AS stage,
CASE WHEN trim(text) = '' OR {_WORDS} < 20 OR (lang = 'de' AND doc_id % 5 = 0) OR length(text) < 200 THEN 'failed' ELSE 'succeeded' END AS status FROM documents"""
)
def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every document comes through the seven stages, each a stream; all are submitted twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("article"), "text", "lang")
    path = f"{shared.shared_dir(spark)}/stages-{uuid.uuid4().hex}"
    all_ = stages.Stages(spark, path)
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rules = {"crawl": F.trim("text") != "", "normalize": words >= 20, "public-judgment": ~((F.col("lang") == "de") & (F.col("article").cast("long") % 5 == 0)), "search": F.char_length("text") >= 200}
    made = {"crawl": F.sha2(F.col("text").cast("binary"), 256), "normalize": text.content_hash(F.col("text"))}

    def work(stage):
        def run(messages):
            j = messages.join(docs, "article")
            ok = F.coalesce(rules.get(stage, F.lit(True)), F.lit(False))
            return j.withColumn("status", F.when(ok, "succeeded").otherwise("failed")).withColumn("hash", F.coalesce(made.get(stage, F.col("hash")), F.col("hash")))

        return run

    works = {s: work(s) for s in jobs.STAGES}
    for batch in (0, 1):
        all_.submit(docs.select("article", F.lit("1").alias("version"), F.lit("seen").alias("hash")), batch)
        all_.run(works)
    return shared.keep(all_.state().select("article", "stage", "status"), "stage-states")
