"""The stages of ingestion as chained streams over tables in a shared folder.

A message is one version of an article at one stage; its id is made of exactly that, so whatever is delivered
again is the same message.  A stage reads its messages as a stream, works on those that it has not done yet, and
writes in each micro-batch what it did (``done``) and the next stage's messages, each into a folder of the
batch's number, overwritten if the batch is run again.  So a job that dies anywhere, between the two
writes too, leaves after its restart the rows that it would have left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.streaming import jobs

MESSAGE = "id string, article string, stage string, version string, hash string"
DONE = "id string, article string, stage string, version string, hash string, status string"
# How a message's id is put together.
PREFIX, MARK = "ingest-stage", "\x1f"

Work = Callable[[DataFrame], DataFrame]


def message_id(article: Column, stage: Column, version: Column, digest: Column) -> Column:
    return F.concat_ws(MARK, F.lit(PREFIX), article, stage, version, digest)


def parse_id(c: Column) -> Column:
    """struct<article,stage,version,hash>, null if it isn't an id."""
    parts = F.split(c, MARK, -1)
    ok = (F.size(parts) == 5) & (F.get(parts, F.lit(0)) == PREFIX) & F.get(parts, F.lit(2)).isin(*jobs.STAGES)
    return F.when(ok, F.struct(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("article", "stage", "version", "hash"), 1))))


class Stages:
    """Stages under a folder: messages/<stage>, done/<stage>, checkpoints/<stage>."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        self._folder(name)
        # the batch's number stands in the path, so that a table of no batch yet has it too
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "batch=(\\d+)", 1).cast("long"))

    def _folder(self, name: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)

    def submit(self, articles: DataFrame, batch: int) -> None:
        """Enter articles (article, version, hash) at the first stage, as the given batch."""
        self._send(articles, jobs.STAGES[0], "submitted", batch)

    def _send(self, rows: DataFrame, stage: str, sender: str, batch: int) -> None:
        named = [F.col(c).cast("string").alias(c) for c in ("article", "version", "hash")]
        made = rows.select(*named).withColumn("stage", F.lit(stage))
        made = made.select(message_id(*(F.col(c) for c in ("article", "stage", "version", "hash"))).alias("id"), "article", "stage", "version", "hash")
        made.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{self.path}/messages/{stage}/{sender}-batch={batch}")

    def _sink(self, stage: str, work: Work):
        following = dict(zip(jobs.STAGES, jobs.STAGES[1:])).get(stage)

        def sink(messages: DataFrame, batch: int) -> None:
            # what other batches did, but not what this one may have written before it died
            before = self._read(f"done/{stage}", DONE).where(F.col("batch") != batch)
            fresh = jobs.register(messages.select(*(f.split()[0] for f in MESSAGE.split(", "))), before, ["id"], "id")
            out = f"{self.path}/done/{stage}/batch={batch}"
            work(fresh).select("id", "article", "stage", "version", "hash", "status").write.mode("overwrite").parquet(out)
            if following is not None:
                did = self.spark.read.schema(DONE).parquet(out).where("status = 'succeeded'")
                self._send(did, following, stage, batch)

        return sink

    def run(self, work: dict[str, Work]) -> None:
        """Drain every stage in order. work: what a stage makes of its messages: the same rows with status
        (succeeded or failed), and the hash of what it made."""
        for stage in jobs.STAGES:
            self._folder(f"messages/{stage}")
            stream = self.spark.readStream.schema(MESSAGE).option("recursiveFileLookup", "true").parquet(f"{self.path}/messages/{stage}")
            jobs.drain(stream, f"{self.path}/checkpoints/{stage}", self._sink(stage, work[stage]))

    def done(self) -> DataFrame:
        """Every message that was worked on, with its status."""
        out = None
        for stage in jobs.STAGES:
            one = self._read(f"done/{stage}", DONE).drop("batch")
            out = one if out is None else out.unionByName(one)
        return out

    def state(self) -> DataFrame:
        """article, version, stage, status: how far each article's version has come."""
        place = F.array_position(F.array(*map(F.lit, jobs.STAGES)), F.col("stage"))
        last = self.done().groupBy("article", "version").agg(F.max_by(F.struct("stage", "status"), place).alias("r"))
        return last.select("article", "version", "r.stage", "r.status")
