"""Stateful and incremental jobs: the same functions on batch and on streaming DataFrames."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

# The stages, in order.
STAGES = ("discovery", "crawl", "normalize", "translate", "public-judgment", "publish", "search")


def rate_limit(events: DataFrame, key: str, ts: str, order: str, seconds: int, limit: int) -> DataFrame:
    """Fixed windows that open at a key's first hit: adds window_start, n (in the window) and allowed.

    A window's start depends on the one before, which built-in windows cannot say; but where a key has
    no hit for at least a window's length, the next hit opens one whatever came before. Keys are cut at
    such gaps (found with one range window of built-in functions), and the pieces, not the keys, are
    streamed through sorted partitions, with one window of state at a time. Only a key that never
    pauses is one piece."""
    events = events.withColumn("ts_", F.col(ts))
    line = Window.partitionBy(key).orderBy("ts_", order)
    gap = F.unix_micros(F.col("ts_").cast("timestamp")) - F.unix_micros(F.lag("ts_").over(line).cast("timestamp"))
    cut = F.when(gap.isNull() | (gap >= seconds * 1_000_000), 1).otherwise(0)
    pieces = events.select(key, order, "ts_", cut.alias("cut"))
    pieces = pieces.select(key, order, F.col("ts_").alias("ts"), F.sum("cut").over(line).alias("piece"))
    rows = pieces.repartition(key, "piece").sortWithinPartitions(key, "piece", "ts", order)
    span = pd.Timedelta(seconds=seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, n = None, None, 0
        for pdf in batches:
            starts, counts = [], []
            for k, piece, t in zip(pdf[key], pdf["piece"], pdf["ts"]):
                if (k, piece) != last or t >= start + span:
                    last, start, n = (k, piece), t, 0
                n += 1
                starts.append(start)
                counts.append(n)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "window_start": starts, "n": counts, "allowed": [c <= limit for c in counts]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, window_start {kinds['ts']}, n long, allowed boolean")


class _Windows(StatefulProcessor):
    """A key's open window (start and hits so far), its one timer, and the hits that the watermark has not reached,
    an entry for each batch that brought some."""

    def __init__(self, seconds: int, limit: int, columns: list[str], state: str):
        self.width, self.limit, self.columns, self.state = seconds * 1_000_000, limit, columns, state

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n long, timer long")
        self.waiting = handle.getListState("waiting", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        us = pdf["us"].tolist()
        self.waiting.appendValue((us, pdf["at"].tolist()))
        start, n, timer = self._window()
        self._wake(start, n, timer, -(-min(us) // 1000))
        yield from ()

    def _window(self) -> tuple[int, int, int]:
        """Start, hits and timer; no hits if none is open, a timer of -1 if none is set."""
        return self.window.get() or (0, 0, -1)

    def _wake(self, start: int, n: int, timer: int, at: int) -> None:
        """Keep the window and see that the key's timer is not later than a time."""
        if timer < 0 or at < timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        self.window.update((start, n, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the watermark is where no earlier hit can come: all hits up to it are answered at once
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        hits = sorted(h for us, at in self.waiting.get() for h in zip(us, at))
        ready = bisect_right(hits, upto, key=lambda h: h[0])
        later = hits[ready:]
        start, n, _ = self._window()
        out = []
        for us, at in hits[:ready]:
            if not n or us >= start + self.width:
                start, n = us, 0
            n += 1
            out.append((*key, at, start, n, n <= self.limit))
        if not later:
            self.waiting.clear()
        elif ready:
            self.waiting.put([tuple(map(list, zip(*later)))])
        if n and upto >= start + self.width:  # the window is over: nothing of it is kept
            start, n = 0, 0
        if later or n:
            self._wake(start, n, -1, -(-(later[0][0] if later else start + self.width) // 1000))
        else:
            self.window.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, key: str, ts: str, order: str, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """The same limiter on a stream, hit by hit: key, order, window_start, n, allowed, as ``rate_limit`` says of
    the same hits.

    Hits wait until the watermark (``late`` behind the latest hit) has passed them, so those of a key may come in any order
    within that time; what is later is dropped. A key has one timer, at its first waiting hit or else at its window's end: it
    answers all hits that the watermark has passed, in order, and forgets a window that is over. So each hit is read from
    state once for each batch that moves the watermark past some of its key's, and state holds the hits of the last
    ``late`` and one window of each key that was active. Needs the RocksDB state store (``session`` sets it)."""
    at = events.schema[order].dataType.simpleString()
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, F.col(order).alias("at"), F.col(ts).cast("timestamp").alias("event_time"))
    rows = rows.withWatermark("event_time", late).withColumn("us", F.unix_micros("event_time"))
    done = rows.groupBy(key).transformWithStateInPandas(
        _Windows(seconds, limit, [key, order, "start", "n", "allowed"], f"us array<long>, at array<{at}>"), f"{key} {kind}, {order} {at}, start long, n long, allowed boolean", "append", "EventTime"
    )
    return done.select(key, order, F.timestamp_micros("start").cast("timestamp_ntz").alias("window_start"), "n", "allowed")


def register(jobs: DataFrame, existing: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """Idempotent registration: the first of each key, unless known already."""
    cols = jobs.columns
    first = jobs.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")
    return first if existing is None else first.join(existing.select(*keys), keys, "left_anti")


def next_stage(stage: Column) -> Column:
    """The stage behind a stage, null behind the last."""
    c = F.lit(None).cast("string")
    for a, b in zip(STAGES, STAGES[1:]):
        c = F.when(stage == a, b).otherwise(c)
    return c


def claimable(jobs: DataFrame, now, n: int) -> DataFrame:
    """Jobs that may be claimed: pending or with an expired lease, due, by priority."""
    ready = (F.col("state") == "pending") | ((F.col("state") == "leased") & (F.col("lease_until") < now))
    return jobs.where(ready & (F.col("due_at") <= now) & (F.col("attempts") < F.col("max_attempts"))).orderBy(F.desc("priority"), "due_at", "job_id").limit(n)


def running_counts(events: DataFrame, key: str) -> DataFrame:
    """Incremental view counter; use update mode on streams."""
    return events.groupBy(key).agg(F.count("*").alias("views"))


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark on streams."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), kind, "n")


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over all there is, batch by batch, then stop; the checkpoint makes it resume."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
