"""Streams: the limiter says what the batch says, stages survive a restart anywhere."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from lexspark.streaming import jobs, stages

START = datetime(2026, 1, 1)


def _write(spark, rows, path):
    spark.createDataFrame(rows, "id long, u long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)


def _run(spark, src, out, cp, late):
    events = spark.readStream.schema("id long, u long, ts timestamp_ntz").parquet(src)
    got = jobs.rate_limit_stream(events, "u", "ts", "id", 60, 2, late)
    got.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return got.schema


def test_limiter_on_a_stream_is_the_batch(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3]), START + timedelta(seconds=rnd.randint(0, 900), microseconds=rnd.randint(0, 3))) for i in range(200)]
    rows.sort(key=lambda r: r[2])
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in range(0, 200, 50):  # within a part, in any order; the checkpoint carries state from run to run
        own = rows[part : part + 50]
        rnd.shuffle(own)
        _write(spark, own, src)
        schema = _run(spark, src, out, cp, "2 minutes")
    _write(spark, [(-1, -1, START + timedelta(days=2))], src)
    _run(spark, src, out, cp, "2 minutes")
    want = jobs.rate_limit(spark.createDataFrame(rows, "id long, u long, ts timestamp_ntz"), "u", "ts", "id", 60, 2)
    got = spark.read.schema(schema).parquet(out)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_limiter_forgets(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    _write(spark, [(i, i, START + timedelta(seconds=i)) for i in range(300)], src)
    _run(spark, src, out, cp, "0 seconds")
    _write(spark, [(-1, -1, START + timedelta(days=1))], src)
    _run(spark, src, out, cp, "0 seconds")
    _write(spark, [(-2, -2, START + timedelta(days=2))], src)
    events = spark.readStream.schema("id long, u long, ts timestamp_ntz").parquet(src)
    q = jobs.rate_limit_stream(events, "u", "ts", "id", 60, 2, "0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert spark.read.parquet(out).count() >= 300 and kept[-1] < 30  # three hundred windows were open once


def test_limiter_asks_state_once_for_all_hits_that_are_due():
    """A key's hits that the watermark has passed cost one timer and one reading of state, however many they are."""

    class State(list):
        def __init__(self, calls):
            super().__init__()
            self.calls = calls

        def get(self):
            self.calls.append("get")
            return iter(list(self))

        def put(self, rows):
            self[:] = rows

        def appendList(self, rows):
            self.extend(rows)

        appendValue = list.append

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.timers, self.calls = set(), []

        def getValueState(self, name, schema):
            return Value()

        def getListState(self, name, schema):
            return State(self.calls)

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

    handle, w = Handle(), jobs._Windows(60, 2, ["u", "id", "start", "n", "allowed"], "")
    w.init(handle)
    times = [7_000_000 * i for i in range(1, 501)]
    for part in (times[250:], times[:250]):  # the later ones first
        assert not list(w.handleInputRows((1,), iter([pd.DataFrame({"us": part, "at": part})]), TimerValues(0, 0)))
    got, watermark = [], 4_000_000
    while any(t <= watermark for t in handle.timers):
        t = min(handle.timers)
        handle.timers.discard(t)
        for pdf in w.handleExpiredTimer((1,), TimerValues(0, watermark), ExpiredTimerInfo(t)):
            got += pdf["id"].tolist()
    assert got == times and len(handle.calls) <= 2 and not handle.timers and not w.waiting and not w.window.exists()


def _works(fail=()):
    def work(stage):
        def run(messages):
            return messages.withColumn("status", F.when((F.col("article") == "3") & (stage == "normalize"), "failed").otherwise("succeeded")).withColumn("hash", F.concat("hash", F.lit(stage[0])))

        return run

    return {s: work(s) for s in jobs.STAGES}


def _table(all_):
    return sorted(map(tuple, all_.done().collect()))


def test_stages_and_redelivery(spark, tmp_path):
    all_ = stages.Stages(spark, str(tmp_path / "s"))
    articles = spark.createDataFrame([(str(i), "1", "h") for i in range(6)], "article string, version string, hash string")
    all_.submit(articles, 0)
    all_.run(_works())
    once = _table(all_)
    assert {(r.article, r.stage, r.status) for r in all_.state().collect()} == {(str(i), "normalize" if i == 3 else "search", "failed" if i == 3 else "succeeded") for i in range(6)}
    assert len(once) == 5 * 7 + 3
    all_.submit(articles, 1)
    all_.run(_works())
    assert _table(all_) == once
    all_.submit(articles.limit(1).withColumn("version", F.lit("2")), 2)
    all_.run(_works())
    assert len(_table(all_)) == len(once) + 7


@pytest.mark.parametrize("stage, after", [("discovery", "work"), ("crawl", "done"), ("translate", "sent")])
def test_restart_leaves_the_same_rows(spark, tmp_path, monkeypatch, stage, after):
    articles = spark.createDataFrame([(str(i), "1", "h") for i in range(5)], "article string, version string, hash string")
    plain, broken = stages.Stages(spark, str(tmp_path / "a")), stages.Stages(spark, str(tmp_path / "b"))
    for s in (plain, broken):
        s.submit(articles, 0)
    plain.run(_works())
    works, send = _works(), stages.Stages._send

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if after == "work":
            works[stage] = die
        else:
            following = jobs.STAGES[jobs.STAGES.index(stage) + 1]

            def sending(self, rows, to, sender, batch):
                if to == following and after == "done":
                    die()
                send(self, rows, to, sender, batch)
                if to == following:
                    die()

            m.setattr(stages.Stages, "_send", sending)
        with pytest.raises(Exception, match="lost"):
            broken.run(works)
    broken.run(_works())
    assert _table(broken) == _table(plain)


def test_ids(spark):
    df = spark.createDataFrame([("a|b", "crawl", "1", "h")], "a string, s string, v string, h string").withColumn("id", stages.message_id(F.col("a"), F.col("s"), F.col("v"), F.col("h")))
    back = df.select(stages.parse_id(F.col("id")).alias("p"), stages.parse_id(F.lit("x")).alias("x"), stages.parse_id(F.replace("id", F.lit("crawl"), F.lit("none"))).alias("y")).first()
    assert tuple(back.p) == ("a|b", "crawl", "1", "h") and back.x is None and back.y is None
