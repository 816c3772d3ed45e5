"""Scans, watch rules and upkeep: the smaller jobs around the archive as DataFrame operations."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import rules

MAX_SCAN = 1000


def guarded_scan(df: DataFrame, columns: list[str], allowed: set[str], eq: dict | None = None, gte: dict | None = None, among: dict | None = None, order: list[Column] = (), limit: int = MAX_SCAN, offset: int = 0) -> DataFrame:
    """A single-table read of allowed columns only; values are literals, never SQL text."""
    eq, gte, among = eq or {}, gte or {}, among or {}
    odd = {*columns, *eq, *gte, *among} - allowed
    if odd or not 1 <= limit <= MAX_SCAN or offset < 0:
        raise ValueError(f"not allowed: {sorted(odd)}, limit {limit}, offset {offset}")
    for k, v in eq.items():
        df = df.where(F.col(k).isNull() if v is None else F.col(k) == v)
    for k, v in gte.items():
        df = df.where(F.col(k) >= v)
    for k, v in among.items():
        df = df.where(F.col(k).isin(list(v)))
    return (df.orderBy(*order) if order else df).offset(offset).limit(limit).select(*columns)


def failure_health(done: DataFrame, failed: DataFrame, by: str) -> DataFrame:
    """Successes and failures of each key from two tables, and the failure rate in per cent."""
    both = done.select(by, F.lit(1).alias("ok"), F.lit(0).alias("bad")).unionByName(failed.select(by, F.lit(0).alias("ok"), F.lit(1).alias("bad")))
    out = both.groupBy(by).agg(F.sum("ok").alias("succeeded"), F.sum("bad").alias("failed"))
    return out.withColumn("failure_rate", F.floor(100.0 * F.col("failed") / (F.col("succeeded") + F.col("failed")) + 0.5).cast("long"))


def interactions(df: DataFrame, by: str, clicks: Column, views: Column, n: int = 15) -> DataFrame:
    out = df.groupBy(by).agg(F.count_if(clicks).alias("clicks"), F.count_if(views).alias("views"))
    return out.withColumn("total", F.col("clicks") + F.col("views")).orderBy(F.desc("total"), F.asc(by)).limit(n)


def backlog(df: DataFrame, by: str, waiting: Column, ts: str, warning: int, critical: int) -> DataFrame:
    """Waiting rows of each key, the oldest, and a level by count."""
    out = df.where(waiting).groupBy(by).agg(F.count("*").alias("waiting"), F.min(ts).alias("oldest"))
    return out.withColumn("level", F.when(F.col("waiting") >= critical, "critical").when(F.col("waiting") >= warning, "warning").otherwise("ok"))


def status_object(df: DataFrame, by: str, status: str) -> DataFrame:
    """Counts per status as one JSON object per key, its names in order."""
    n = df.groupBy(by, status).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(status).alias("k"), "n")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["k"], F.lit('":'), p["n"])), ",")
    return n.groupBy(by).agg(F.concat(F.lit("{"), text, F.lit("}")).alias("counts"))


def related(links: DataFrame, item: str, tag: str, subject, n: int = 6) -> DataFrame:
    """Items that share most tags with one item, itself left out; ties go to the smaller id."""
    own = links.where(F.col(item) == subject).select(tag).distinct()
    shared = links.where(F.col(item) != subject).select(item, tag).distinct().join(own, tag, "left_semi")
    return shared.groupBy(item).agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), F.asc(item)).limit(n)


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of first, and those of second whose key first doesn't have."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def reconcile_append_only(stored: DataFrame, wanted: DataFrame, key: str, checksum: str) -> DataFrame:
    """key, action: insert, update, unchanged, or refuse where only the store has it."""
    a, b = stored.select(key, F.col(checksum).alias("_s")), wanted.select(key, F.col(checksum).alias("_w"))
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_w").isNull(), "refuse").when(F.col("_s") == F.col("_w"), "unchanged").otherwise("update")
    return a.join(b, key, "full").select(key, action.alias("action"))


def watchdog(runs: DataFrame, by: str, ts: str, ok: Column, now: datetime, silent_days: int, stale_days: int) -> DataFrame:
    """Per key: last run, last good run, and silent, failing, stale or ok."""
    out = runs.groupBy(by).agg(F.max(ts).alias("last_run"), F.max(F.when(ok, F.col(ts))).alias("last_ok"))
    kind = runs.schema[ts].dataType
    before = lambda days: F.lit(now - timedelta(days=days)).cast(kind)
    state = F.when(F.col("last_run") < before(silent_days), "silent").when(F.col("last_ok").isNull(), "failing").when(F.col("last_ok") < before(stale_days), "stale").otherwise("ok")
    return out.withColumn("state", state)


def source_violations(sources: DataFrame, runs: DataFrame, now: datetime, warning_seconds: int, critical_seconds: int, tie: str | None = None) -> DataFrame:
    """key, severity: what is wrong with the last runs of registered sources.

    sources: source; runs: source, status, outcome, started. Of runs that started together with one status, the one with
    the smallest ``tie`` (a number, such as the run's id) is the last. The last run says whether a source failed or
    was degraded; a source without any is silent; one that is not running is stale by its last completed
    run."""
    at = F.lit(now).cast(runs.schema["started"].dataType)
    order = F.struct("started", "status", *([] if tie is None else [-F.col(tie)]))
    last = runs.groupBy("source").agg(F.max_by(F.struct("status", "outcome"), order).alias("r"), F.max(F.when(F.col("status") == "completed", F.col("started"))).alias("ok"))
    j = sources.join(last, "source", "left")
    status, outcome = F.col("r.status"), F.col("r.outcome")
    age = F.unix_timestamp(at) - F.unix_timestamp("ok")
    found = lambda name, severity: F.struct(F.concat(F.lit(f"{name}:"), F.col("source").cast("string")).alias("key"), F.lit(severity).alias("severity"))
    bad = F.when((status == "failed") | ((status == "completed") & (outcome == "failed")), found("source-outcome", "critical")).when(outcome == "degraded", found("source-outcome", "warning"))
    idle = status != "running"
    late = F.when(status.isNull(), found("source-silent", "critical")).when(idle & (age > critical_seconds), found("source-freshness", "critical")).when(idle & (age > warning_seconds), found("source-freshness", "warning"))
    return j.select(F.explode(F.filter(F.array(bad, late), lambda x: x.isNotNull())).alias("v")).select("v.key", "v.severity")


def missed_window(runs: DataFrame, now: datetime, hours: int, paused: bool = False) -> DataFrame:
    """key, severity: one row where no source has completed a run for so many hours, unless paused."""
    limit = F.lit(now - timedelta(hours=hours)).cast(runs.schema["started"].dataType)
    last = runs.agg(F.max(F.when(F.col("status") == "completed", F.col("started"))).alias("ok"))
    return last.where((F.col("ok").isNull() | (F.col("ok") < limit)) & F.lit(not paused)).select(F.lit("missed-window").alias("key"), F.lit("critical").alias("severity"))


def heartbeat_violations(workflows: DataFrame, beats: DataFrame, now: datetime, seconds: int) -> DataFrame:
    """key, severity of workflows whose last heartbeat (workflow, status, seen) failed, is old or missing."""
    at = F.lit(now).cast(beats.schema["seen"].dataType)
    last = beats.groupBy("workflow").agg(F.max_by(F.struct("status", "seen"), "seen").alias("b"))
    j = workflows.join(last, "workflow", "left")
    old = F.unix_timestamp(at) - F.unix_timestamp("b.seen") > seconds
    severe = F.col("b").isNull() | (F.col("b.status") == "failed")
    return j.where(severe | old).select(F.concat(F.lit("workflow-heartbeat:"), F.col("workflow").cast("string")).alias("key"), F.when(severe, "critical").otherwise("warning").alias("severity"))


def run_outcome(*, failed: Column, errors: Column, discovered: Column, tried: Column, good: Column, bad: Column, attempted: Column, verified: Column, uncollected: Column, broken: Column, stale: Column, said: Column) -> Column:
    """Outcome of a source's run: what it says itself, else failed, degraded or success.

    tried, good, bad: attempts of discovery, and those that went well and wrong; attempted, verified and
    uncollected: candidates; broken, stale: a breaker is open, promotions are overdue."""
    n = lambda c: F.coalesce(c, F.lit(0))
    hard = (n(failed) > 0) | (n(errors) > 0) | ((n(discovered) == 0) & (n(tried) > 0) & (n(good) == 0) & (n(bad) > 0))
    poor = ((n(attempted) > 0) & (n(verified) == 0) & (n(uncollected) > 0)) | ((n(attempted) >= 3) & (2 * n(uncollected) >= n(attempted)))
    soft = poor | F.coalesce(broken, F.lit(False)) | F.coalesce(stale, F.lit(False))
    return F.when(said.isin("success", "degraded", "failed"), said).when(hard, "failed").when(soft, "degraded").otherwise("success")


def worst_outcome(outcome: Column) -> Column:
    """Aggregate: the worst outcome of a run's sources; a run without any has failed."""
    return F.when((F.count(outcome) == 0) | F.bool_or(outcome == "failed"), "failed").when(F.bool_or(outcome == "degraded"), "degraded").otherwise("success")


def retained(df: DataFrame, ts: str, now: datetime, days: int) -> DataFrame:
    """Rows that a retention of so many days (30 to 365) keeps."""
    if not 30 <= days <= 365:
        raise ValueError("retention must be 30 to 365 days")
    return df.where(F.col(ts) >= F.lit(now - timedelta(days=days)).cast(df.schema[ts].dataType))


def uncovered(tags: DataFrame, terms: DataFrame, name: str) -> DataFrame:
    """Tags that no glossary term covers by its slug, its names or those of the tags it is related to.

    terms: slug, term, korean, related (array of texts)."""
    covered = rules.covered_keys(terms).select(F.col("key").alias("covered_key"))
    return tags.join(covered, rules.tag_key(F.col(name)) == F.col("covered_key"), "left_anti")


def glossary_candidates(tags: DataFrame, known: DataFrame, name: str, count: str, alias: Column, least: int, n: int) -> DataFrame:
    """Frequent tags without a glossary term, one for each alias key."""
    rows = tags.where(F.col(count) >= least).withColumn("alias", alias).join(known.select("alias").distinct(), "alias", "left_anti")
    best = rows.groupBy("alias").agg(F.max_by(F.struct(name, count), F.struct(F.col(count), F.col(name))).alias("r"))
    return best.select("r.*", "alias").orderBy(F.desc(count), F.asc(name)).limit(n)


def embedding_readiness(versions: DataFrame, artifacts: DataFrame, key: str, width: int, vector: str) -> DataFrame:
    """One row: versions, those with a usable vector, missing, of wrong width, and orphans."""
    a = artifacts.select(key, (F.size(vector) == width).alias("fits")).groupBy(key).agg(F.max("fits").alias("fits"))
    j = versions.select(key).distinct().withColumn("v", F.lit(True)).join(a, key, "full")
    v = F.col("v").isNotNull()
    return j.agg(F.count_if(v).alias("versions"), F.count_if(v & F.col("fits")).alias("ready"), F.count_if(v & F.col("fits").isNull()).alias("missing"), F.count_if(v & ~F.col("fits")).alias("wrong_width"), F.count_if(~v).alias("orphans"))


def text_page(text: Column, offset: int, limit: int) -> list[Column]:
    """A piece of a long text, whether more follows, and where it goes on (null at the end)."""
    more = F.char_length(text) > offset + limit
    return [F.substring(text, offset + 1, limit).alias("piece"), more.alias("has_more"), F.when(more, F.lit(offset + limit)).alias("next_offset")]


def access(text: Column, policy: Column, excerpt: int = 2000) -> Column:
    """full, excerpt (its first characters) or nothing."""
    return F.when(policy == "full", text).when(policy == "excerpt", F.substring(text, 1, excerpt))


def all_terms(fields: list[Column], terms: list[str]) -> Column:
    """Every term occurs in the joined fields, in any case."""
    hay = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(True)
    for t in terms:
        out = out & hay.contains(t.lower())
    return out


def in_order(df: DataFrame, ids: DataFrame, key: str, rank: str) -> DataFrame:
    """The rows of a ranked id list, in its order."""
    return ids.select(key, rank).join(df, key).orderBy(rank)


def recover_stale(jobs: DataFrame, state: str, ts: str, now: datetime, minutes: int = 30) -> DataFrame:
    """Work that has run for longer than so many minutes is marked failed."""
    old = F.col(ts) < F.lit(now - timedelta(minutes=minutes)).cast(jobs.schema[ts].dataType)
    return jobs.withColumn(state, F.when((F.col(state) == "running") & old, "failed").otherwise(F.col(state)))


def first_group_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Union in which a key is kept from the first part that has it."""
    cols = parts[0].columns
    tagged = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        tagged = tagged.unionByName(p.withColumn("_part", F.lit(i)))
    return tagged.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("_part", *cols)).alias("r")).select("r.*")


def jobs_by_state(jobs: DataFrame, by: str, state: str, ts: str) -> DataFrame:
    """Per stage and state: jobs and the oldest."""
    return jobs.groupBy(by, state).agg(F.count("*").alias("jobs"), F.min(ts).alias("oldest"))


def page_with_count(rows: DataFrame, filters: dict, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of the rows that have the given values (None filters nothing), with the exact number of all of them; the
    count and the page are one scan each, and the number of rows (total) goes with every row of the page."""
    if not 1 <= limit <= MAX_SCAN or offset < 0:
        raise ValueError("limit or offset out of range")
    some = rows
    for k, v in filters.items():
        if v is not None:
            some = some.where(F.col(k) == v)
    return some.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(some.agg(F.count("*").alias("total"))))  # one row


def aliases_per_concept(aliases: DataFrame, concept: str, order: list[Column], n: int = 8) -> DataFrame:
    w = Window.partitionBy(concept).orderBy(*order)
    return aliases.withColumn("alias_rank", F.row_number().over(w)).where(F.col("alias_rank") <= n)
