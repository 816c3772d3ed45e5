"""Usage, health and tagging aggregates: every one a groupBy with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import kst_day, percent


def popular(events: DataFrame, key: str, ts: str, title: str, n: int = 12) -> DataFrame:
    """Views per key with the oldest title, top n; the key breaks ties."""
    got = events.groupBy(key).agg(F.count("*").alias("views"), F.min_by(title, F.struct(ts, title)).alias("title"))
    return got.orderBy(F.desc("views"), F.asc(key)).limit(n)


def dimension_top(events: DataFrame, dims: dict[str, Column], n: int = 10) -> DataFrame:
    """Top n values of several dimensions at once; blank values count as unknown.

    One pass: dimensions are exploded and counted together (map-side combined), and only
    counted rows are ranked."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.coalesce(F.nullif(F.trim(v.cast("string")), F.lit("")), F.lit("unknown")).alias("key")) for k, v in dims.items())))
    counted = events.select(pairs.alias("p")).groupBy("p.dimension", "p.key").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc("key"))
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def timeline(events: DataFrame, ts: str, measures: dict[str, Column], last: int = 60) -> DataFrame:
    """Filtered counts per Seoul day, the latest days only."""
    got = events.groupBy(kst_day(F.col(ts)).alias("day")).agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in measures.items()))
    return got.orderBy(F.desc("day")).limit(last)


def filtered_counts(df: DataFrame, measures: dict[str, Column], by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*(F.count_if(c).alias(k) for k, c in measures.items()))


def query_stats(events: DataFrame, query: Column, results: Column, mode: Column, n: int = 50) -> DataFrame:
    got = events.select(query.alias("query"), results.alias("r"), mode.alias("m")).where("query is not null").groupBy("query")
    out = got.agg(F.count("*").alias("n"), F.count_if(F.col("r") == 0).alias("zero"), F.round(F.avg("r")).alias("avg_results"), F.array_join(F.array_sort(F.collect_set("m")), ",").alias("modes"))
    return out.orderBy(F.desc("n"), F.asc("query")).limit(n)


def status_rollup(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.max(ts).alias("latest"))


def latest_per_key(df: DataFrame, key: str, order: list[Column], fields: list[str]) -> DataFrame:
    """The latest row of each key, as an aggregate (max_by), so it combines map-side."""
    latest = F.max_by(F.struct(*fields), F.struct(*order)).alias("row")
    return df.groupBy(key).agg(latest).select(key, *(F.col(f"row.{f}").alias(f) for f in fields))


def health(df: DataFrame, by: str, done: Column, found: Column, fetched: Column) -> DataFrame:
    got = df.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(done).alias("completed"), F.sum(found).alias("found"), F.sum(fetched).alias("fetched"))
    return got.withColumn("fetch_rate", percent(F.col("fetched"), F.col("found")))


def tag_counts(tags: DataFrame, links: DataFrame, tag: str, ts: str, changed_only: bool = False) -> DataFrame:
    """Count and latest date of each tag in one pass; changed_only keeps rows that differ from what is stored."""
    got = links.groupBy(tag).agg(F.count("*").alias("n"), F.max(ts).alias("latest"))
    out = tags.join(got, tag, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if changed_only:
        out = out.where(~F.col("stored_n").eqNullSafe(F.col("n")) | ~F.col("stored_latest").eqNullSafe(F.col("latest")))
    return out


def hourly(events: DataFrame, ts: str, kind: str) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", ts).cast("timestamp_ntz").alias("bucket"), kind).agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


#: So many groups' bounds are handed to all tasks; of more, groups meet their bounds by a shuffle.
FEW_GROUPS = 10_000


def percentiles(df: DataFrame, value: str, by: list[str], p: float, accuracy: int = 10_000) -> DataFrame:
    """Exact percentiles: nearest rank and linear interpolation; nulls don't count.

    One pass gives each group's size and, by a mergeable sketch, two values between which the wanted ranks lie
    (a sketch's ranks are off by n / accuracy at most). A second pass counts what lies below them, and the values
    between, a few ten-thousandths of the rows, by value; both passes combine map-side, however large a group is. Only
    the distinct values between are put in order."""
    v = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null")
    slacks = [3 / accuracy, 30 / accuracy, 300 / accuracy, 1.0]  # the narrowest that holds two ranks and the sketch's error
    ends = F.percentile_approx("v", F.array(*(F.lit(min(1.0, max(0.0, p + s))) for d in slacks for s in (-d, d))), accuracy)
    facts = v.groupBy(*by).agg(F.count("*").alias("n"), ends.alias("q"))
    enough = [F.col("n") * (d - 1 / accuracy) >= 2 for d in slacks[:-1]]
    pick = lambda side: F.coalesce(*(F.when(ok, F.col("q")[2 * k + side]) for k, ok in enumerate(enough)), F.col("q")[2 * len(enough) + side])
    facts = facts.select(*by, "n", pick(0).alias("from_"), pick(1).alias("to_"))
    few = facts.limit(FEW_GROUPS + 1).collect()  # one row for each group
    if len(few) <= FEW_GROUPS:  # the rows stay where they are, and no task gets a whole group
        facts = F.broadcast(df.sparkSession.createDataFrame(few, facts.schema))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    near = v.alias("x").join(facts.alias("f"), same).where("v <= to_").select(*(F.col(f"x.{c}").alias(c) for c in by), F.when(F.col("v") >= F.col("from_"), F.col("v")).alias("v"), "n")
    counts = near.groupBy(*by, "v").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    ordered = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("v"))))  # what lies below (null) comes first
    place = p * (F.col("n") - 1)
    at = lambda rank: F.max(F.when((rank > F.col("upto") - F.col("c")) & (rank <= F.col("upto")), F.col("v")))
    got = ordered.groupBy(*by).agg(at(F.greatest(F.ceil(p * F.col("n")), F.lit(1))).alias("nearest"), at(F.floor(place) + 1).alias("a"), at(F.ceil(place) + 1).alias("b"), F.max("n").alias("n"))
    share = p * (F.col("n") - 1) - F.floor(p * (F.col("n") - 1))
    return got.select(*by, "nearest", F.round(F.col("a") + (F.col("b") - F.col("a")) * share, 6).alias("linear"))


def round_robin(df: DataFrame, source: str, order: list[Column], n: int) -> DataFrame:
    """Interleave sources: the first of each, then the second of each, ...

    Only the first n of each source can be taken, so ranks are cut before the final sort."""
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", source).limit(n)
