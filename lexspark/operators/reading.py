"""Reads of the archive: parameterised SQL, JSON columns, public lists, tags of articles, admin views."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.operators.publication import snippet

# Statuses that call for attention, and keys under which a case number may stand.
ATTENTION = ("metadata_only", "robots_disallowed", "blocked", "timeout", "failed_fetch", "failed_summary", "needs_review")
CASE_NUMBER_KEYS = ("caseNumber", "case_number", "docketNumber", "docket_number", "docket", "decisionNumber", "resolutionNumber")
NO_SUMMARY = "요약이 아직 생성되지 않았습니다."

_yes = lambda c: F.coalesce(c, F.lit(False))


def authored(spark: SparkSession, sql: str, args: dict | None = None, json: dict[str, str] | None = None, **tables: DataFrame) -> DataFrame:
    """An authored SELECT over tables ({name} in the text), with values as named parameters (:name) and
    never as text; ``json`` columns are revived."""
    return revive(spark.sql(sql, args=args or {}, **tables), json or {})


def revive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """JSON text columns as values of a DDL type; text that is no JSON stops the job."""
    for name, kind in columns.items():
        broken = F.col(name).isNotNull() & F.try_parse_json(F.col(name)).isNull()
        value = F.from_json(F.col(name), kind)
        df = df.withColumn(name, F.when(broken, F.raise_error(F.concat(F.lit(f"{name} is not valid JSON: "), F.substring(name, 1, 80))).cast(kind)).otherwise(value))
    return df


def textually_true(json: Column, path: str) -> Column:
    """Whether a place in a JSON text is true or "true"; numbers and broken JSON are not."""
    at = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return _yes(F.schema_of_variant(at).isin("BOOLEAN", "STRING") & (F.try_variant_get(at, "$", "string") == "true"))


def first_of(json: Column, keys=CASE_NUMBER_KEYS) -> Column:
    """The first of several keys of a JSON object that has a value."""
    return F.coalesce(*(F.get_json_object(json, f"$.{k}") for k in keys))


def leafs(summary: Column, metadata: Column) -> list[Column]:
    """Leafs of JSON texts under list names: one_line_summary, case_number, resolution_type."""
    return [F.get_json_object(summary, "$.summary.coreSummary[0]").alias("one_line_summary"), F.get_json_object(metadata, "$.caseNumber").alias("case_number"), F.get_json_object(metadata, "$.resolutionType").alias("resolution_type")]


def list_item(korean: Column, original: Column, summary: Column, line: Column) -> list[Column]:
    """Title and line of a list item with what stands in where they are missing."""
    filled = lambda c: F.when(c != "", c)
    title = F.coalesce(filled(korean), filled(F.get_json_object(summary, "$.koreanTitle")), original)
    return [title.alias("title"), F.coalesce(filled(line), filled(F.get_json_object(summary, "$.summary.coreSummary[0]")), F.lit(NO_SUMMARY)).alias("one_line_summary"), summary.isNotNull().alias("summary_available")]


def public_articles(articles: DataFrame, publications: DataFrame, versions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """article_id of the articles that may be shown: published, summarised, not stale, said to be
    publishable, and, where the catalogue has them, enriched from the anchor it names.

    articles: article_id, status, stale, metadata; publications: article_id, version_id, state;
    versions: article_id, version_id, role, anchor_id, source_hash, enriched_hash; catalogue: article_id,
    anchor_id, state."""
    p = publications.where("state = 'published'").select("article_id", "version_id")
    a = articles.where((F.col("status") == "summarized") & ~_yes(F.col("stale")) & textually_true(F.col("metadata"), "$.collection.publishable")).select("article_id")
    v = versions.select("article_id", "version_id", "role", "anchor_id", "enriched_hash")
    c = catalogue.where("state = 'published'").select("article_id", F.col("anchor_id").alias("named"), F.lit(True).alias("listed"))
    anchors = versions.select(F.col("version_id").alias("named"), F.col("role").alias("anchor_role"), F.col("source_hash").alias("anchor_hash"))
    j = p.join(v, ["article_id", "version_id"]).join(a, "article_id", "left_semi").join(c, "article_id", "left").join(anchors, "named", "left")
    anchored = (F.col("role") == "enrichment_full") & (F.col("anchor_id") == F.col("named")) & (F.col("anchor_role") == "authoritative_source") & (F.col("anchor_hash") != "") & (F.col("enriched_hash") == F.col("anchor_hash"))
    return j.where(F.col("listed").isNull() | _yes(anchored)).select("article_id").distinct()


def latest_first(df: DataFrame, date: str, key: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(date), F.asc(key))


def with_tags(articles: DataFrame, links: DataFrame, tags: DataFrame, key: str = "article_id", tag: str = "tag_id") -> DataFrame:
    """articles with article_tags, in order of slug: array<struct<slug,confidence,name>>, empty where none.

    links: key, tag, confidence; tags: tag, slug, name. Two joins and one shuffle by article."""
    named = links.select(key, tag, "confidence").join(tags.select(tag, "slug", "name"), tag)
    per = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("slug", "confidence", "name"))).alias("article_tags"))
    return articles.join(per, key, "left").withColumn("article_tags", F.coalesce("article_tags", F.array().cast(per.schema["article_tags"].dataType)))


def tag_list(tags: DataFrame, kind: str | None, least: int, sort: str, limit: int) -> DataFrame:
    """Tags of a type with so many articles, by count, name or date of the latest."""
    orders = {"count": [F.desc("article_count"), F.asc("name")], "name": [F.asc("name")], "latest": [F.desc_nulls_last("latest_article_at"), F.asc("name")]}
    if sort not in orders or not 1 <= limit <= 1000:
        raise ValueError(f"sort {sort} or limit {limit} is not allowed")
    some = tags.where(F.col("article_count") >= least)
    return (some if kind is None else some.where(F.col("type") == kind)).orderBy(*orders[sort]).limit(limit)


def attention(status: Column, updated: Column, decision: Column, now: datetime, minutes: int = 30) -> Column:
    """Whether an article calls for attention: a bad status, or summarising for too long; closed ones never."""
    stale = (status == "summarizing") & (updated < F.lit(now - timedelta(minutes=minutes)).cast("timestamp_ntz"))
    return (_yes(status.isin(*ATTENTION)) | _yes(stale)) & (F.coalesce(decision, F.lit("")) != "closed_private")


def admin_page(articles: DataFrame, filters: dict, publishable: str = "all", summary: str = "all", page: int = 1, size: int = 20, key: str = "id", updated: str = "updated_at") -> DataFrame:
    """A page of the admin list with the exact total and whether more follow.

    publishable and summary: all, yes or no, of the columns ``publishable`` and ``has_summary``."""
    want = {"yes": True, "no": False}
    rows = articles
    for k, v in filters.items():
        if v is not None:
            rows = rows.where(F.col(k) == v)
    for column, asked in (("publishable", publishable), ("has_summary", summary)):
        if asked != "all":
            rows = rows.where(_yes(F.col(column)) == want[asked])
    start = (page - 1) * size
    total = rows.agg(F.count("*").alias("total"))
    got = rows.orderBy(F.desc_nulls_last(updated), F.asc(key)).offset(start).limit(size)
    return got.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > start + size)  # one row


def status_counts(sources: DataFrame, candidates: DataFrame, key: str, status: str, statuses: list[str], times: list[str]) -> DataFrame:
    """Candidates of each source by status and the latest of some times; sources without any count 0, and
    those that are not registered are there too."""
    n = candidates.groupBy(key).agg(*(F.count_if(F.col(status) == s).alias(f"{s}_count") for s in statuses), *(F.max(t).alias(f"latest_{t}") for t in times))
    return sources.select(key).join(n, key, "full").fillna(0, [f"{s}_count" for s in statuses])


def top_actions(events: DataFrame, kind: str, actions: list[str], metadata: Column, n: int = 10) -> DataFrame:
    """Admin actions by what their metadata says, or else by kind of event."""
    action = F.coalesce(F.get_json_object(metadata, "$.action"), F.col(kind))
    return events.where(F.col(kind).isin(*actions)).groupBy(action.alias("action")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("action")).limit(n)


def audit(events: DataFrame, action: str | None, words: str | None, fields: list[Column]) -> DataFrame:
    """Audit events of one action whose fields, joined and in any case, hold the words."""
    hay = F.lower(F.concat_ws(" ", *fields))
    out = events if action is None else events.where(F.col("action") == action)
    return out if not words else out.where(hay.contains(words.strip().lower()))


def monthly(events: DataFrame, ts: str, measures: dict[str, Column], n: int = 60) -> DataFrame:
    """Counts by calendar month in Seoul, the latest first."""
    month = F.date_format(F.col(ts) + F.expr("interval 9 hours"), "yyyy-MM")
    return events.groupBy(month.alias("month")).agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in measures.items())).orderBy(F.desc("month")).limit(n)


def unserved(versions: DataFrame, artifacts: DataFrame, same: list[str]) -> DataFrame:
    """Versions without an artifact that is equal in all of some columns, nulls being equal."""
    a, b = versions.alias("a"), artifacts.select(*same).distinct().alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]
    return a.join(b, on, "left_anti")


# Types of tags that count as topics.
TOPIC_TYPES = ("right", "topic", "doctrine", "procedure", "case_type")


def each_once(values: Column) -> Column:
    """Texts that are not blank, each once in any case, the first as it is."""
    keys = F.transform(values, lambda v: F.lower(F.trim(F.regexp_replace(F.regexp_replace(v, "<[^>]*>", " "), "[\\x00-\\x20\\x7F]+", " "))))
    return F.filter(values, lambda v, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))


def meta_item(*, key: Column, korean: Column, original: Column, core: Column, tags: Column, summary_tags: Column, categories: Column, date: Column, prefix: str) -> list[Column]:
    """A search result for other portals: id (under the portal's prefix), title, summary, snippet, keywords and topics of an article.

    core: array of texts; tags: array<struct<name,type>>; date: a date."""
    filled = lambda c: F.when(c != "", c)
    names = lambda rows: F.transform(rows, lambda t: t["name"])
    topics = F.filter(tags, lambda t: t["type"].isin(*TOPIC_TYPES))
    none = F.array().cast("array<string>")
    return [
        F.concat(F.lit(prefix), key.cast("string")).alias("canonical_id"),
        F.coalesce(filled(korean), filled(original), F.lit("제목 미상")).alias("title"),
        filled(snippet(F.array_join(core, " "), 1200)).alias("summary"),
        filled(snippet(F.get(core, 0), 320)).alias("snippet"),
        each_once(F.concat(names(tags), F.coalesce(summary_tags, none))).alias("keywords"),
        each_once(F.concat(names(topics), F.coalesce(categories, none))).alias("topics"),
        F.year(date).alias("decision_year"),
    ]


def article_list(articles: DataFrame, where: Column, limit: int, offset: int = 0, key: str = "id", date: str = "date") -> DataFrame:
    """A page of the public list, the latest first, with the exact total and whether more follow."""
    some = articles.where(where)
    total = some.agg(F.count("*").alias("total"))
    got = latest_first(some, date, key).offset(offset).limit(limit)
    return got.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


def sitemap(articles: DataFrame, slug: str, *times: str) -> DataFrame:
    """slug, last_modified: the latest of some times of each public article."""
    last = F.greatest(*times) if len(times) > 1 else F.col(times[0])
    return articles.groupBy(slug).agg(F.max(last).alias("last_modified"))


def article_detail(articles: DataFrame, slug: str, links: DataFrame, tags: DataFrame, public: Column | None = None, key: str = "article_id") -> DataFrame:
    """The article of a slug with its tags, if it may be shown: one row or none. The predicate goes to the scan,
    so that tags are joined to one article."""
    one = articles.where(F.col("slug") == slug)
    one = one if public is None else one.where(_yes(public))
    one = one.orderBy(key).limit(1)  # read for the tags and for the article: the same one both times
    return with_tags(one, links.join(F.broadcast(one.select(key)), key, "left_semi"), tags, key)


def meta_page(found: DataFrame, sort: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of search results for other portals, by relevance or latest first, with the exact total.

    found: id, score, date of all results."""
    orders = {"relevance": [F.desc("score"), F.desc_nulls_last("date"), F.asc("id")], "latest": [F.desc_nulls_last("date"), F.desc("score"), F.asc("id")]}
    if sort not in orders or not 1 <= limit <= 20 or not 0 <= offset <= 10_000:
        raise ValueError("sort, limit or offset is not allowed")
    total = F.broadcast(found.agg(F.count("*").alias("total")))  # one row
    page = found.orderBy(*orders[sort]).offset(offset).limit(limit)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*orders[sort])) + offset).crossJoin(total)
