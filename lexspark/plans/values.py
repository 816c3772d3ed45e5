"""Queries of scalar functions, backfill work, upserts and small reads, with their oracles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lexspark.functions import rules, text
from lexspark.operators import maintenance, quality, reading, reconcile, search
from lexspark.plans.catalogue import query
from lexspark.plans.rules import _as, _given, _pick, _summaries_of
from lexspark.streaming import jobs

NOW = datetime(1998, 8, 1)

_GERMAN = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
_FRENCH = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
_SPANISH = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


@query(
    "orders",
    sql="""WITH d AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 YEAR AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 6 THEN 'none' ELSE strftime(d, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 2 = 0 THEN strftime(d, '%Y-%m-%d') WHEN month(d) = 2 AND day(d) = 29 THEN 'none' ELSE strftime(d, '2005-%m-%d') END AS spanish FROM d""",
)
def date_formats(orders):
    """Dates as pages of several countries write them, read back."""
    k, d = F.col("o_orderkey"), (F.col("o_orderdate").cast("date") + F.expr("interval 10 years")).cast("date")
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), F.month(d))
    cat = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    day, year = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    forms = [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "d.M.yyyy"), cat(" ", day, ".  ", name(_GERMAN), " ", year), cat(F.when(day == "1", "1er").otherwise(day), " ", name(_FRENCH), " ", year), F.date_format(d, "M/d/yy"), F.date_format(d, "MMMM d, yyyy"), cat("le ", day, " ", name(_FRENCH)), F.date_format(d, "yyyy-MM-dd'T'10:00:00")]
    said = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    spanish = F.when(k % 2 == 0, cat("Sentencia de ", day, " de ", F.initcap(name(_SPANISH)), " de ", year)).otherwise(cat("Auto 7/2020, de ", day, "  de ", name(_SPANISH)))
    n = orders.select("o_orderkey", F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("d"), spanish.alias("s"))
    return n.select("o_orderkey", said(text.parse_date(F.col("d"))).alias("day"), said(text.parse_spanish_date(F.col("s"), F.lit(2005))).alias("spanish"))


_AGENT = """SELECT event_id, CASE WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 <> 0 THEN concat('Mozilla/', event_id % 6, CASE WHEN event_id % 2 = 0 THEN ' Safari/1' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN ' CHROME/2' ELSE '' END, CASE WHEN event_id % 5 = 0 THEN ' Edg/3' ELSE '' END,
CASE event_id % 7 WHEN 0 THEN ' iPhone Mobile' WHEN 1 THEN ' Android' WHEN 2 THEN ' iPad' WHEN 3 THEN ' undici' ELSE '' END, CASE event_id % 11 WHEN 0 THEN ' FxiOS/9' WHEN 1 THEN ' CriOS' ELSE '' END, CASE event_id % 13 WHEN 0 THEN ' GoogleBot' WHEN 1 THEN ' LinkPreview' ELSE '' END) END AS a FROM {events}"""


@query(
    "events",
    sql=f"""WITH {_as("g", _AGENT)}, l AS (SELECT event_id, lower(a) AS a FROM g)
SELECT event_id, coalesce(CASE WHEN contains(a, 'edg/') THEN 'Edge' WHEN contains(a, 'chrome') OR contains(a, 'crios') THEN 'Chrome' WHEN contains(a, 'firefox') OR contains(a, 'fxios') THEN 'Firefox' WHEN contains(a, 'safari') AND NOT contains(a, 'android') THEN 'Safari' WHEN contains(a, 'node') OR contains(a, 'undici') THEN 'Server' WHEN a <> '' THEN 'Other' END, 'none') AS family,
coalesce(CASE WHEN contains(a, 'ipad') OR contains(a, 'tablet') THEN 'tablet' WHEN contains(a, 'mobile') OR contains(a, 'iphone') OR contains(a, 'ipod') OR contains(a, 'android') THEN 'mobile' WHEN a <> '' THEN 'desktop' END, 'none') AS device, coalesce(contains(a, 'bot') OR contains(a, 'preview'), false) AS bot FROM l""",
)
def agents(events):
    """Browser, device and whether a machine reads, by the agent of each event."""
    n = _given(_AGENT, events=events)
    return n.select("event_id", F.coalesce(text.agent_family(F.col("a")), F.lit("none")).alias("family"), F.coalesce(text.device(F.col("a")), F.lit("none")).alias("device"), text.is_bot(F.col("a")).alias("bot"))


_WS = "[ \\t\\n\\r\\f\\v]+"


@query(
    "documents",
    sql=f"""SELECT doc_id, sha256(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS collapsed, sha256(trim(regexp_replace(regexp_replace(text || chr(10) || chr(10) || chr(10) || 'x', '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))) AS cleaned,
substr(sha256(concat_ws('|', source, lang)), 1, 16) AS title_key, substr(sha256(substr(text, 1, 1500)), 1, 16) AS text_key, translate(regexp_replace(lower(trim(source || ' (A-' || lang || ')')), '{_WS}', '', 'g'), '._-/#,;:()[]{{}}''"', '') AS alias,
'germany-' || source || '-2021-03-04-' || 'uber-' || lang || '-' || substr(sha256('u' || doc_id), 1, 6) AS slug FROM documents""",
)
def text_keys(documents):
    """White space, cleaning, keys of duplicates, alias keys and slugs."""
    title_key, text_key = text.dedup_keys(F.col("source"), F.col("lang"), F.col("text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    slug = text.article_slug(F.lit("Germany!"), F.col("source"), F.lit("2021-03-04").cast("date"), F.concat(F.lit(" uber: "), F.col("lang")), F.concat(F.lit("u"), F.col("doc_id")))
    return documents.select(
        "doc_id",
        digest(text.collapse(F.col("text"))).alias("collapsed"),
        digest(text.clean(F.concat("text", F.lit("\n\n\nx")))).alias("cleaned"),
        title_key.alias("title_key"),
        text_key.alias("text_key"),
        text.alias_key(F.concat("source", F.lit(" (A-"), "lang", F.lit(")"))).alias("alias"),
        slug.alias("slug"),
    )


@query("embeddings", sql="WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT vec_id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last, 2 AS parsed FROM e")
def unit_vectors(embeddings):
    v = text.l2_normalize(F.col("embedding"), 64)
    return embeddings.select("vec_id", F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"), F.size(text.parse_vector(F.lit("[1.5, NaN, 2]"))).alias("parsed"))


@query("documents", sql="SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat_ws(chr(10), source, lang, 'core ' || doc_id, 'b' || doc_id, '', lang, source, lang, 'law: ' || lang) ELSE concat_ws(chr(10), source, '', '') END AS text FROM documents WHERE doc_id % 8 < 2")
def embedding_texts(documents):
    """What is embedded of each valid summary."""
    n = _summaries_of(documents).select("doc_id", rules.valid_summary(F.col("s")).alias("s")).where("s is not null")
    return n.select("doc_id", text.embedding_text(F.col("s")).alias("text"))


_WORK = f"""SELECT o_orderkey, o_custkey, {_pick('o_orderkey', ['published', 'retry_wait', 'excluded', 'terminal_failure', 'waived_failure', 'fetched', 'published'])} AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 4 END AS fetched, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 END AS normalized,
o_orderkey % 4 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS normalized_from, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 3 END AS verified, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 3 END AS published, CASE WHEN o_orderkey % 19 = 0 THEN 1 END AS attempt, o_orderdate AS lease,
CASE WHEN o_orderkey % 23 = 0 THEN 'fetch' END AS retry_phase, CASE WHEN o_orderkey % 46 = 0 THEN 1 END AS next_attempt, o_orderkey % 29 <> 0 AS current FROM {{orders}}"""
_STATE = f"""{_as("w", _WORK)}, n AS (SELECT *, fetched IS NOT NULL AND (normalized IS NULL OR normalized_from IS DISTINCT FROM fetched) AS a, normalized IS NOT NULL AND normalized IS DISTINCT FROM verified AS b, status = 'published' AND verified IS NOT NULL AND verified IS DISTINCT FROM published AS c FROM w),
s AS (SELECT *, CASE WHEN attempt IS NOT NULL AND lease > TIMESTAMP '1995-01-01' THEN 'claimed' WHEN status = 'retry_wait' OR (retry_phase IS NOT NULL AND next_attempt IS NOT NULL) THEN 'retry_wait' WHEN a THEN 'needs_normalize' WHEN b THEN 'needs_reverify' WHEN c THEN 'needs_republish' WHEN status IN ('terminal_failure', 'waived_failure') THEN 'failed' ELSE 'idle' END AS work,
status IN ('published', 'excluded', 'duplicate', 'withdrawn', 'waived_failure') AS done FROM n)"""


def _work(orders):
    w, c = _given(_WORK, orders=orders), F.col
    needs = quality.work_needs(fetched=c("fetched"), normalized=c("normalized"), normalized_from=c("normalized_from"), verified=c("verified"), published=c("published"), status=c("status"))
    now = F.lit(datetime(1995, 1, 1)).cast("timestamp_ntz")
    state = quality.work_state(needs, attempt=c("attempt"), lease=c("lease"), now=now, status=c("status"), retry_phase=c("retry_phase"), next_attempt=c("next_attempt"))
    return w.withColumns({"work": state, "behind": needs["normalize"] | needs["reverify"] | needs["republish"]})


@query("orders", sql=f"WITH {_STATE} SELECT o_orderkey, work FROM s")
def work_states(orders):
    return _work(orders).select("o_orderkey", "work")


@query(
    "orders",
    "customer",
    sql=f"""WITH {_STATE}, g AS (SELECT *, done AND NOT a AND NOT b AND NOT c AND (status <> 'published' OR current) AS good FROM s),
t AS (SELECT o_custkey AS k, count(*) AS discovered, count(*) FILTER (WHERE done) AS terminal, count(*) FILTER (WHERE work = 'claimed') AS claimed, count(*) FILTER (WHERE work = 'retry_wait') AS retry_wait, count(*) FILTER (WHERE work = 'needs_normalize') AS needs_normalize, count(*) FILTER (WHERE work = 'needs_reverify') AS needs_reverify,
count(*) FILTER (WHERE work = 'needs_republish') AS needs_republish, count(*) FILTER (WHERE work = 'failed') AS failed, count(*) FILTER (WHERE good) AS conformant FROM g GROUP BY 1)
SELECT c_custkey AS k, c_nationkey AS expected, coalesce(discovered, 0) AS discovered, coalesce(terminal, 0) AS terminal, coalesce(claimed, 0) AS claimed, coalesce(retry_wait, 0) AS retry_wait, coalesce(needs_normalize, 0) AS needs_normalize, coalesce(needs_reverify, 0) AS needs_reverify, coalesce(needs_republish, 0) AS needs_republish, coalesce(failed, 0) AS failed, coalesce(conformant, 0) AS conformant,
CASE WHEN coalesce(discovered, 0) = 0 THEN 0 ELSE round(terminal / discovered::DOUBLE, 6) END AS completion, CASE WHEN c_nationkey > 0 THEN round(coalesce(discovered, 0) / c_nationkey::DOUBLE, 6) ELSE -1 END AS coverage, CASE WHEN coalesce(terminal, 0) = 0 THEN 0 ELSE round(conformant / terminal::DOUBLE, 6) END AS conformance FROM customer LEFT JOIN t ON k = c_custkey""",
)
def snapshot_statuses(orders, customer):
    items = _work(orders).withColumnRenamed("o_custkey", "k")
    snapshots = customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("expected"))
    return quality.snapshot_status(items, snapshots, "k").withColumn("coverage", F.coalesce("coverage", F.lit(-1.0)))


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS attempts, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def candidate_upsert(orders):
    old = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(1).alias("attempts"), F.lit("old").alias("state"))
    new = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(0).alias("attempts"), F.lit("new").alias("state"))
    return reconcile.upsert(old, new, ["o_orderkey"], "attempts")


@query("documents", sql="SELECT doc_id, sha256(coalesce(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 2000) END, '')) AS shown, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS kept FROM documents")
def text_access(documents):
    """Texts by policy (whole, an excerpt, none), and old texts that a much shorter one doesn't replace."""
    k = F.col("doc_id")
    policy = F.when(k % 3 == 0, "full").when(k % 3 == 1, "excerpt").otherwise("none")
    old = F.lit("o" * 100)
    new = F.when(k % 2 == 0, F.lit("n" * 59)).otherwise("n" * 60)
    kept = F.when(quality.regression_guard(old, new).startswith("o"), "old").otherwise("new")
    return documents.select("doc_id", F.sha2(F.coalesce(maintenance.access(F.col("text"), policy), F.lit("")).cast("binary"), 256).alias("shown"), kept.alias("kept"))


@query("orders", sql="SELECT o_orderkey, rank, o_orderstatus FROM (SELECT *, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 30")
def hydrated_ranks(orders):
    """Rows of a ranked list of ids, in its order."""
    top = search.ranked(orders.select("o_orderkey", F.col("o_totalprice").alias("score")), "o_orderkey", 30)
    return maintenance.in_order(orders.select("o_orderkey", "o_orderstatus"), top, "o_orderkey", "rank").select("o_orderkey", "rank", "o_orderstatus")


@query("events", "customer", sql="WITH v AS (SELECT user_id, count(*) AS views FROM events GROUP BY 1) SELECT user_id, views, CASE WHEN views >= 90 THEN 'critical' WHEN views >= 70 THEN 'warning' ELSE 'ok' END AS level FROM v SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') ON user_id = c_custkey ORDER BY views DESC, user_id LIMIT 20")
def top_viewed(events, customer):
    """View counts of what may be shown, the most viewed first, with a service level."""
    shown = customer.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    seen = jobs.running_counts(events, "user_id").join(shown, "user_id", "left_semi").orderBy(F.desc("views"), "user_id").limit(20)
    return seen.withColumn("level", quality.service_level(F.col("views"), 70, 90))


@query("events", sql="SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(events):
    return jobs.windowed_counts(events, "ts", "event_type")


@query("customer", sql="SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def filter_pack(customer):
    """Filters of a request; those that are not given filter nothing."""
    return customer.where(search.filter_pack(c_mktsegment="BUILDING", c_nationkey=3, c_name=None)).select("c_custkey")


_LAST_RUNS = f"SELECT o_custkey % 60 AS source, {_pick('o_orderkey', ['completed', 'failed', 'completed', 'running', 'completed'])} AS status, {_pick('floor(o_orderkey / 5)', ['success', 'degraded', 'failed', None])} AS outcome, o_orderdate AS started FROM {{orders}}"


@query(
    "orders",
    "nation",
    sql=f"""WITH {_as("r", _LAST_RUNS)}, s AS (SELECT n_nationkey + 40 AS source FROM nation), l AS (SELECT source, arg_max(status, (started, status)) AS st, arg_max(coalesce(outcome, ''), (started, status)) AS oc, max(started) FILTER (WHERE status = 'completed') AS ok FROM r GROUP BY 1),
j AS (SELECT s.source, st, oc, epoch(TIMESTAMP '1998-08-01' - ok) AS age FROM s LEFT JOIN l USING (source))
SELECT 'source-outcome:' || source AS key, CASE WHEN st = 'failed' OR (st = 'completed' AND oc = 'failed') THEN 'critical' ELSE 'warning' END AS severity FROM j WHERE st = 'failed' OR (st = 'completed' AND oc = 'failed') OR oc = 'degraded'
UNION ALL SELECT 'source-silent:' || source, 'critical' FROM j WHERE st IS NULL UNION ALL SELECT 'source-freshness:' || source, CASE WHEN age > 864000 THEN 'critical' ELSE 'warning' END FROM j WHERE st <> 'running' AND age > 86400
UNION ALL SELECT 'missed-window', 'critical' FROM r HAVING coalesce(max(started) FILTER (WHERE status = 'completed') < TIMESTAMP '2000-01-01', true)
UNION ALL SELECT 'workflow-heartbeat:' || source, CASE WHEN st IS NULL OR st = 'failed' THEN 'critical' ELSE 'warning' END FROM (SELECT s.source, st, last FROM s LEFT JOIN (SELECT source, arg_max(status, (started, status)) AS st, max(started) AS last FROM r GROUP BY 1) USING (source)) WHERE st IS NULL OR st = 'failed' OR epoch(TIMESTAMP '1998-08-01' - last) > 43200""",
)
def watchdog_violations(orders, nation):
    """Sources whose last run failed, is silent or stale; a missed window; workflows without a heartbeat."""
    runs = _given(_LAST_RUNS.replace("SELECT", "SELECT o_orderkey AS id,", 1), orders=orders)
    sources = nation.select((F.col("n_nationkey") + 40).alias("source"))
    beats = runs.groupBy(F.col("source").alias("workflow")).agg(F.max(F.struct("started", "status")).alias("m")).select("workflow", F.col("m.status").alias("status"), F.col("m.started").alias("seen"))
    found = [maintenance.source_violations(sources, runs, NOW, 86_400, 864_000, tie="id"), maintenance.missed_window(runs, datetime(2000, 1, 2), 24), maintenance.heartbeat_violations(sources.withColumnRenamed("source", "workflow"), beats, NOW, 43_200)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "documents",
    sql="""WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS k, trim(regexp_replace(text, '[\x00-\x20\x7F]+', ' ', 'g'), ' ') AS p FROM documents WHERE NOT contains(text, '<')),
e AS (SELECT *, trim(p || ' ' || source, ' ') AS q FROM d) SELECT 'archive:' || doc_id AS canonical_id, CASE WHEN k <> '' THEN k WHEN doc_id % 2 = 0 THEN 'original' ELSE '제목 미상' END AS title, sha256(CASE WHEN length(q) <= 1200 THEN q ELSE rtrim(substr(q, 1, 1199), ' ') || '…' END) AS summary,
sha256(CASE WHEN length(p) <= 320 THEN p ELSE rtrim(substr(p, 1, 319), ' ') || '…' END) AS snippet, source || ',Privacy' || CASE WHEN lang <> 'en' THEN ',' || lang ELSE '' END AS keywords, 'Privacy' || CASE WHEN lang <> 'en' THEN ',' || lang ELSE '' END AS topics, 2021 AS decision_year FROM e""",
)
def meta_search(documents):
    """Results for other portals; keywords and topics once each, in any case."""
    k = F.col("doc_id")
    tag = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("type"))
    lang = F.when(F.col("lang") != "en", F.col("lang")).otherwise(" ")
    item = reading.meta_item(key=k, korean=F.when(k % 3 != 0, F.col("lang")).otherwise(""), original=F.when(k % 2 == 0, "original"), core=F.array("text", "source"), tags=F.array(tag(F.col("source"), "court"), tag(F.lit("Privacy"), "right")), summary_tags=F.array(F.lit("PRIVACY"), lang), categories=F.array(F.lit("privacy "), lang), date=F.lit("2021-05-06").cast("date"), prefix="archive:")
    got = documents.where(~F.col("text").contains("<")).select(*item)
    digest = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")).cast("binary"), 256).alias(c)
    return got.select("canonical_id", "title", digest("summary"), digest("snippet"), F.array_join("keywords", ",").alias("keywords"), F.array_join("topics", ",").alias("topics"), "decision_year")


@query("orders", sql="WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') SELECT id, (SELECT count(*) FROM o) AS total, (SELECT count(*) FROM o) > 30 AS has_more FROM o ORDER BY date DESC NULLS LAST, id LIMIT 20 OFFSET 10")
def article_list(orders):
    articles = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date")).alias("date"), "o_orderpriority", "o_orderstatus")
    return reading.article_list(articles, search.filter_pack(o_orderpriority="1-URGENT", o_orderstatus="F", id=None), 20, 10).select("id", "total", "has_more")


@query("lineitem", sql="SELECT l_orderkey AS slug, max(greatest(l_shipdate, l_shipdate + INTERVAL (l_linenumber) DAY)) AS last_modified FROM lineitem GROUP BY 1")
def sitemap(lineitem):
    later = lineitem.select(F.col("l_orderkey").alias("slug"), "l_shipdate", (F.col("l_shipdate") + F.make_dt_interval("l_linenumber")).alias("updated"))
    return reading.sitemap(later, "slug", "l_shipdate", "updated")
