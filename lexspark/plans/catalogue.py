"""Every registered query of the archive operators on the driver's tables, with its oracle.

publications and runs, nation for jurisdictions, events for site events, documents for
articles, pages for crawl results, labels for review evidence, part for tags."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import cases, text
from lexspark.operators import analytics, quality, reconcile, search
from lexspark.sources import web
from lexspark.streaming import jobs

NOW = datetime(1998, 8, 1)
TERMS = ["the", "worthless"]
VECTOR = [((i * 37) % 64) / 64.0 - 0.5 for i in range(64)]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(*tables: str, sql: str | None = None):
    """Register a function of tables as a query, with its oracle."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(_t(spark, sf_dir, t) for t in tables))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("events", sql="SELECT user_id, count(*) AS views, arg_min(event_type, (ts, event_type)) AS title FROM events GROUP BY user_id ORDER BY views DESC, user_id LIMIT 12")
def popular_entities(events):
    return analytics.popular(events, "user_id", "ts", "event_type")


@query(
    "events",
    sql="""WITH p AS (SELECT 'event_type' AS dimension, coalesce(nullif(trim(event_type), ''), 'unknown') AS key FROM events
UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR) FROM events UNION ALL SELECT 'k', coalesce(nullif(trim(json_extract_string(props, '$.k')), ''), 'unknown') FROM events),
c AS (SELECT dimension, key, count(*) AS n FROM p GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS INTEGER) AS rank FROM c) WHERE rank <= 10""",
)
def event_dimension_top(events):
    return analytics.dimension_top(events, {"event_type": F.col("event_type"), "hour": F.hour("ts"), "k": F.get_json_object("props", "$.k")})


@query(
    "events",
    sql="""SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS clicks,
count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY 1 ORDER BY day DESC LIMIT 60""",
)
def timeline_daily_kst(events):
    return analytics.timeline(events, "ts", {"clicks": F.col("event_type") == "click", "views": F.col("event_type") == "view", "large": F.col("value") > 50})


@query("events", sql="SELECT count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE value < 1) AS small, count(*) FILTER (WHERE user_id IS NULL) AS anonymous FROM events")
def event_totals(events):
    t = F.col("event_type")
    return analytics.filtered_counts(events, {"clicks": t == "click", "views": t == "view", "small": F.col("value") < 1, "anonymous": F.col("user_id").isNull()})


@query(
    "events",
    sql="""SELECT json_extract_string(props, '$.k') AS query, count(*) AS n, count(*) FILTER (WHERE floor(value) = 0) AS zero, round(avg(floor(value))) AS avg_results,
array_to_string(list_sort(list(DISTINCT event_type)), ',') AS modes FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1 ORDER BY n DESC, query LIMIT 50""",
)
def query_stats(events):
    return analytics.query_stats(events, F.get_json_object("props", "$.k"), F.floor("value"), F.col("event_type"))


@query("orders", sql="SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY ALL")
def status_rollup(orders):
    return analytics.status_rollup(orders, ["o_orderstatus", "o_orderpriority"], "o_orderdate")


@query(
    "nation",
    "customer",
    "orders",
    sql="""WITH o AS (SELECT c_nationkey, o_orderstatus, o_orderdate, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT c_nationkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, max((o_orderdate, o_orderkey)) AS m FROM o GROUP BY 1)
SELECT n_name AS source, coalesce(finished, 0) AS finished, coalesce(open, 0) AS open, m[2] AS latest_run FROM nation LEFT JOIN r ON n_nationkey = c_nationkey
UNION ALL SELECT 'unregistered ' || c_nationkey, finished, open, m[2] FROM r WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""",
)
def source_health(nation, customer, orders):
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    roll = joined.groupBy("c_nationkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_run"))
    known = nation.join(roll, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("source"), F.coalesce("finished", F.lit(0)).alias("finished"), F.coalesce("open", F.lit(0)).alias("open"), "latest_run")
    other = roll.join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left_anti").select(F.concat(F.lit("unregistered "), F.col("c_nationkey")).alias("source"), "finished", "open", "latest_run")
    return known.unionByName(other)


@query(
    "lineitem",
    sql="""SELECT l_returnflag, count(*) AS runs, count(*) FILTER (WHERE l_linestatus = 'F') AS completed, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS found, CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS fetched,
round(100.0 * sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END)::DOUBLE / sum(CAST(l_quantity AS BIGINT))::DOUBLE) AS fetch_rate FROM lineitem GROUP BY 1""",
)
def collection_health(lineitem):
    q, done = F.col("l_quantity").cast("long"), F.col("l_linestatus") == "F"
    return analytics.health(lineitem, "l_returnflag", done, q, F.when(done, q).otherwise(0))


@query("customer", "nation", "orders", sql="SELECT n_name AS jurisdiction, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1997-08-01' GROUP BY 1")
def jurisdiction_counts(customer, nation, orders):
    recent = orders.where(F.col("o_orderdate") >= F.lit(NOW.replace(year=NOW.year - 1)).cast("timestamp_ntz"))
    return recent.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("jurisdiction"), "n")


@query("part", "lineitem", sql="SELECT p_partkey, p_brand, coalesce(n, 0) AS n, latest FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS latest FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def tag_counts(part, lineitem):
    return analytics.tag_counts(part.select("p_partkey", "p_brand"), lineitem.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "l_shipdate")


@query("orders", sql="SELECT o_custkey, m[2] AS o_orderkey, m[3] AS o_totalprice FROM (SELECT o_custkey, max((o_orderdate, o_orderkey, o_totalprice)) AS m FROM orders GROUP BY 1)")
def latest_per_key(orders):
    return analytics.latest_per_key(orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("events", sql="SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def hourly_buckets(events):
    return analytics.hourly(events, "ts", "event_type")


@query(
    "orders",
    sql="""WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority LIKE '2%')
SELECT *, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT FROM a)""",
)
def symmetric_diff(orders):
    side = lambda p: orders.where(F.col("o_orderpriority").startswith(p)).select("o_custkey", "o_orderstatus")
    return reconcile.symmetric_diff(side("1"), side("2"))


@query("customer", "orders", sql="SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def left_anti_missing(customer, orders):
    return customer.join(orders.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("customer", "orders", sql="SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_tag(customer, orders):
    return customer.join(orders.where("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("orders", sql="SELECT o_custkey, count(*) AS n, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def set_digest(orders):
    return reconcile.set_digest(orders, "o_custkey", "o_orderkey")


@query("lineitem", sql="SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.95) AS nearest, round(quantile_cont(l_extendedprice, 0.95), 6) AS linear FROM lineitem GROUP BY 1, 2")
def percentiles(lineitem):
    return analytics.percentiles(lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus"], 0.95)


@query("documents", sql="SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS copies FROM documents GROUP BY sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))")
def dedup_first_wins(documents):
    return reconcile.first_wins(documents.select("doc_id", "lang", text.content_hash(F.col("text"), 64).alias("h")), F.col("h"), "doc_id").select("doc_id", "lang", "copies")


@query("documents", sql="SELECT source, string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) AS histogram FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def lang_histogram(documents):
    n = documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "lang"))), lambda x: F.concat(x["lang"], F.lit(":"), -x["m"])), ",").alias("histogram"))


_BM25 = """toks AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
base AS (SELECT doc_id, lang, len(t) AS dl, len(list_filter(t, lambda x: x = 'the')) AS tf0, len(list_filter(t, lambda x: x = 'worthless')) AS tf1 FROM toks),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE tf0 > 0)::DOUBLE AS df0, count(*) FILTER (WHERE tf1 > 0)::DOUBLE AS df1 FROM base),
bm AS (SELECT doc_id, lang, round(ln(1 + (n - df0 + 0.5::DOUBLE) / (df0 + 0.5::DOUBLE)) * tf0::DOUBLE * 2.2::DOUBLE / (tf0::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))
 + ln(1 + (n - df1 + 0.5::DOUBLE) / (df1 + 0.5::DOUBLE)) * tf1::DOUBLE * 2.2::DOUBLE / (tf1::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)), 6) AS score FROM base, st WHERE tf0 > 0 OR tf1 > 0)"""
_VEC = f"cos AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], [{', '.join(map(str, VECTOR))}]::DOUBLE[]), 6) AS score FROM embeddings)"


@query("embeddings", sql=f"WITH {_VEC} SELECT doc_id AS vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM cos ORDER BY score DESC, doc_id LIMIT 50")
def semantic_topk(embeddings):
    return search.ranked(search.semantic(embeddings, "vec_id", "embedding", VECTOR), "vec_id", 50)


_RRF = f"""{_BM25}, {_VEC},
lx AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS lexical_rank FROM bm QUALIFY lexical_rank <= 100),
sx AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS semantic_rank FROM (SELECT * FROM cos SEMI JOIN documents USING (doc_id)) QUALIFY semantic_rank <= 100),
fused AS (SELECT doc_id, lexical_rank, semantic_rank, round(coalesce(1::DOUBLE / (60 + lexical_rank), 0) + coalesce(1::DOUBLE / (60 + semantic_rank), 0), 9) AS score FROM lx FULL JOIN sx USING (doc_id))"""


@query("documents", sql="SELECT doc_id, n_chars FROM documents WHERE n_chars < 3000 OR (n_chars = 3000 AND doc_id > 10) ORDER BY n_chars DESC, doc_id LIMIT 25")
def keyset_page(documents):
    return search.keyset(documents.select("doc_id", "n_chars"), (3000, 10), 25, "n_chars")


@query("documents", sql="SELECT doc_id, source, turn FROM (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS turn FROM documents) ORDER BY turn, source LIMIT 100")
def round_robin(documents):
    return analytics.round_robin(documents.select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 100).select("doc_id", "source", "turn")


@query(
    "pages",
    sql="""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"#]*">[^<]*</a>')) AS a, unnest(range(1, len(regexp_extract_all(html, '<a href="[^"#]*">[^<]*</a>')) + 1)) AS i FROM pages),
h AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*') || regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(a, '>([^<]*)<', 1)) AS anchor, i FROM l)
SELECT page_id, href, arg_min(anchor, i) AS anchor FROM h GROUP BY 1, 2""",
)
def html_links(pages):
    return web.links(pages).select("page_id", "href", "anchor")


@query("pages")
def readable_text(pages):
    return web.readable(pages)


def _marked(expr: str, marks) -> str:
    for pattern, mark in marks:
        expr = f"regexp_replace({expr}, '{pattern}', '{mark.replace('$1', chr(92) + '1')}', 'g')"
    return expr


@query(
    "documents",
    sql=f"SELECT doc_id, sha256(coalesce(nullif(trim({_marked("lower(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))", text.QUERY_MARKS)}), ''), '')) AS query, sha256({_marked("text || ' api_key: abc, ?token=x Bearer abcdefghijklmnop0'", text.SECRET_MARKS)}) AS log FROM documents",
)
def pii_redact(documents):
    """Whole texts as if they were queries and log messages."""
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    log = F.concat("text", F.lit(" api_key: abc, ?token=x Bearer abcdefghijklmnop0"))
    return documents.select("doc_id", digest(text.redact_query(F.col("text"), None)).alias("query"), digest(text.redact_secrets(log)).alias("log"))


@query("conversations", sql="SELECT conv_id, turn, contains(lower(text), 'the') AS hit FROM conversations WHERE role = 'user'")
def haystack_filter(conversations):
    return conversations.where("role = 'user'").select("conv_id", "turn", F.lower("text").contains("the").alias("hit"))


@query("documents", sql="SELECT doc_id, CASE WHEN lang = 'de' THEN 'removed' WHEN n_chars < 200 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE (lang = 'de') <> (n_chars < 200) OR (lang <> 'de' AND n_chars >= 200 AND lang = 'fr')")
def projection_diff(documents):
    base = documents.select("doc_id", "lang", "n_chars")
    old = base.where("n_chars >= 200").select("doc_id", "lang")
    new = base.where("lang <> 'de'").select("doc_id", F.when(F.col("lang") == "fr", "FR").otherwise(F.col("lang")).alias("lang"))
    return reconcile.diff(old, new, "doc_id", ["lang"])


@query(
    "orders",
    sql="""SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS large,
CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*), 6) END AS completion,
CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN round(count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000)::DOUBLE / count(*) FILTER (WHERE o_orderstatus = 'F'), 6) END AS coverage FROM orders GROUP BY 1""",
)
def snapshot_ratios(orders):
    done = F.col("o_orderstatus") == "F"
    return quality.snapshot_ratios(orders, ["o_custkey"], {"done": done, "pending": F.col("o_orderstatus") == "P", "large": done & (F.col("o_totalprice") > 100000)}, {"completion": ("done", "total"), "coverage": ("large", "done")})


@query("events", sql="SELECT user_id, count(*) AS entries, count(*) FILTER (WHERE event_id % 97 = 0) AS broken FROM events GROUP BY 1")
def hash_chain_verify(events):
    """A ledger in which some entries were forged after it was chained: those, and no others, are found."""
    payload = F.concat_ws("|", F.col("event_id").cast("string"), F.col("event_type"), F.col("props"))
    ledger = reconcile.chain(events, "user_id", "event_id", payload)
    forged = ledger.withColumn("payload", F.when(F.col("event_id") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return reconcile.verify_chain(forged, "user_id", "event_id")


@query(
    "events",
    sql="""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT *, ts AS s, 1 AS n FROM e WHERE i = 1 UNION ALL SELECT e.*, CASE WHEN e.ts >= r.s + INTERVAL 1 HOUR THEN e.ts ELSE r.s END, CASE WHEN e.ts >= r.s + INTERVAL 1 HOUR THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, s AS window_start, CAST(n AS BIGINT) AS n, n <= 3 AS allowed FROM r""",
)
def rate_limit_fixed_window(events):
    return jobs.rate_limit(events, "user_id", "ts", "event_id", 3600, 3)


@query("events", sql="SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stage_idempotent(events):
    return jobs.register(events.select("event_id", "user_id", "event_type"), None, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")
