"""Queries of the scans, watch rules and upkeep jobs on the driver's tables, with their oracles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import analytics, maintenance
from lexspark.plans.catalogue import query

NOW = datetime(1998, 8, 1)


@query("orders", sql="SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def guarded_scan(orders):
    got = maintenance.guarded_scan(orders, ["o_orderkey", "o_orderstatus", "o_totalprice"], set(orders.columns), {"o_orderstatus": "F"}, {"o_totalprice": 100000}, {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 10)
    return got


@query(
    "orders",
    sql="""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus <> 'P') AS succeeded, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed,
CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'P') / count(*) + 0.5::DOUBLE) AS BIGINT) AS failure_rate FROM orders GROUP BY 1""",
)
def model_health(orders):
    return maintenance.failure_health(orders.where("o_orderstatus <> 'P'"), orders.where("o_orderstatus = 'P'"), "o_orderpriority")


@query("events", sql="SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS total FROM events GROUP BY 1 ORDER BY total DESC, user_id LIMIT 15")
def tag_interactions(events):
    return maintenance.interactions(events, "user_id", F.col("event_type") == "click", F.col("event_type") == "view")


@query("orders", sql="SELECT o_orderpriority, count(*) AS waiting, min(o_orderdate) AS oldest, CASE WHEN count(*) >= 1000 THEN 'critical' WHEN count(*) >= 150 THEN 'warning' ELSE 'ok' END AS level FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def backlog_levels(orders):
    return maintenance.backlog(orders, "o_orderpriority", F.col("o_orderstatus") == "O", "o_orderdate", 150, 1000)


@query("orders", sql="SELECT o_custkey, '{' || string_agg('\"' || o_orderstatus || '\":' || n, ',' ORDER BY o_orderstatus) || '}' AS counts FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def status_object(orders):
    return maintenance.status_object(orders, "o_custkey", "o_orderstatus")


@query(
    "lineitem",
    sql="""WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT l_orderkey, count(*) AS shared FROM l WHERE l_orderkey <> 1 AND l_suppkey IN (SELECT l_suppkey FROM l WHERE l_orderkey = 1)
GROUP BY 1 ORDER BY shared DESC, l_orderkey LIMIT 6""",
)
def related_items(lineitem):
    return maintenance.related(lineitem, "l_orderkey", "l_suppkey", 1)


@query(
    "orders",
    sql="""WITH a AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_custkey = b.o_custkey)""",
)
def union_with_precedence(orders):
    top = lambda df: df.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return maintenance.prefer(top(orders.where("o_orderstatus = 'F'")), top(orders), ["o_custkey"])


@query(
    "documents",
    sql="""SELECT doc_id, CASE WHEN n_chars < 300 THEN 'insert' WHEN lang = 'de' THEN 'refuse' WHEN lang = 'fr' THEN 'update' ELSE 'unchanged' END AS action FROM documents WHERE NOT (n_chars < 300 AND lang = 'de')""",
)
def append_only_reconcile(documents):
    base = documents.select("doc_id", "lang", "n_chars")
    stored = base.where("n_chars >= 300").select("doc_id", F.col("lang").alias("checksum"))
    wanted = base.where("lang <> 'de'").select("doc_id", F.when(F.col("lang") == "fr", "FR").otherwise(F.col("lang")).alias("checksum"))
    return maintenance.reconcile_append_only(stored, wanted, "doc_id", "checksum")


@query(
    "orders",
    sql="""SELECT *, CASE WHEN last_run < TIMESTAMP '1998-08-01' - INTERVAL 90 DAY THEN 'silent' WHEN last_ok IS NULL THEN 'failing' WHEN last_ok < TIMESTAMP '1998-08-01' - INTERVAL 365 DAY THEN 'stale' ELSE 'ok' END AS state
FROM (SELECT o_custkey, max(o_orderdate) AS last_run, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_ok FROM orders GROUP BY 1)""",
)
def source_watchdog(orders):
    return maintenance.watchdog(orders, "o_custkey", "o_orderdate", F.col("o_orderstatus") == "F", NOW, 90, 365)


@query("orders", sql="SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-01' - INTERVAL 180 DAY")
def retention_keep(orders):
    return maintenance.retained(orders, "o_orderdate", NOW, 180).select("o_orderkey", "o_orderdate")


@query("documents", "embeddings", sql="SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL) AS versions, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND fits) AS ready, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND fits IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND NOT fits) AS wrong_width, count(*) FILTER (WHERE d.doc_id IS NULL) AS orphans FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT vec_id, bool_or(len(embedding) = 64) AS fits FROM embeddings GROUP BY 1) e ON doc_id = vec_id")
def embedding_readiness(documents, embeddings):
    return maintenance.embedding_readiness(documents, embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", 64, "embedding")


@query("documents", sql="SELECT doc_id, sha256(substr(text, 101, 500)) AS piece, length(text) > 600 AS has_more, CASE WHEN length(text) > 600 THEN 600 ELSE -1 END AS next_offset FROM documents")
def source_text_page(documents):
    piece, more, after = maintenance.text_page(F.col("text"), 100, 500)
    return documents.select("doc_id", piece, more, after).withColumns({"piece": F.sha2(F.col("piece").cast("binary"), 256), "next_offset": F.coalesce("next_offset", F.lit(-1))})


@query(
    "orders",
    sql="SELECT o_orderkey, CASE WHEN s = 'running' AND o_orderdate < TIMESTAMP '1998-08-01' - INTERVAL 30 MINUTE THEN 'failed' ELSE s END AS state FROM (SELECT o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'pending' END AS s FROM orders)",
)
def stale_recovery(orders):
    state = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("pending")
    return maintenance.recover_stale(orders.withColumn("state", state), "state", "o_orderdate", NOW).select("o_orderkey", "state")


@query("orders", sql="SELECT o_orderpriority, o_orderstatus, count(*) AS jobs, min(o_orderdate) AS oldest FROM orders GROUP BY 1, 2")
def stage_job_diagnosis(orders):
    return maintenance.jobs_by_state(orders, "o_orderpriority", "o_orderstatus", "o_orderdate")


@query("part", sql="SELECT p_brand, p_partkey, p_size, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS alias_rank FROM part QUALIFY alias_rank <= 8")
def top_per_concept(part):
    return maintenance.aliases_per_concept(part.select("p_brand", "p_partkey", "p_size"), "p_brand", [F.desc("p_size"), F.asc("p_partkey")])


@query(
    "customer",
    "supplier",
    sql="""SELECT n, arg_min(label, (part, label)) AS label FROM (SELECT c_nationkey AS n, c_name AS label, 0 AS part FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, s_name, 1 FROM supplier) GROUP BY 1""",
)
def first_group_wins(customer, supplier):
    a = customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n"), F.col("c_name").alias("label"))
    return maintenance.first_group_wins([a, supplier.select(F.col("s_nationkey").alias("n"), F.col("s_name").alias("label"))], "n")


@query(
    "events",
    sql="""SELECT user_id, bool_or(value > 95) AS any_large, array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE value > 50)), ',') AS kinds, count(DISTINCT event_type) AS n_kinds, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1""",
)
def compatibility_rollup(events):
    kinds = F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") > 50, F.col("event_type")))), ",")
    got = events.groupBy("user_id").agg(F.bool_or(F.col("value") > 95).alias("any_large"), kinds.alias("kinds"), F.count_distinct("event_type").alias("n_kinds"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return got.withColumn("kinds", F.nullif("kinds", F.lit("")))


@query("part", "lineitem", sql="SELECT p_partkey, p_brand, coalesce(n, 0) AS n, latest FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS latest FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE coalesce(n, 0) IS DISTINCT FROM 30 OR latest IS DISTINCT FROM TIMESTAMP '1998-01-01'")
def tag_refresh_changed(part, lineitem):
    stored = part.select("p_partkey", "p_brand", F.lit(30).alias("stored_n"), F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz").alias("stored_latest"))
    got = analytics.tag_counts(stored, lineitem.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "l_shipdate", changed_only=True)
    return got.select("p_partkey", "p_brand", "n", "latest")


_ALIAS = """translate(regexp_replace(lower(trim(p_brand)), '\\s+', '', 'g'), '._-/#,;:()[]{}''"', '')"""


@query(
    "part",
    sql=f"""WITH b AS (SELECT p_brand, {_ALIAS} AS alias, count(*) AS n, count(*) FILTER (WHERE p_size = 1) > count(*) FILTER (WHERE p_size = 2) AS known FROM part GROUP BY 1)
    SELECT p_brand, n, alias FROM b WHERE NOT EXISTS (SELECT 1 FROM b AS k WHERE k.known AND k.alias = b.alias)""",
)
def glossary_candidates(part):
    counted = part.groupBy("p_brand").agg(F.count("*").alias("n"), (F.count_if(F.col("p_size") == 1) > F.count_if(F.col("p_size") == 2)).alias("known"))
    known = counted.where("known").select(text.alias_key(F.col("p_brand")).alias("alias"))
    return maintenance.glossary_candidates(counted.drop("known"), known, "p_brand", "n", text.alias_key(F.col("p_brand")), 1, 40)
