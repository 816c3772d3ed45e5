"""Queries of the publication rules, claim findings, catalogue scores and rank reports, with their oracles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lexspark.operators import publication
from lexspark.plans.catalogue import query

NOW = datetime(1998, 1, 1)

_STATES = """d AS (SELECT doc_id, text, lang, source, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN n_chars > 0 THEN 'source_text_ready' ELSE 'pending' END AS c, CASE WHEN doc_id % 5 = 0 THEN 'running' ELSE 'complete' END AS p,
CASE WHEN doc_id % 7 = 0 THEN 'rejected' ELSE 'approved' END AS r, CASE WHEN doc_id % 13 = 0 THEN 'open' ELSE 'clear' END AS a, CASE WHEN doc_id % 3 <> 0 THEN 'x' END AS summary,
lang <> 'fr' AND doc_id % 17 <> 0 AS valid, doc_id % 2 = 0 AS public, length(trim(coalesce(text, ''), ' ')) AS n FROM documents)"""


def _states(documents):
    i = F.col("doc_id")
    return documents.select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.when(i % 11 == 0, None).when(F.col("n_chars") > 0, "source_text_ready").otherwise("pending").alias("c"),
        F.when(i % 5 == 0, "running").otherwise("complete").alias("p"),
        F.when(i % 7 == 0, "rejected").otherwise("approved").alias("r"),
        F.when(i % 13 == 0, "open").otherwise("clear").alias("a"),
        F.when(i % 3 != 0, "x").alias("summary"),
        publication.policy_valid(F.lit(True), i % 17 != 0, F.col("lang") == "fr", F.lit(None).cast("string")).alias("valid"),
        (i % 2 == 0).alias("public"),
    )


@query("documents", sql=f"WITH {_STATES} SELECT doc_id, coalesce(c = 'source_text_ready' AND p = 'complete' AND r = 'approved' AND a = 'clear' AND valid AND public AND summary IS NOT NULL AND lang <> '' AND source <> '' AND n >= 500, false) AS eligible FROM d")
def publication_eligible(documents):
    d = _states(documents)
    ready = publication.lifecycle_ready(*(F.col(k) for k in "cpra"))
    return d.select("doc_id", publication.eligible(ready, F.col("valid"), F.col("public"), F.col("summary"), F.col("text"), [F.col("lang"), F.col("source")]).alias("eligible"))


@query(
    "documents",
    sql=f"""WITH {_STATES} SELECT doc_id, CASE WHEN c IS NULL THEN 'backfill.lifecycle_missing' WHEN a <> 'clear' THEN 'backfill.lifecycle_attention_not_clear' WHEN public AND c <> 'source_text_ready' THEN 'backfill.public_collection_ineligible'
WHEN public AND p <> 'complete' THEN 'backfill.public_processing_ineligible' WHEN public AND r = 'rejected' THEN 'backfill.public_review_ineligible' WHEN public AND summary IS NULL THEN 'backfill.public_summary_missing'
WHEN public AND n < 500 THEN 'backfill.public_text_too_short' WHEN public AND NOT valid THEN 'backfill.public_source_policy_invalid' WHEN doc_id % 19 = 0 THEN 'backfill.secret_like_metadata' ELSE 'none' END AS anomaly FROM d""",
)
def publication_anomaly(documents):
    code = publication.anomaly(*(F.col(k) for k in "cpra"), F.col("public"), F.col("summary"), F.col("text"), F.col("valid"), F.col("doc_id") % 19 == 0)
    return _states(documents).select("doc_id", F.coalesce(code, F.lit("none")).alias("anomaly"))


@query(
    "orders",
    sql="""WITH o AS (SELECT o_orderkey, o_orderkey % 7 <> 0 AS has, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'done' END AS s, CASE WHEN o_orderpriority LIKE '1%' THEN 'other' ELSE 'fetch' END AS ph,
o_orderdate AS l, o_orderdate + to_days(CAST(o_orderkey % 3 - 1 AS INTEGER)) AS al, o_orderkey % 5 AS t, o_orderkey % 4 AS u FROM orders)
SELECT o_orderkey, CASE WHEN NOT has THEN 'item_claim_attempt_missing' ELSE concat_ws(',', CASE WHEN s IS NULL THEN 'item_claim_attempt_missing' END, CASE WHEN s = 'done' THEN 'item_claim_attempt_not_running' END,
CASE WHEN ph = 'other' THEN 'item_claim_phase_invalid' END, CASE WHEN l <= TIMESTAMP '1998-01-01' THEN 'item_claim_lease_expired' END, CASE WHEN al <= TIMESTAMP '1998-01-01' THEN 'item_claim_attempt_lease_expired' END,
CASE WHEN l > al THEN 'item_lease_exceeds_attempt_lease' END, CASE WHEN t <> u THEN 'item_claim_fencing_token_mismatch' END, CASE WHEN s = 'done' THEN 'item_claim_command_run_not_running' END) END AS codes FROM o""",
)
def claim_findings(orders):
    i, lease = F.col("o_orderkey"), F.col("o_orderdate")
    state = F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "done")
    codes = publication.claim_findings(
        attempt=F.when(i % 7 != 0, i.cast("string")),
        status=state,
        phase=F.when(F.col("o_orderpriority").startswith("1"), "other").otherwise("fetch"),
        lease=lease,
        attempt_lease=lease + F.make_dt_interval((i % 3 - 1).cast("int")),
        token=(i % 5).cast("string"),
        attempt_token=(i % 4).cast("string"),
        command=state,
        now=F.lit(NOW).cast("timestamp_ntz"),
    )
    return orders.select("o_orderkey", F.array_join(codes, ",").alias("codes"))


@query("orders", sql="SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_run, arg_max(CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'failed' END, (o_orderdate, o_orderkey)) AS last_status, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_success FROM orders GROUP BY 1")
def run_history(orders):
    status = F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed")
    return publication.run_history(orders, "o_custkey", "o_orderkey", "o_orderdate", status, "o_orderdate")


@query(
    "documents",
    sql="""WITH d AS (SELECT doc_id, regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}_]+', '', 'g') AS t, regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '', 'g') AS b FROM documents)
SELECT * FROM (SELECT doc_id, CAST(CASE WHEN t = 'theof' THEN 500 WHEN contains(t, 'theof') THEN 180 ELSE 0 END + CASE WHEN contains(t, 'the') AND contains(t, 'of') THEN 120 ELSE 0 END + contains(t, 'the')::INT * 24 + contains(t, 'of')::INT * 24
+ contains(b, 'the')::INT * 6 + contains(b, 'of')::INT * 6 AS INTEGER) AS score FROM d) WHERE score > 0""",
)
def catalog_score(documents):
    title = F.split(F.col("text"), "\n")[0]
    return documents.select("doc_id", publication.catalog_score(title, F.col("text"), publication.strip_noise("판례 the of")).alias("score")).where("score > 0")


@query("documents", sql="WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[\\x00-\\x20\\x7F]+', ' ', 'g'), ' ') AS p FROM documents) SELECT doc_id, CASE WHEN length(p) <= 320 THEN p ELSE rtrim(substr(p, 1, 319), ' ') || '…' END AS snippet FROM d")
def snippets(documents):
    return documents.select("doc_id", publication.snippet(F.col("text"), 320).alias("snippet"))


@query(
    "orders",
    sql="""WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS e, list(o_orderkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey) AS o FROM orders GROUP BY 1),
r AS (SELECT len(list_intersect(e[1:3], o[1:3])) AS overlap, len(e) AS n, e = o AS same, coalesce(list_min([i for i in range(1, len(e) + 1) if e[i] <> o[i]]) - 1, len(e)) AS prefix FROM l)
SELECT count(*) AS compared, CAST(sum(overlap) AS BIGINT) AS overlap_count, round(avg(overlap / 3.0::DOUBLE), 6) AS overlap_macro, CAST(sum(prefix) AS BIGINT) AS prefix_count, round(avg(prefix / n::DOUBLE), 6) AS prefix_macro,
count(*) FILTER (WHERE same) AS exact_order_count, count(*) AS same_set_count FROM r""",
)
def rank_metrics(orders):
    ordered = lambda first: F.transform(F.array_sort(F.collect_list(F.struct((-first).alias("s"), "o_orderkey"))), lambda x: x["o_orderkey"])
    lists = orders.groupBy("o_custkey").agg(ordered(F.col("o_totalprice")).alias("e"), ordered(F.floor(F.col("o_totalprice") / 50000)).alias("o"))
    return publication.rank_metrics(publication.rank_report(lists, "e", "o", 3), 3)


@query("documents", "embeddings", sql="SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'missing_artifact' WHEN label % 2 <> 0 THEN 'provider' WHEN len(embedding) <> 64 THEN 'dimensions' ELSE 'none' END AS reason FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def artifact_reasons(documents, embeddings):
    j = documents.select("doc_id").join(embeddings, F.col("doc_id") == F.col("vec_id"), "left")
    reason = publication.artifact_reason(F.col("vec_id"), {"provider": F.col("label") % 2 == 0, "dimensions": F.size("embedding") == 64})
    return j.select("doc_id", F.coalesce(reason, F.lit("none")).alias("reason"))


@query("orders", "customer", sql="SELECT c_custkey, c_nationkey % 3 + 10 AS expected, coalesce(n, 0) AS items, m AS manifest, CASE WHEN coalesce(n, 0) = c_nationkey % 3 + 10 THEN 'closed' ELSE 'refused' END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey)) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def snapshot_close(orders, customer):
    expected = customer.select("c_custkey", (F.col("c_nationkey") % 3 + 10).alias("expected"))
    return publication.close_snapshot(orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey", expected)


@query("part", "orders", sql="SELECT p_size AS version, count(*) AS items, count(*) FILTER (WHERE o_orderkey IS NULL OR o_orderkey % 50 <> p_size) AS waiting FROM part LEFT JOIN orders ON o_orderkey = p_partkey GROUP BY 1")
def version_backlog(part, orders):
    done = orders.select(F.col("o_orderkey").alias("p_partkey"), (F.col("o_orderkey") % 50).cast("int").alias("version"))
    return publication.version_backlog(part.select("p_partkey", F.col("p_size").alias("version")), done, "p_partkey", "version")
