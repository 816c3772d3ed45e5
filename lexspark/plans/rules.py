"""Queries of status rules, lifecycle, errors, readiness, tags and admin reads, with their oracles.

Inputs that the driver's tables don't have are derived from their keys by plain SQL that both
engines read alike (``{table}`` stands for a table); what is checked is worked out apart."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import rules, text
from lexspark.operators import lifecycle, maintenance, publication, quality, reading
from lexspark.plans.catalogue import query

NOW = datetime(1998, 8, 1)


def _given(sql: str, **tables: DataFrame) -> DataFrame:
    return next(iter(tables.values())).sparkSession.sql(sql, **tables)


def _as(name: str, sql: str) -> str:
    """The same rows as a common table of the oracle."""
    return f"{name} AS ({re.sub('[{}]', '', sql)})"


def _pick(expr: str, values, n: int | None = None) -> str:
    """SQL for the value at ``expr`` modulo their number; None is NULL."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE ({expr}) % {n or len(values)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


# -- collection, summaries, publication

_CRAWL = f"""SELECT doc_id, lang, text, length(trim(text)) AS n, {_pick("doc_id", ["HTTP 403 Forbidden", "request timed out", "PDF_EMPTY_BUFFER", "ROBOTS_DISALLOW", "ok", "ok", "ok"])} AS message,
doc_id % 5 = 0 AS said, doc_id % 3 = 0 AS strict, doc_id % 17 = 0 AS review, doc_id % 19 = 0 AS seed, CASE WHEN doc_id % 23 = 0 THEN false WHEN doc_id % 2 = 0 THEN true END AS publishable, doc_id % 29 <> 0 AS verified, doc_id % 31 <> 0 AS relevant FROM {{documents}}"""
_LADDER = f"""{_as("c", _CRAWL)}, h AS (SELECT *, coalesce(said OR (NOT strict AND n >= 500), false) AS at_hand FROM c),
s AS (SELECT *, CASE WHEN message = 'ROBOTS_DISALLOW' THEN 'robots_disallowed' WHEN NOT at_hand AND message = 'HTTP 403 Forbidden' THEN 'blocked' WHEN NOT at_hand AND message = 'request timed out' THEN 'timeout'
WHEN NOT at_hand AND message = 'PDF_EMPTY_BUFFER' THEN 'needs_review' WHEN review THEN 'needs_review' WHEN seed OR NOT at_hand THEN 'metadata_only' WHEN NOT publishable THEN 'needs_review' ELSE 'cleaned' END AS status FROM h)"""


def _statuses(documents):
    c = _given(_CRAWL, documents=documents)
    none = F.lit(None)
    attempts = F.array(F.struct(none.cast("int").alias("status"), none.cast("boolean").alias("blocked"), none.cast("boolean").alias("timeout"), none.cast("string").alias("errorCode"), F.lit("fine").alias("errorMessage")), F.struct(F.lit(200).alias("status"), F.lit(False).alias("blocked"), none.cast("boolean").alias("timeout"), F.lit("E").alias("errorCode"), F.col("message").alias("errorMessage")))
    signals = quality.attempt_signals(attempts)
    h = c.withColumn("at_hand", quality.source_text_at_hand(F.col("n"), F.col("said"), F.col("strict"))).withColumns(signals)
    return h.withColumn("status", quality.collection_status(robots=F.col("robots"), blocked=F.col("blocked"), timeout=F.col("timeout"), unreadable=F.col("unreadable"), review=F.col("review"), seed=F.col("seed"), at_hand=F.col("at_hand"), publishable=F.col("publishable")))


@query("documents", sql=f"WITH {_LADDER} SELECT doc_id, status FROM s")
def status_ladder(documents):
    return _statuses(documents).select("doc_id", "status")


@query("documents", sql=f"WITH {_LADDER} SELECT doc_id, status = 'cleaned' AND at_hand AND relevant AND NOT seed AND message <> 'ROBOTS_DISALLOW' AND coalesce(publishable, true) AND verified AS publishable FROM s")
def publishable(documents):
    s = _statuses(documents)
    return s.select("doc_id", quality.publishable(F.col("status"), F.col("at_hand"), F.col("relevant"), F.col("seed"), F.col("robots"), F.col("publishable"), F.col("verified")).alias("publishable"))


@query("documents", sql=f"WITH {_LADDER} SELECT doc_id, status = 'cleaned' AND n >= 500 AND coalesce(publishable, false) AND NOT seed AND at_hand AND message <> 'ROBOTS_DISALLOW' AS can_summarize, doc_id % 4 = 0 AND coalesce(publishable, false) AS listed FROM s")
def summary_eligibility(documents):
    s = _statuses(documents)
    can = quality.can_summarize(F.col("status"), F.col("text"), F.col("publishable"), F.col("seed"), F.col("at_hand"), F.col("robots"))
    return s.select("doc_id", can.alias("can_summarize"), quality.listed(F.when(F.col("doc_id") % 4 == 0, "summarized").otherwise("cleaned"), F.col("publishable")).alias("listed"))


_MOVES = f"""SELECT event_id, {_pick("event_id", [None, "draft", "in_review", "published", "withdrawn", "other"])} AS old_state, {_pick("floor(event_id / 6)", ["draft", "in_review", "published", "withdrawn"])} AS new_state,
{_pick("floor(event_id / 24)", ["human", "llm", "backfill", "compatibility", "system"])} AS actor, floor(event_id / 120) % 2 = 0 AS changed FROM {{events}}"""


@query(
    "events",
    sql=f"""WITH {_as("m", _MOVES)}, bulk AS (SELECT *, actor IN ('compatibility', 'backfill') AS b FROM m)
SELECT event_id, CASE WHEN old_state IS NULL THEN new_state IN ('draft', 'in_review') OR (new_state = 'published' AND b) WHEN old_state = new_state THEN changed WHEN old_state = 'draft' THEN new_state = 'in_review' OR (new_state = 'published' AND b)
WHEN old_state = 'in_review' THEN new_state IN ('draft', 'published', 'withdrawn') WHEN old_state = 'published' THEN new_state = 'withdrawn' WHEN old_state = 'withdrawn' THEN new_state = 'in_review' OR (new_state = 'published' AND (b OR actor = 'human')) ELSE false END AS allowed FROM bulk""",
)
def transition_check(events):
    m = _given(_MOVES, events=events)
    return m.select("event_id", quality.transition_allowed(F.col("old_state"), F.col("new_state"), F.col("actor"), F.col("changed")).alias("allowed"))


_RUNS = f"""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS failed, CASE WHEN o_orderkey % 43 = 0 THEN 2 END AS errors, o_orderkey % 3 AS discovered, o_orderkey % 2 AS tried, o_orderkey % 5 % 2 AS good, o_orderkey % 7 % 2 AS bad,
o_orderkey % 6 AS attempted, o_orderkey % 4 AS verified, o_orderkey % 11 % 4 AS uncollected, o_orderkey % 37 = 0 AS broken, o_orderkey % 47 = 0 AS stale, {_pick("o_orderkey", ["failed", "odd", None], 53)} AS said FROM {{orders}}"""
_OUTCOME = f"""{_as("r", _RUNS)}, t AS (SELECT *, CASE WHEN said IN ('success', 'degraded', 'failed') THEN said WHEN failed > 0 OR coalesce(errors, 0) > 0 OR (discovered = 0 AND tried > 0 AND good = 0 AND bad > 0) THEN 'failed'
WHEN broken OR stale OR (attempted > 0 AND verified = 0 AND uncollected > 0) OR (attempted >= 3 AND uncollected / attempted >= 0.5) THEN 'degraded' ELSE 'success' END AS outcome FROM r)"""


def _outcomes(orders):
    r = _given(_RUNS, orders=orders)
    names = ("failed", "errors", "discovered", "tried", "good", "bad", "attempted", "verified", "uncollected", "broken", "stale", "said")
    return r.withColumn("outcome", maintenance.run_outcome(**{k: F.col(k) for k in names}))


@query("orders", sql=f"WITH {_OUTCOME} SELECT o_orderkey, outcome FROM t")
def run_outcomes(orders):
    return _outcomes(orders).select("o_orderkey", "outcome")


@query("orders", sql=f"WITH {_OUTCOME} SELECT o_custkey, CASE WHEN bool_or(outcome = 'failed') THEN 'failed' WHEN bool_or(outcome = 'degraded') THEN 'degraded' ELSE 'success' END AS outcome FROM t GROUP BY 1")
def ingest_outcomes(orders):
    return _outcomes(orders).groupBy("o_custkey").agg(maintenance.worst_outcome(F.col("outcome")).alias("outcome"))


_LIFE = f"""SELECT event_id, {_pick("event_id", [*lifecycle.STATUSES, "unheard"])} AS status, {_pick("floor(event_id / 13)", [True, False, None]).replace("True", "true").replace("False", "false")} AS at_hand, event_id % 7 = 0 AS signal,
{_pick("floor(event_id / 3)", ["approved", "closed_private", "approved_for_summary", "needs_triage", "published", None, None])} AS decision, event_id % 4 <> 0 AS publishable, event_id % 3 <> 0 AS summary,
{_pick("floor(event_id / 5)", [None, None, "llm.key_missing", "Bad Class", "crawl.blocked", "job.late", None])} AS error, CASE WHEN event_id % 11 = 0 THEN true END AS retryable, event_id % 17 = 0 AS expected FROM {{events}}"""


@query(
    "events",
    sql=f"""WITH {_as("l", _LIFE)}, r AS (SELECT *, CASE WHEN decision = 'closed_private' THEN 'closed_private' WHEN decision IN ('published', 'approved') THEN 'approved' WHEN decision = 'approved_for_summary' THEN 'approved_for_processing' WHEN decision = 'needs_triage' OR status = 'needs_review' THEN 'needs_review' ELSE 'unreviewed' END AS review,
CASE WHEN status = 'unheard' THEN 'backfill.unknown_legacy_status' WHEN signal AND at_hand IS NULL THEN 'backfill.invalid_source_text_signal'
WHEN (status IN ('discovered', 'metadata_only', 'robots_disallowed', 'blocked', 'timeout', 'failed_fetch') AND coalesce(at_hand, false)) OR (status IN ('cleaned', 'summarizing', 'summarized', 'failed_summary') AND NOT coalesce(at_hand, true)) THEN 'backfill.status_text_conflict'
WHEN status = 'summarized' AND NOT summary THEN 'backfill.summarized_without_summary' WHEN status = 'needs_review' AND at_hand IS NULL THEN 'backfill.needs_review_text_ambiguous' WHEN status = 'needs_review' AND NOT at_hand AND summary THEN 'backfill.review_summary_text_conflict'
WHEN decision IN ('published', 'approved') AND NOT publishable THEN 'backfill.approval_publishable_conflict' WHEN error = 'Bad Class' THEN 'backfill.invalid_error_class' END AS anomaly,
CASE WHEN NOT expected THEN coalesce(error, CASE status WHEN 'metadata_only' THEN 'collection.metadata_only' WHEN 'robots_disallowed' THEN 'crawl.robots_disallowed' WHEN 'blocked' THEN 'crawl.blocked' WHEN 'timeout' THEN 'crawl.timeout' WHEN 'failed_fetch' THEN 'crawl.fetch_failed' WHEN 'failed_summary' THEN 'summary.failed' END) END AS code FROM l),
c AS (SELECT *, CASE WHEN status = 'discovered' THEN 'discovered' WHEN status IN ('metadata_only', 'robots_disallowed', 'blocked', 'timeout', 'failed_fetch') THEN 'metadata_only' WHEN status = 'fetched' THEN 'source_fetched' WHEN status = 'needs_review' AND NOT coalesce(at_hand, false) THEN 'metadata_only' ELSE 'source_text_ready' END AS col FROM r)
SELECT event_id, coalesce(anomaly, concat_ws('/', col, CASE WHEN status IN ('cleaned', 'failed_summary') THEN 'ready' WHEN status = 'summarizing' THEN 'running' WHEN status = 'summarized' OR (status = 'needs_review' AND summary) THEN 'complete' WHEN status = 'needs_review' AND col = 'source_text_ready' THEN 'ready' ELSE 'not_ready' END, review,
CASE WHEN expected THEN 'clear' WHEN code IS NOT NULL THEN 'raise' ELSE 'keep' END, code, CASE WHEN code IS NOT NULL THEN CASE WHEN coalesce(retryable, code NOT IN ('crawl.robots_disallowed', 'llm.key_missing')) THEN 'again' ELSE 'never' END END,
CASE WHEN code IN ('crawl.robots_disallowed', 'collection.metadata_only') THEN 'low' WHEN code LIKE 'summary.%' OR code LIKE 'llm.%' OR code LIKE 'job.%' THEN 'high' WHEN code IS NOT NULL THEN 'medium' END, CASE WHEN code LIKE 'summary.%' OR code LIKE 'llm.%' OR code LIKE 'job.%' THEN 'processing' WHEN code IS NOT NULL THEN 'collection' END)) AS state FROM c""",
)
def lifecycle_states(events):
    c = F.col
    s = lifecycle.lifecycle(status=c("status"), text=c("at_hand"), text_signal=c("signal"), publishable=c("publishable"), decision=c("decision"), summary=c("summary"), error=c("error"), retryable=c("retryable"), expected=c("expected"))
    again = F.when(F.col("s.retryable"), "again").when(~F.col("s.retryable"), "never")
    state = F.concat_ws("/", "s.collection", "s.processing", "s.review", "s.attention", "s.code", again, "s.severity", "s.source")
    return _given(_LIFE, events=events).select("event_id", s.alias("s")).select("event_id", F.coalesce("s.anomaly", state).alias("state"))


# -- values


@query(
    "pages",
    sql="""WITH u AS (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN '/?utm_source=x&B=1&UTM_ID=2#f' WHEN 1 THEN '/a//' WHEN 2 THEN '?searchParams=1' WHEN 3 THEN '#top' WHEN 4 THEN '/a/?fbclid=3&gclid=&x=/y/' ELSE '' END AS tail FROM pages)
SELECT page_id, 'https://ex.org' || CASE page_id % 6 WHEN 0 THEN '/?B=1' WHEN 1 THEN '/a/' WHEN 2 THEN '/' WHEN 3 THEN '/' WHEN 4 THEN '/a?x=/y/' ELSE '/' END AS url FROM u""",
)
def canonical_url(pages):
    tail = F.expr("CASE page_id % 6 WHEN 0 THEN '/?utm_source=x&B=1&UTM_ID=2#f' WHEN 1 THEN '/a//' WHEN 2 THEN '?searchParams=1' WHEN 3 THEN '#top' WHEN 4 THEN '/a/?fbclid=3&gclid=&x=/y/' ELSE '' END")
    return pages.select("page_id", text.canonical_url(F.concat(F.lit("HTTPS://Ex.ORG:443"), tail)).alias("url"))


_HEADS = {
    "de-bverfg": ("1 BvR {}/13  Gegenstand der Verfassungsbeschwerde ist ein Urteil", "2 bvr {}/19 Verfassungsbeschwerde des A gegen den Beschluss vom Mai vor dem Landgericht B", "1 BvL {}/13 Verfassungsbeschwerde gegen ein Urteil des Landgerichts", "1 BvR {}/13 Beschwerde gegen ein Gesetz"),
    "es-tribunal-constitucional": ("En el recurso de amparo {} promovido contra la sentencia", "En los recursos de amparo, en causa penal, {}", "Pleno {}. contra la sentencia", "En el recurso de amparo de A. {} Ha sido ponente B. contra la sentencia"),
}


@query("documents", sql="SELECT doc_id, CASE WHEN doc_id % 4 < 2 AND doc_id % 3 = 0 THEN 'de-bverfg-judicial-verfassungsbeschwerde' WHEN doc_id % 4 < 2 AND doc_id % 3 = 1 THEN 'es-tc-judicial-amparo' ELSE 'none' END AS reason FROM documents")
def complaint_classes(documents):
    """Complaints by the heads of decisions, which documents follow; a head of another court's counts for nothing."""
    k = F.col("doc_id")
    head = lambda court: F.element_at(F.array(*(F.replace(F.lit(h), F.lit("{}"), k.cast("string")) for h in _HEADS[court])), (k % 4 + 1).cast("int"))
    de, es = _HEADS
    source = F.when(k % 3 == 0, de).when(k % 3 == 1, es).otherwise("us-scotus")
    said = F.concat(F.when(k % 3 == 0, head(de)).otherwise(head(es)), F.lit("\n"), "text")
    return documents.select("doc_id", F.coalesce(publication.complaint(source, said), F.lit("none")).alias("reason"))


_TAG = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Equal-Protection' WHEN 1 THEN '#scotus' WHEN 2 THEN concat('free', repeat(' ', CAST(doc_id % 3 AS INT) + 1), 'speech') WHEN 3 THEN concat('##', source, '  ', lang) WHEN 4 THEN concat(' ', lang, '-tag ') ELSE '##First   Amendment' END AS t FROM {documents}"""


@query(
    "documents",
    sql=f"""WITH {_as("g", _TAG)}, k AS (SELECT *, regexp_replace(regexp_replace(lower(t), '#', '', 'g'), '[\\s\\-_]+', '', 'g') AS key, trim(regexp_replace(regexp_replace(t, '^#+', ''), '\\s+', ' ', 'g'), ' ') AS plain FROM g)
SELECT doc_id, CASE key WHEN 'equalprotection' THEN '평등원칙' WHEN 'scotus' THEN '미국 연방대법원' WHEN 'freespeech' THEN '표현의 자유' ELSE trim(t, ' ') END AS canonical, CASE lower(plain) WHEN 'free speech' THEN 'Free Speech' WHEN 'first amendment' THEN 'First Amendment' ELSE plain END AS stored,
CASE key WHEN 'equalprotection' THEN 4 WHEN 'scotus' THEN 8 WHEN 'freespeech' THEN 4 WHEN 'firstamendment' THEN 1 ELSE 1 END + CASE WHEN (key = 'equalprotection') OR (key = 'scotus' AND t <> 'SCOTUS') OR (key = 'freespeech' AND t <> 'Free Speech') OR (key NOT IN ('equalprotection', 'scotus', 'freespeech', 'firstamendment') AND t <> trim(t, ' ')) THEN 1 ELSE 0 END AS names FROM k""",
)
def tag_aliases(documents):
    """Canonical names, names as they are stored, and all names of a tag's group."""
    n = _given(_TAG, documents=documents)
    return n.select("doc_id", rules.canonical_tag(F.col("t")).alias("canonical"), rules.tag_name(F.col("t")).alias("stored"), F.size(rules.expanded_tags(F.array("t"))).alias("names"))


@query("orders", sql="SELECT o_orderkey, CAST(o_orderdate AS DATE) BETWEEN DATE '1998-08-01' - 15 AND DATE '1998-08-01' AS recent FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01'")
def recent_decisions(orders):
    some = orders.where(F.col("o_orderdate") >= F.lit(datetime(1998, 6, 1)).cast("timestamp_ntz"))
    return some.select("o_orderkey", rules.recent(F.col("o_orderdate").cast("date"), F.lit("1998-08-01").cast("date")).alias("recent"))


_CHECKPOINTS = f"SELECT o_orderkey, {_pick('o_orderkey', ['de-bverfg', 'us-scotus', 'es-tribunal-constitucional', 'fr-conseil-constitutionnel'])} AS source, CAST({_pick('floor(o_orderkey / 4)', [60, 14, 180, 0])} AS INT) AS floor_days, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS verified, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS succeeded FROM {{orders}}"


@query(
    "orders",
    sql=f"""WITH {_as("c", _CHECKPOINTS)}, m AS (SELECT *, CASE source WHEN 'es-tribunal-constitucional' THEN 730 WHEN 'de-bverfg' THEN greatest(floor_days, 90) ELSE greatest(floor_days, 30) END AS most FROM c)
SELECT o_orderkey, CAST(CASE WHEN coalesce(verified, succeeded) IS NULL THEN least(greatest(1, floor_days), most) ELSE least(greatest(least(greatest(1, floor_days), most), greatest(1, ceil(epoch(TIMESTAMP '1998-08-01' - coalesce(verified, succeeded)) / 86400)) + 2), most) END AS INTEGER) AS days FROM m""",
)
def collection_range_days(orders):
    c = _given(_CHECKPOINTS, orders=orders)
    return c.select("o_orderkey", rules.range_days(F.col("source"), F.col("floor_days"), F.col("verified"), F.col("succeeded"), F.lit(NOW).cast("timestamp_ntz")).alias("days"))


_FOUND = f"SELECT o_orderkey, {_pick('o_orderkey', ['us-scotus', 'de-bverfg'])} AS source, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS published, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL '400' DAY END AS revised FROM {{orders}}"


@query("orders", sql=f"WITH {_as('f', _FOUND)} SELECT o_orderkey, coalesce(published >= TIMESTAMP '1998-01-01', false) OR (source = 'us-scotus' AND coalesce(revised >= TIMESTAMP '1998-06-01', false)) AS inside, source <> 'us-scotus' OR coalesce(revised >= TIMESTAMP '1998-06-01', false) AS open FROM f")
def collection_range_filter(orders):
    f = _given(_FOUND, orders=orders)
    day = lambda *d: F.lit(datetime(*d)).cast("timestamp_ntz")
    inside = lambda start: rules.in_collection_range(F.col("source"), F.col("published"), F.col("revised"), start, day(1998, 6, 1))
    return f.select("o_orderkey", inside(day(1998, 1, 1)).alias("inside"), inside(F.lit(None).cast("timestamp_ntz")).alias("open"))


_ERROR = f"""SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN concat({_pick("event_id", ["The Quota of user ", "HTTP 429 for ", "API key not valid, ", "no Gemini routes are locally available ", "Rate limit hit by ", "Key is required: ", "the model broke at ", "high demand; "])}, user_id, CASE WHEN event_id % 3 = 0 THEN concat('; retry after ', event_id % 40, '.5 s') WHEN event_id % 3 = 1 THEN concat(', Retry  in ', event_id % 4000, ' ms or retry after 2 seconds') ELSE '' END) END AS m,
{_pick("floor(event_id / 8)", ["robots_disallowed", "timeout", "blocked", "metadata_only", "failed_summary", "cleaned"])} AS status FROM {{events}}"""


@query(
    "events",
    sql=f"""WITH {_as("g", _ERROR)}, l AS (SELECT *, coalesce(lower(m), '') AS t FROM g),
w AS (SELECT *, greatest(coalesce(CASE WHEN m IS NULL THEN NULL WHEN event_id % 3 = 0 THEN ((event_id % 40) + 0.5) * 1000 + 2000 WHEN event_id % 3 = 1 THEN greatest(event_id % 4000, 2000) + 2000 END, 0), 1000 * pow(2, event_id % 4)) AS wait FROM l)
SELECT event_id, CASE WHEN contains(t, 'quota') OR contains(t, '429') OR contains(t, 'high demand') THEN 'summary.retryable_quota' WHEN contains(t, 'api key') OR contains(t, 'key missing') OR contains(t, 'no gemini routes are locally available') THEN 'llm.key_missing' ELSE 'summary.model_error' END AS summary,
CASE WHEN contains(t, 'api key') OR contains(t, 'key is required') OR contains(t, 'key missing') THEN 'llm.key_missing' WHEN contains(t, 'quota') OR contains(t, '429') OR contains(t, 'rate limit') OR contains(t, 'high demand') THEN 'summary.retryable_quota' ELSE 'summary.model_error' END AS llm,
least(60000, wait)::DOUBLE AS wait_ms, CASE status WHEN 'robots_disallowed' THEN 'crawl.robots_disallowed' WHEN 'timeout' THEN 'crawl.timeout_response' WHEN 'blocked' THEN 'crawl.blocked_403' WHEN 'metadata_only' THEN 'extract.empty_text' WHEN 'failed_summary' THEN 'summary.model_error' ELSE 'none' END AS fallback FROM w""",
)
def error_classes(events):
    """Classes of messages, how long to wait as they ask, and classes of statuses."""
    n = _given(_ERROR, events=events)
    return n.select("event_id", rules.summary_error(F.col("m"), F.lit(False)).alias("summary"), rules.llm_error(F.col("m")).alias("llm"), rules.summary_wait(F.col("m"), F.col("event_id") % 4, 1000, 60_000).alias("wait_ms"), F.coalesce(rules.error_of_status(F.col("status")), F.lit("none")).alias("fallback"))


_CODES = ["BVERFG_OFFICIAL_VARIANTS_404", "BVERFG_OFFICIAL_DETAIL_404", "HTTP_403", "CRAWLEE_DETAIL_EMPTY", "BVERFG_SITE_BLOCK_CIRCUIT_OPEN", None]


@query(
    "orders",
    sql=f"""WITH {_as("c", f"SELECT o_orderkey, floor(o_orderkey / 6) % 13 AS a, {_pick('o_orderkey', ['variants-404', 'single-404', 'blocked', 'empty', 'blocked', 'none'])} AS k FROM {{orders}}")}
SELECT o_orderkey, CAST(CASE k WHEN 'variants-404' THEN CASE WHEN a >= 10 THEN 72 WHEN a >= 6 THEN 48 WHEN a >= 3 THEN 24 ELSE 12 END WHEN 'empty' THEN CASE WHEN a >= 6 THEN 24 WHEN a >= 3 THEN 12 ELSE 3 END WHEN 'blocked' THEN CASE WHEN a >= 6 THEN 72 WHEN a >= 3 THEN 24 ELSE 6 END ELSE 0 END AS INTEGER) AS hours FROM c""",
)
def candidate_waits(orders):
    c = _given(f"SELECT o_orderkey, floor(o_orderkey / 6) % 13 AS a, {_pick('o_orderkey', _CODES)} AS code FROM {{orders}}", orders=orders)
    return c.select("o_orderkey", rules.candidate_wait(F.col("a"), F.col("code")).alias("hours"))


_ROUTES = f"""SELECT event_id, {_pick("event_id", ["claude-", "GPT-", "big-gemini-", "llama-", "o3-", "claude-"])} || user_id AS model, CASE WHEN event_id % 12 = 4 THEN 'own' END AS said, CASE event_id % 5 WHEN 0 THEN concat(' asked', user_id, ' ') WHEN 1 THEN ' ' END AS asked,
CASE event_id % 4 WHEN 1 THEN concat('Gemini route a-', user_id, '/key-1 failed, {{{{"route" : "b', event_id % 7, '/key-22"}}}}, Gemini route a-', user_id, '/key-3') WHEN 2 THEN concat('"route":"c', event_id, '/key-0"') WHEN 3 THEN 'Gemini route broke' END AS message FROM {{events}}"""


@query(
    "events",
    sql=f"""WITH {_as("g", _ROUTES)}
SELECT event_id, coalesce(said, CASE WHEN lower(model) LIKE 'claude-%' THEN 'anthropic' WHEN lower(model) LIKE 'gpt-%' OR lower(model) LIKE 'o3%' THEN 'openai' WHEN contains(model, 'gemini') THEN 'gemini' ELSE 'unknown' END) AS provider,
CASE WHEN trim(asked) <> '' THEN trim(asked) ELSE CASE event_id % 4 WHEN 1 THEN split_part(split_part(message, 'Gemini route ', 2), '/', 1) || ',b' || event_id % 7 WHEN 2 THEN 'c' || event_id ELSE '' END END AS failed FROM g""",
)
def failed_models(events):
    """Who serves a model, and the models whose routes a message names, each once."""
    n = _given(_ROUTES, events=events)
    return n.select("event_id", rules.provider(F.col("model"), F.col("said")).alias("provider"), F.array_join(rules.failed_models(F.col("asked"), F.col("message")), ",").alias("failed"))


def _summaries_of(documents):
    """doc_id, lang, source, s: summaries as JSON, of which those of doc_id % 8 < 2 are of the right structure."""
    k, q = F.col("doc_id"), '"'
    cat = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    title = F.when(k % 8 == 2, F.lit("7")).otherwise(cat(q, F.col("source"), q))
    core = F.when(k % 8 == 1, F.lit("")).when(k % 8 == 3, cat(q, F.col("lang"), q, ", 1")).otherwise(cat(q, F.col("lang"), q, ", ", q, "core ", k.cast("string"), q))
    background = F.when(k % 8 == 1, F.lit("")).otherwise(cat("b", k.cast("string")))
    implications = F.when(k % 8 == 4, F.lit("")).otherwise(F.lit(', "implications": ""'))
    tags = F.when(k % 8 == 1, F.lit("")).otherwise(cat(q, F.col("lang"), q, ",", q, F.col("source"), q, ",", q, F.col("lang"), q))
    normal = F.when(k % 8 == 5, F.lit("")).otherwise(cat(', "normalizedName": ', q, F.col("lang"), q))
    entities = F.when(k % 8 == 1, F.lit("")).otherwise(cat('{"name": "', F.col("source"), '", "type": "law"', normal, "}"))
    whole = cat('{"koreanTitle": ', title, ', "summary": {"coreSummary": [', core, '], "background": "', background, q, implications, '}, "tags": [', tags, '], "entities": [', entities, "]}")
    s = F.when(k % 8 == 6, F.substring(whole, 1, 30)).when(k % 8 != 7, whole)
    return documents.select("doc_id", "lang", "source", s.alias("s"))


@query("documents", sql="SELECT doc_id, doc_id % 8 < 2 AS valid, CASE doc_id % 8 WHEN 0 THEN lang || ':law,' || source || ':topic' WHEN 1 THEN '' ELSE 'none' END AS tags FROM documents")
def summaries(documents):
    """Summaries of the right structure, and their tags: entities first, each slug once."""
    n = _summaries_of(documents).select("doc_id", rules.valid_summary(F.col("s")).alias("s"))
    entities = F.transform("s.entities", lambda e: F.struct(e["name"].alias("name"), e["normalizedName"].alias("normalized"), e["type"].alias("type")))
    tags = lifecycle.summary_tags(entities, F.col("s.tags"), text.slugify)
    said = F.array_join(F.transform(tags, lambda t: F.concat_ws(":", t["slug"], t["type"])), ",")
    return n.select("doc_id", F.col("s").isNotNull().alias("valid"), F.when(F.col("s").isNull(), "none").otherwise(said).alias("tags"))


@query("documents", sql="""SELECT doc_id, '{"a":[{"x":null,"y":' || doc_id || '}],"b":"é' || lang || '","c":true,"' || source || '":{"n":' || n_chars || '}}' AS json FROM documents""")
def canonical_json(documents):
    """Keys in order at every depth, and no blanks."""
    raw = F.concat(F.lit('{ "'), "source", F.lit('": {"n" :'), F.col("n_chars").cast("string"), F.lit('}, "c" : true, "b":"\\u00e9'), "lang", F.lit('", "a": [ {"y": '), F.col("doc_id").cast("string"), F.lit(', "x": null} ] }'))
    return documents.select("doc_id", rules.canonical_json(raw).alias("json"))


_COURTS = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'fr-conseil-constitutionnel' ELSE 'us-scotus' END AS s, concat(lang, ' the Conseil constitutionnel ', doc_id, ' and French Constitutional Council, SCOTUS', CASE WHEN doc_id % 3 = 0 THEN ' (SCOTUS)' ELSE 'X' END, ' ', source) AS t FROM {documents}"""


@query(
    "documents",
    sql=f"""WITH {_as("g", _COURTS)} SELECT doc_id, CASE WHEN s = 'us-scotus' THEN regexp_replace(t, '\\bSCOTUS\\b', '미국 연방대법원', 'g') ELSE replace(replace(t, 'Conseil constitutionnel', '프랑스 헌법위원회'), 'French Constitutional Council', '프랑스 헌법위원회') END AS text FROM g""",
)
def terminology(documents):
    """A source's court under its canonical name; other courts' names stay."""
    return _given(_COURTS, documents=documents).select("doc_id", rules.terminology(F.col("t"), F.col("s")).alias("text"))


@query("conversations", sql="SELECT conv_id, turn, (contains(lower(text), 'standing'))::INT + 2 AS score FROM conversations WHERE text IS NOT NULL")
def keyword_scores(conversations):
    """How many of the fixed keywords a text holds; a fixed title adds two."""
    return conversations.where("text is not null").select("conv_id", "turn", rules.keyword_score(F.lit("Constitutional  matters"), F.col("text"), F.lit("")).alias("score"))


# -- versions, projections, comparisons

_META = """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('{{"a":{{"api_key":', doc_id, '}}}}') WHEN 1 THEN concat('{{"a":"password ', source, '"}}') WHEN 2 THEN concat('[{{"b":[{{"My-Secret":"', lang, '"}}]}}]') WHEN 3 THEN concat('{{"caseNumber":"', doc_id, '","collection":{{"publishable":true}}}}')
WHEN 4 THEN concat('{{"docket":"', source, '","decisionNumber":"1","collection":{{"publishable":"true"}}}}') WHEN 5 THEN concat('{{"resolutionType":"', lang, '","collection":{{"publishable":1}}}}') WHEN 6 THEN concat('no json ', doc_id) END AS m FROM {documents}"""


@query(
    "documents",
    sql="""SELECT doc_id, doc_id % 8 IN (0, 2) AS secret, doc_id % 8 IN (3, 4) AS publishable, CASE doc_id % 8 WHEN 3 THEN CAST(doc_id AS VARCHAR) WHEN 4 THEN source ELSE 'none' END AS number, CASE doc_id % 8 WHEN 5 THEN lang ELSE 'none' END AS kind FROM documents""",
)
def metadata_reads(documents):
    """Secret keys at any depth, textually true flags, the first filled key and leafs of JSON metadata."""
    n = _given(_META, documents=documents)
    leaf = reading.leafs(F.lit(None).cast("string"), F.col("m"))[2]
    return n.select("doc_id", lifecycle.has_secret_key(F.col("m")).alias("secret"), reading.textually_true(F.col("m"), "$.collection.publishable").alias("publishable"), F.coalesce(reading.first_of(F.col("m")), F.lit("none")).alias("number"), F.coalesce(leaf, F.lit("none")).alias("kind"))


@query(
    "documents",
    sql=f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'k' || doc_id WHEN doc_id % 8 = 2 THEN '7' WHEN doc_id % 8 < 6 THEN source ELSE 'o' || doc_id END AS title,
CASE WHEN doc_id % 5 = 0 THEN 'line ' || lang WHEN doc_id % 8 < 6 AND doc_id % 8 <> 1 THEN lang ELSE '{reading.NO_SUMMARY}' END AS one_line_summary, doc_id % 8 <> 7 AS summary_available FROM documents""",
)
def list_items(documents):
    """Titles and lines of a list, and what stands in where they are missing."""
    k = F.col("doc_id")
    line = F.when(k % 5 == 0, F.concat(F.lit("line "), "lang")).when(k % 5 == 1, "")
    n = _summaries_of(documents).withColumns({"k": F.when(k % 3 == 0, F.concat(F.lit("k"), k.cast("string"))).when(k % 3 == 1, ""), "o": F.concat(F.lit("o"), k.cast("string")), "l": line})
    return n.select("doc_id", *reading.list_item(F.col("k"), F.col("o"), F.col("s"), F.col("l")))


@query(
    "documents",
    sql="""WITH d AS (SELECT doc_id, sha256(text) AS c, sha256(CAST(doc_id AS VARCHAR) || ':' || sha256(text)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS version_id FROM d""",
)
def version_ids(documents):
    return documents.select("doc_id", lifecycle.version_id(F.col("doc_id").cast("string"), F.sha2(F.col("text").cast("binary"), 256)).alias("version_id"))


@query(
    "documents",
    sql="""WITH d AS (SELECT doc_id, trim(CASE WHEN trim(lang) = 'de' THEN 'Titel' ELSE split_part(text, chr(10), 1) END) AS t, concat_ws(chr(10), source, CASE WHEN lang <> 'fr' THEN lang END) AS s FROM documents)
SELECT doc_id, t AS title, s AS search_text, sha256('search-document/v1' || chr(10) || to_json({'display_title': t, 'doc_id': doc_id, 'search_text': s})) AS checksum FROM d""",
)
def projection_documents(documents):
    title = lifecycle.first_filled(F.when(F.col("lang") == "de", " Titel "), F.split("text", "\n")[0])
    said = lifecycle.joined_filled([F.concat(F.lit(" "), F.col("source")), F.lit("  "), F.when(F.col("lang") != "fr", F.col("lang")), F.lit(None).cast("string")])
    d = documents.select("doc_id", title.alias("title"), said.alias("search_text"))
    return d.withColumn("checksum", lifecycle.checksum({"doc_id": F.col("doc_id"), "display_title": F.col("title"), "search_text": F.col("search_text")}))


@query(
    "orders",
    sql="""SELECT 'same' AS pair, count(*) AS primary_count, count(*) AS shadow_count, true AS matched, 'none' AS diff_path FROM orders
UNION ALL SELECT 'one value', count(*), count(*), false, '[' || (SELECT count(*) FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 500 = 0)) || '].o_totalprice' FROM orders
UNION ALL SELECT 'one less', count(*), count(*) - 1, false, '[' || (count(*) - 1) || ']' FROM orders UNION ALL SELECT 'one missing', count(*), count(*) - 1, false, '[' || (SELECT count(*) FROM orders WHERE o_orderkey < 100) || '].o_custkey' FROM orders""",
)
def result_comparison(orders):
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    pairs = {
        "same": o,
        "one value": o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 500 == 0, -1.0).otherwise(F.col("o_totalprice"))),
        "one less": o.join(last, F.col("o_orderkey") == F.col("last"), "left_anti"),
        "one missing": o.where("o_orderkey <> 100"),
    }
    out = None
    for name, other in pairs.items():
        row = lifecycle.compare(o, other, "o_orderkey", ["o_custkey", "o_totalprice"]).select(F.lit(name).alias("pair"), "primary_count", "shadow_count", "matched", F.coalesce("diff_path", F.lit("none")).alias("diff_path"))
        out = row if out is None else out.unionByName(row)
    return out


@query("orders", "events", sql="SELECT 'attempts' AS domain, count(*) FILTER (WHERE o_orderstatus <> 'O' AND o_orderdate < TIMESTAMP '1995-01-01') AS due FROM orders UNION ALL SELECT 'events', count(*) FILTER (WHERE value > 99) FROM events")
def retention_due(orders, events):
    old = (F.col("o_orderstatus") != "O") & (F.col("o_orderdate") < F.lit(datetime(1995, 1, 1)).cast("timestamp_ntz"))
    return lifecycle.due({"attempts": (orders, old), "events": (events, F.col("value") > 99)})


_BLOBS = """d AS (SELECT doc_id, source, CASE WHEN doc_id % 3 <> 0 THEN '"' || doc_id || chr(10) || '\\' END AS t FROM documents), e AS (SELECT *, '"\\"' || doc_id || '\\n\\\\"' AS doc FROM d),
f AS (SELECT *, sha256(doc) AS h, doc_id % 5 AS k FROM e)"""


@query(
    "documents",
    sql=f"""WITH {_BLOBS}, g AS (SELECT t IS NOT NULL AS i, k = 0 AS a, k IN (1, 2) AS c, doc_id % 2 = 0 AND k <> 0 AS l, CASE WHEN t IS NOT NULL THEN length(doc) END AS b FROM f)
SELECT count(*) AS total_rows, count(*) FILTER (WHERE i) AS inline_present, count(*) FILTER (WHERE NOT i) AS inline_missing, count(*) FILTER (WHERE a) AS metadata_absent, count(*) FILTER (WHERE c) AS metadata_complete, count(*) FILTER (WHERE NOT a AND NOT c) AS metadata_inconsistent,
count(*) FILTER (WHERE i AND c) AS dual_copy, count(*) FILTER (WHERE NOT i AND c) AS blob_only, count(*) FILTER (WHERE i AND a) AS inline_only, count(*) FILTER (WHERE l) AS exact_ledger_covered, count(*) FILTER (WHERE c AND NOT l) AS ledger_missing_or_conflicting, count(*) FILTER (WHERE i AND c AND l) AS clearable_rows, CAST(sum(b) AS BIGINT) AS inline_blob_bytes_estimated FROM g""",
)
def blob_readiness(documents):
    k = F.col("doc_id") % 5
    raw = documents.select("doc_id", "source", F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit("\n\\")).alias("t"))
    b = raw.withColumn("b", lifecycle.blob(F.col("t"), F.col("source")))
    there = lambda c: F.when(k != 0, c)
    rows = b.select(
        "doc_id",
        "source",
        F.when(F.col("doc_id") % 3 != 0, F.col("t")).alias("text"),
        there(F.when(k == 3, F.lit("elsewhere")).otherwise(F.col("b.ref"))).alias("ref"),
        there(F.col("b.sha256")).alias("hash"),
        there(F.col("b.bytes")).alias("size"),
        there(F.when(k != 4, F.lit(NOW))).alias("at"),
        there(F.lit(lifecycle.BLOB_CONTRACT)).alias("contract"),
    )
    ledger = rows.where("doc_id % 2 = 0").select("doc_id", "ref", "hash", "size", "contract")
    return lifecycle.blob_readiness(rows, ledger.unionByName(ledger), "doc_id")


@query("documents", sql=f"WITH {_BLOBS} SELECT doc_id, sha256(doc) AS sha256, CAST(length(doc) AS INTEGER) AS bytes, 'artifacts/article_raw/' || source || '/' || h || '.json' AS ref, false AS too_large FROM f WHERE t IS NOT NULL")
def text_blobs(documents):
    """A text as a JSON document under the hash of its bytes."""
    t = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit("\n\\"))
    b = documents.where("doc_id % 3 <> 0").select("doc_id", lifecycle.blob(t, F.col("source")).alias("b"))
    return b.select("doc_id", "b.sha256", "b.bytes", "b.ref", "b.too_large")


_ARTIFACTS = f"""SELECT event_id, {_pick('event_id', ['r', ' ', None])} AS ref, {_pick('floor(event_id / 3)', ['v1', 'v0', None])} AS contract, floor(event_id / 9) % 2 = 0 AS inline_here, floor(event_id / 18) % 2 = 0 AS dated,
{_pick('floor(event_id / 36)', ['fetch', 'normalization', 'other'])} AS kind, {_pick('floor(event_id / 108)', ['full_snapshot', 'bounded_evidence', 'replayable'])} AS replay, event_id % 100 - 1 AS size FROM {{events}}"""


@query(
    "events",
    sql=f"""WITH {_as("a", _ARTIFACTS)}, b AS (SELECT *, coalesce(ref = 'r', false) AS x, contract IS NOT NULL AS s, inline_here AS h FROM a), c AS (SELECT *, (x AND (NOT s OR NOT dated)) OR (NOT x AND (s OR dated)) AS torn, kind = 'fetch' AND replay = 'full_snapshot' AND (h OR x) AS odd FROM b)
SELECT event_id, h AND x AS dual_copy, NOT h AND x AS blob_only, h AND NOT x AS inline_only, x AND h AND dated AND coalesce(contract = 'v1', false) AS clearable, torn OR odd OR ((kind = 'normalization' OR replay = 'bounded_evidence') AND NOT h AND NOT x) AS metadata_inconsistent, x AND coalesce(contract = 'v0', false) AS contract_mismatch,
CASE WHEN h AND size >= 0 AND NOT odd AND NOT torn THEN size ELSE -1 END AS recorded_size FROM c WHERE event_id > 100 ORDER BY event_id LIMIT 1000""",
)
def artifact_classes(events):
    """Artifacts behind an id, a page of a thousand, and where their content is."""
    a = _given(_ARTIFACTS, events=events).where("event_id > 100").orderBy("event_id").limit(1000)
    c = F.col
    got = lifecycle.artifact_class(ref=c("ref"), contract=c("contract"), inline=c("inline_here"), at=c("dated"), kind=c("kind"), replay=c("replay"), size=c("size"), supported="v1")
    flags = ("dual_copy", "blob_only", "inline_only", "clearable", "metadata_inconsistent", "contract_mismatch")
    return a.select("event_id", got.alias("g")).select("event_id", *(f"g.{n}" for n in flags), F.coalesce("g.recorded_size", F.lit(-1)).alias("recorded_size"))


_ITEMS = "SELECT doc_id, sha2(text, 256) AS hash, lang AS title, doc_id % 7 AS date, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 4 AS STRING) END AS case_number FROM {documents}"


@query(
    "documents",
    sql="""WITH i AS (SELECT doc_id, sha256(text) AS hash, lang AS title, doc_id % 7 AS date, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 4 AS VARCHAR) END AS c FROM documents), n AS (SELECT * FROM i WHERE doc_id % 10 = 0), s AS (SELECT * FROM i WHERE doc_id % 10 = 5 OR doc_id % 10 = 1),
h AS (SELECT n.doc_id, min(s.doc_id) AS o FROM n JOIN s USING (hash) GROUP BY 1), t AS (SELECT n.doc_id, min(s.doc_id) AS o FROM n JOIN s ON n.title = s.title AND n.date = s.date AND (n.c IS NULL OR s.c IS NULL OR n.c = s.c) GROUP BY 1)
SELECT doc_id, CASE WHEN h.o IS NOT NULL THEN 'content_hash' ELSE 'title_date' END AS reason, coalesce(h.o, t.o) AS of FROM h FULL JOIN t USING (doc_id)""",
)
def known_already(documents):
    i = _given(_ITEMS, documents=documents)
    return lifecycle.known_already(i.where("doc_id % 10 = 0"), i.where("doc_id % 10 IN (1, 5)"), "doc_id")


# -- rank gates and canaries


@query(
    "orders",
    sql="""WITH o AS (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_totalprice DESC, o_orderkey) AS seen, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS want FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN 'informational' WHEN o_custkey % 11 = 0 THEN 'not_applicable' WHEN o_custkey % 13 = 0 THEN 'fail' WHEN list_contains(want[1:2], seen[1]) AND (o_custkey % 2 = 0 OR list_contains(want[1:2], want[-1])) THEN 'pass' ELSE 'fail' END AS status,
CASE o_custkey % 4 WHEN 0 THEN seen[1:2] = want[1:2] WHEN 1 THEN seen[1] = want[1] WHEN 2 THEN list_contains(seen[1:2], want[1]) ELSE seen[1] = want[1] AND o_custkey % 5 >= 2 END AS canary,
CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN seen[1] = want[1] THEN 'match' WHEN o_custkey % 2 = 0 THEN 'mismatch' ELSE 'informational' END ELSE CASE WHEN list_contains(seen[1:3], want[1]) THEN 'match' ELSE 'mismatch' END END AS parity FROM o""",
)
def rank_cases(orders):
    """Rank policy, canary expectation and oracle parity of each customer's orders by price and by key."""
    ids = lambda by: F.transform(F.array_sort(F.collect_list(F.struct(by.alias("s"), F.col("o_orderkey").alias("k")))), lambda x: x["k"].cast("string"))
    o = orders.groupBy("o_custkey").agg(ids(-F.col("o_totalprice")).alias("seen"), ids(F.col("o_orderkey")).alias("want"))
    k, two = F.col("o_custkey"), F.slice("want", 1, 2)
    oracle = F.when(k % 2 == 1, F.array(F.element_at("want", -1))).otherwise(F.array().cast("array<string>"))
    status = lifecycle.policy_status(informational=k % 7 == 0, expected=F.when(k % 11 != 0, two), frozen=k % 13 == 0, validated=F.lit(False), observed=F.col("seen"), oracle=oracle)
    kind = F.element_at(F.array(*map(F.lit, ("exact-order", "top-id", "contains", "self-top"))), (k % 4 + 1).cast("int"))
    canary = lifecycle.canary_ok(kind=kind, ids=F.col("seen"), expected=two, within=F.lit(2), score=k % 5, least=F.lit(2))
    parity = lifecycle.oracle_parity(F.when(k % 3 == 0, "fulltext").otherwise("hybrid"), F.slice("seen", 1, 3), F.col("want"), k % 2 == 0)
    return o.select("o_custkey", status.alias("status"), canary.alias("canary"), parity.alias("parity"))


@query(
    "events",
    sql="""WITH c AS (SELECT event_type AS mode, CASE WHEN event_id % 10 = 0 THEN 'timeout' WHEN event_id % 7 = 0 THEN 'mismatch' ELSE 'pass' END AS s, value FROM events)
SELECT mode, count(*) AS cases, count(*) FILTER (WHERE s <> 'timeout') AS compared, count(*) FILTER (WHERE s = 'pass') AS passed, quantile_disc(value, 0.5) FILTER (WHERE s <> 'timeout') AS p50, quantile_disc(value, 0.95) FILTER (WHERE s <> 'timeout') AS p95, count(*) FILTER (WHERE s = 'pass') >= 0.75 * count(*) AS ok FROM c GROUP BY 1""",
)
def canary_summary(events):
    k = F.col("event_id")
    cases = events.select(F.col("event_type").alias("mode"), F.when(k % 10 == 0, "timeout").when(k % 7 == 0, "mismatch").otherwise("pass").alias("status"), "value")
    return lifecycle.canary_summary(cases, "value", 0.75)


@query("events", sql="SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def pinned_snapshots(events):
    return lifecycle.pinned(events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


# -- reads


@query("orders", "customer", sql="SELECT c_mktsegment AS segment, count(*) AS n, 'x' AS a, 2 AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1")
def authored_read(orders, customer):
    sql = "SELECT c_mktsegment AS segment, count(*) AS n, '{{\"a\":\"x\",\"b\":2}}' AS data FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > :least GROUP BY 1"
    got = reading.authored(orders.sparkSession, sql, {"least": 200000}, {"data": "struct<a:string,b:int>"}, orders=orders, customer=customer)
    return got.select("segment", "n", "data.a", "data.b")


@query(
    "documents",
    sql="""SELECT doc_id AS article_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 2 = 1 AND (doc_id % 11 <> 0 OR (doc_id % 4 = 1 AND doc_id % 13 <> 0))""",
)
def public_articles(documents):
    """Published, summarised, fresh and publishable articles whose enrichment fits their anchor, if any."""
    d, k = documents.select(F.col("doc_id").alias("article_id")), F.col("article_id")
    name = lambda c, v: F.concat(F.lit(v), c.cast("string"))
    articles = d.select(k, F.when(k % 3 != 0, "summarized").otherwise("cleaned").alias("status"), (k % 7 == 0).alias("stale"), F.when(k % 2 == 1, F.when(k % 4 == 1, '{"collection":{"publishable":true}}').otherwise('{"collection":{"publishable":"true"}}')).otherwise('{"collection":{"publishable":1}}').alias("metadata"))
    publications = d.select(k, name(k, "v").alias("version_id"), F.when(k % 5 != 0, "published").otherwise("draft").alias("state"))
    own = d.select(k, name(k, "v").alias("version_id"), F.when(k % 4 == 1, "enrichment_full").otherwise("other").alias("role"), name(k, "a").alias("anchor_id"), F.lit(None).cast("string").alias("source_hash"), F.lit("h").alias("enriched_hash"))
    anchors = d.select(k, name(k, "a").alias("version_id"), F.lit("authoritative_source").alias("role"), F.lit(None).cast("string").alias("anchor_id"), F.when(k % 13 != 0, "h").otherwise("").alias("source_hash"), F.lit(None).cast("string").alias("enriched_hash"))
    catalogue = d.where(k % 11 == 0).select(k, name(k, "a").alias("anchor_id"), F.lit("published").alias("state"))
    return reading.public_articles(articles, publications, own.unionByName(anchors), catalogue)


@query(
    "orders",
    "lineitem",
    "part",
    sql="""WITH t AS (SELECT o_orderkey AS article_id, list(p_brand || ':' || l_linenumber ORDER BY p_brand, l_linenumber) AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size <= 10 GROUP BY 1)
SELECT o_orderkey AS article_id, coalesce(array_to_string(l, ','), '') AS tags FROM orders LEFT JOIN t ON article_id = o_orderkey""",
)
def hydrated_tags(orders, lineitem, part):
    links = lineitem.select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("tag_id"), F.col("l_linenumber").alias("confidence"))
    tags = part.where("p_size <= 10").select(F.col("p_partkey").alias("tag_id"), F.col("p_brand").alias("slug"), F.col("p_name").alias("name"))
    got = reading.with_tags(orders.select(F.col("o_orderkey").alias("article_id")), links, tags)
    return got.select("article_id", F.array_join(F.transform("article_tags", lambda t: F.concat_ws(":", t["slug"], t["confidence"].cast("string"))), ",").alias("tags"))


@query("part", sql="SELECT p_partkey, p_name AS name, p_size AS article_count FROM part WHERE p_brand = 'Brand#1' AND p_size >= 20 ORDER BY article_count DESC, name, p_partkey LIMIT 30")
def tag_listing(part):
    tags = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("article_count"), F.col("p_brand").alias("type"), F.lit(None).cast("date").alias("latest_article_at"))
    return reading.tag_list(tags, "Brand#1", 20, "count", 1000).orderBy(F.desc("article_count"), "name", "p_partkey").limit(30).select("p_partkey", "name", "article_count")


_ADMIN = f"SELECT o_orderkey AS id, {_pick('o_orderkey', ['cleaned', 'needs_review', 'summarizing', 'summarized', 'blocked'])} AS status, o_orderdate AS updated_at, {_pick('floor(o_orderkey / 5)', [None, 'closed_private', 'approved'])} AS decision, o_orderkey % 3 = 0 AS publishable, o_orderkey % 4 <> 0 AS has_summary FROM {{orders}}"


@query("orders", sql=f"WITH {_as('a', _ADMIN)} SELECT id, (status IN ('needs_review', 'blocked') OR (status = 'summarizing' AND updated_at < TIMESTAMP '1998-07-31 23:30:00')) AND coalesce(decision, '') <> 'closed_private' AS attention FROM a")
def attention_articles(orders):
    a = _given(_ADMIN, orders=orders)
    return a.select("id", reading.attention(F.col("status"), F.col("updated_at"), F.col("decision"), NOW).alias("attention"))


@query("orders", sql=f"WITH {_as('a', _ADMIN)}, m AS (SELECT * FROM a WHERE status = 'cleaned' AND publishable AND NOT has_summary) SELECT id, status, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) > 20 AS has_more FROM m ORDER BY updated_at DESC NULLS LAST, id LIMIT 10 OFFSET 10")
def admin_list_page(orders):
    return reading.admin_page(_given(_ADMIN, orders=orders), {"status": "cleaned", "decision": None}, "yes", "no", 2, 10).select("id", "status", "total", "has_more")


@query(
    "nation",
    "orders",
    sql="""WITH o AS (SELECT o_custkey % 30 AS k, o_orderstatus AS s, o_orderdate AS d FROM orders) SELECT coalesce(n_nationkey, k) AS k, count(*) FILTER (WHERE s = 'F') AS F_count, count(*) FILTER (WHERE s = 'P') AS P_count, max(d) AS latest_d FROM nation FULL JOIN o ON k = n_nationkey + 2 - 2 AND n_nationkey <> 3 GROUP BY 1""",
)
def candidate_pivot(nation, orders):
    """Candidates by status of registered sources and of others."""
    sources = nation.select(F.col("n_nationkey").cast("long").alias("k"))
    found = orders.select((F.col("o_custkey") % 30).alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderdate").alias("d"))
    return reading.status_counts(sources, found, "k", "s", ["F", "P"], ["d"])


@query("events", sql="SELECT coalesce(json_extract_string(props, '$.action'), event_type) AS action, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1 ORDER BY n DESC, action LIMIT 10")
def admin_actions(events):
    return reading.top_actions(events, "event_type", ["click", "view"], F.col("props"))


@query("events", sql="SELECT event_id FROM events WHERE event_type = 'click' AND contains(lower(concat_ws(' ', event_type, CAST(user_id AS VARCHAR), props)), 'click 7')")
def audit_search(events):
    named = events.withColumn("action", F.col("event_type"))
    return reading.audit(named, "click", " CLICK 7", [F.col("event_type"), F.col("user_id").cast("string"), F.col("props")]).select("event_id")


@query("events", sql="SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m') AS month, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY 1 ORDER BY month DESC LIMIT 60")
def timeline_monthly_kst(events):
    return reading.monthly(events, "ts", {"clicks": F.col("event_type") == "click", "large": F.col("value") > 50})


@query("orders", "lineitem", sql="SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = o.o_orderstatus AND l.l_returnflag IS NOT DISTINCT FROM CASE WHEN o.o_orderstatus = 'F' THEN 'R' ELSE 'N' END)")
def unserved_versions(orders, lineitem):
    """Orders without a line that is equal in key, status and flag."""
    o = orders.select("o_orderkey", F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("f"))
    li = lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("s"), F.col("l_returnflag").alias("f"))
    return reading.unserved(o, li, ["k", "s", "f"]).select("o_orderkey")


@query("orders", "lineitem", sql="SELECT count(*) AS n, min(o_orderkey) AS first FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus")
def two_key_join(orders, lineitem):
    j = orders.join(lineitem, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linestatus") == F.col("o_orderstatus")))
    return j.agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("documents", sql="SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'the') AND contains(lower(concat_ws(' ', source, lang, text)), 'src1')")
def all_terms_filter(documents):
    return documents.where(maintenance.all_terms([F.col("source"), F.col("lang"), F.col("text")], ["the", "SRC1"])).select("doc_id")


@query("part", sql="SELECT p_brand, 1000 - min(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 9 END) FILTER (WHERE p_size % 10 = p_partkey % 10) AS score FROM part GROUP BY 1 HAVING score IS NOT NULL")
def identity_score(part):
    kind = F.element_at(F.array(*map(F.lit, ("ecli", "docket", "case_key", "note"))), (F.col("p_size") % 4 + 1).cast("int"))
    return part.groupBy("p_brand").agg(publication.identity_score(kind, F.col("p_size") % 10 == F.col("p_partkey") % 10, F.lit(False))).where("score is not null")
