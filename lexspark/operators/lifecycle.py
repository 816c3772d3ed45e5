"""Lifecycle states, projection documents, readiness of blobs, rank gates and canaries, as columns and small jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.operators import analytics

# Statuses, decisions, codes and contracts that results must carry or compare with.
STATUSES = ("discovered", "metadata_only", "robots_disallowed", "blocked", "timeout", "fetched", "cleaned", "summarizing", "summarized", "failed_fetch", "failed_summary", "needs_review")
WITHOUT_TEXT = ("discovered", "metadata_only", "robots_disallowed", "blocked", "timeout", "failed_fetch")
WITH_TEXT = ("cleaned", "summarizing", "summarized", "failed_summary")
DECISIONS = ("closed_private", "published", "approved", "approved_for_summary", "needs_review")
ERROR_CLASS = r"^[a-z][a-z0-9._-]{0,119}$"
ERROR_OF_STATUS = {"metadata_only": "collection.metadata_only", "robots_disallowed": "crawl.robots_disallowed", "blocked": "crawl.blocked", "timeout": "crawl.timeout", "failed_fetch": "crawl.fetch_failed", "failed_summary": "summary.failed"}
NOT_RETRYABLE = ("crawl.robots_disallowed", "llm.key_missing")
LOW_SEVERITY = ("crawl.robots_disallowed", "collection.metadata_only")
PROCESSING_ERROR = r"^(summary|llm|job)\."
SECRET_KEY = r"(secret|password|authorization|api[_-]?key|access[_-]?token|refresh[_-]?token|private[_-]?key|cookie)"
BLOB_CONTRACT, BLOB_BYTES, BLOB_FOLDER = "raw-text-blob-v1", 4 * 1024 * 1024, "artifacts/article_raw/"

_yes = lambda c: F.coalesce(c, F.lit(False))


# -- lifecycle


def review_decision(current: Column, state: Column, history: Column) -> Column:
    """The decision that counts: the current one, the review state, or the last of the history that is one."""
    known = lambda c: F.when(c.isin(*DECISIONS), c)
    earlier = F.element_at(F.filter(history, lambda d: _yes(d.isin(*DECISIONS))), -1)
    pending = F.when(state.isin("needs_triage", "retry_later"), state)
    return F.coalesce(known(current), pending, known(state), F.when(F.size(F.filter(history, lambda d: _yes(d.isin(*DECISIONS)))) > 0, earlier), state)


def review_state(decision: Column, status: Column) -> Column:
    pending = decision.isin("needs_review", "needs_triage", "retry_later")
    return F.when(decision == "closed_private", "closed_private").when(decision.isin("published", "approved"), "approved").when(decision == "approved_for_summary", "approved_for_processing").when(_yes(pending) | (status == "needs_review"), "needs_review").otherwise("unreviewed")


def lifecycle(*, status: Column, text: Column, text_signal: Column, publishable: Column, decision: Column, summary: Column, error: Column, retryable: Column, expected: Column) -> Column:
    """States of an article from what older records say: a struct with an anomaly code, or with
    collection, processing and review state and what to do about attention.

    text: whether source text is at hand (null: not said, or not as true or false); text_signal:
    whether anything is said of it; expected: no text is to be had, and none is missed."""
    review = review_state(decision, status)
    conflicts = {
        "backfill.unknown_legacy_status": ~_yes(status.isin(*STATUSES)),
        "backfill.invalid_source_text_signal": _yes(text_signal) & text.isNull(),
        "backfill.status_text_conflict": (status.isin(*WITHOUT_TEXT) & _yes(text)) | (status.isin(*WITH_TEXT) & _yes(~text)),
        "backfill.summarized_without_summary": (status == "summarized") & ~summary,
        "backfill.needs_review_text_ambiguous": (status == "needs_review") & text.isNull(),
        "backfill.review_summary_text_conflict": (status == "needs_review") & _yes(~text) & summary,
        "backfill.approval_publishable_conflict": _yes(decision.isin("published", "approved")) & ~_yes(publishable),
        "backfill.invalid_error_class": F.coalesce(error != "", F.lit(False)) & ~_yes(error.rlike(ERROR_CLASS)),
    }
    anomaly = F.coalesce(*(F.when(test, code) for code, test in conflicts.items()))
    collection = F.when(status == "discovered", "discovered").when(status.isin(*WITHOUT_TEXT), "metadata_only").when(status == "fetched", "source_fetched").when((status == "needs_review") & ~_yes(text), "metadata_only").otherwise("source_text_ready")
    ready = (collection == "source_text_ready") & (status == "needs_review")
    processing = F.when(status.isin("cleaned", "failed_summary"), "ready").when(status == "summarizing", "running").when((status == "summarized") | ((status == "needs_review") & summary), "complete").when(ready, "ready").otherwise("not_ready")
    code = F.when(~_yes(expected), F.coalesce(error, *(F.when(status == s, e) for s, e in ERROR_OF_STATUS.items())))
    late = _yes(code.rlike(PROCESSING_ERROR))
    severity = F.when(code.isin(*LOW_SEVERITY), "low").when(late, "high").otherwise("medium")
    fine = anomaly.isNull()
    when = lambda c, also=F.lit(True): F.when(fine & also, c)
    return F.struct(
        anomaly.alias("anomaly"),
        when(collection).alias("collection"),
        when(processing).alias("processing"),
        F.when(fine | (review != "unreviewed"), review).alias("review"),
        when(F.when(_yes(expected), "clear").when(code.isNotNull(), "raise").otherwise("keep")).alias("attention"),
        when(code).alias("code"),
        when(F.coalesce(retryable, ~code.isin(*NOT_RETRYABLE)), code.isNotNull()).alias("retryable"),
        when(severity, code.isNotNull()).alias("severity"),
        when(F.when(late, "processing").otherwise("collection"), code.isNotNull()).alias("source"),
    )


def has_secret_key(json: Column) -> Column:
    """Whether any object within a JSON text, however deep, has a key that looks like a secret's.

    Strings are taken one after another, so a string within a value is no key."""
    strings = F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(r'"(?:[^"\\]|\\.)*"\s*:?'), F.lit(0))
    return F.exists(strings, lambda s: s.endswith(":") & F.lower(s).rlike(SECRET_KEY))


# -- versions and projections


def version_id(article: Column, digest: Column) -> Column:
    """A version's identifier: a UUID's shape from the digest of the article and its content's digest."""
    h = F.sha2(F.concat(article, F.lit(":"), digest).cast("binary"), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def first_filled(*values: Column) -> Column:
    """The first value that is not blank, trimmed, or the empty text."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in values), F.lit(""))


def joined_filled(values: list[Column], by: str = "\n") -> Column:
    """All values that are not blank, trimmed and joined."""
    return F.array_join(F.filter(F.transform(F.array(*values), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), by)


def latest_time(*times: Column) -> Column:
    return F.greatest(*times)


def checksum(fields: dict[str, Column], version: int = 1) -> Column:
    """Digest of a document's fields as JSON with keys in order."""
    body = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(f"search-document/v{version}\n"), body).cast("binary"), 256)


def manifest(documents: DataFrame, key: str, digest: str) -> DataFrame:
    """Number of documents and a digest of all of them in any order: one row."""
    pair = F.xxhash64(F.col(key), F.col(digest)).cast("decimal(38,0)")
    return documents.agg(F.count("*").alias("documents"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(pair), F.lit(0)).cast("string")).cast("binary"), 256).alias("digest"))


# -- comparison of result sets


def compare(primary: DataFrame, shadow: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: counts, whether the sets are equal, and the path of the first difference, ``[place].column``
    in the order of the key (or ``[place]`` where one set has ended). Keys must be unique."""
    names = sorted([key, *columns])
    a, b = (x.select(F.col(key).alias("k"), F.struct(*names).alias(side)) for x, side in ((primary, "a"), (shadow, "b")))
    j = a.join(b, "k", "full")
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    facts = j.agg(F.count("a").alias("primary_count"), F.count("b").alias("shadow_count"), F.min(F.when(differ, F.col("k"))).alias("at"))
    # what stands at the first difference in either set: its own row, or the next one
    at = F.col("k") >= F.col("at")
    rows = j.crossJoin(F.broadcast(facts))  # one row
    found = rows.agg(
        F.max("primary_count").alias("primary_count"),
        F.max("shadow_count").alias("shadow_count"),
        F.max("at").alias("at"),
        F.count_if(F.col("k") < F.col("at")).alias("place"),
        F.min_by("a", F.when(at & F.col("a").isNotNull(), F.col("k"))).alias("a"),
        F.min_by("b", F.when(at & F.col("b").isNotNull(), F.col("k"))).alias("b"),
    )
    field = F.coalesce(*(F.when(~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")), n) for n in names))
    path = F.concat(F.lit("["), F.col("place"), F.lit("]"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.concat(F.lit("."), field)).otherwise(""))
    return found.select("primary_count", "shadow_count", F.col("at").isNull().alias("matched"), F.when(F.col("at").isNotNull(), path).alias("diff_path"))


# -- retention, blobs, artifacts


def due(domains: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows of each domain that a retention plan would take: domain, due."""
    parts = [df.agg(F.count_if(test).alias("due")).select(F.lit(name).alias("domain"), "due") for name, (df, test) in domains.items()]
    return reduce(DataFrame.unionByName, parts)


def blob(text: Column, source: Column) -> Column:
    """A text as a blob's JSON document: struct<document,sha256,bytes,ref,too_large>."""
    listed = F.to_json(F.array(text))
    document = listed.substr(F.lit(2), F.char_length(listed) - 2)
    digest, size = F.sha2(document.cast("binary"), 256), F.octet_length(document)
    ref = F.concat(F.lit(BLOB_FOLDER), source, F.lit("/"), digest, F.lit(".json"))
    return F.when(text.isNotNull(), F.struct(document.alias("document"), digest.alias("sha256"), size.alias("bytes"), ref.alias("ref"), (size > BLOB_BYTES).alias("too_large")))


def put_blobs(blobs: DataFrame, path: str) -> None:
    """Append the documents (ref, document, too_large) whose content the folder doesn't have yet, each
    content once; one that is too large stops the job."""
    spark = blobs.sparkSession
    fit = blobs.select("ref", F.when(F.col("too_large"), F.raise_error(F.lit("blob too large"))).otherwise(F.col("document")).alias("document")).groupBy("ref").agg(F.min("document").alias("document"))
    try:
        fit = fit.join(spark.read.parquet(path).select("ref"), "ref", "left_anti")
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    fit.write.mode("append").parquet(path)


def blob_readiness(rows: DataFrame, ledger: DataFrame, key: str, contract: str = BLOB_CONTRACT) -> DataFrame:
    """Thirteen counts of inline and external copies of texts: one row. contract: the name that blobs carry.

    rows: key, source, text, ref, hash, size, at, contract; ledger: key, ref, hash, size, contract."""
    meta = [F.col(c) for c in ("ref", "hash", "size", "at", "contract")]
    covered = ledger.select(key, *(F.col(c).alias(f"l_{c}") for c in ("ref", "hash", "size", "contract")))
    same = reduce(lambda a, b: a & b, ((F.col(c) == F.col(f"l_{c}")) if c != "size" else F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in ("ref", "hash", "size", "contract")))
    exact = rows.join(covered, key).where(same).select(key).distinct().withColumn("in_ledger", F.lit(True))
    inline, absent = F.col("text").isNotNull(), reduce(lambda a, b: a & b, (c.isNull() for c in meta))
    complete = _yes((F.col("contract") == contract) & F.col("hash").rlike("^[0-9a-f]{64}$") & F.col("size").between(0, BLOB_BYTES) & F.col("at").isNotNull() & (F.col("ref") == F.concat(F.lit(BLOB_FOLDER), F.col("source"), F.lit("/"), F.col("hash"), F.lit(".json"))))
    known = _yes(F.col("in_ledger"))
    got = rows.join(exact, key, "left").select(inline.alias("i"), absent.alias("a"), complete.alias("c"), known.alias("k"), F.octet_length(blob(F.col("text"), F.lit(""))["document"]).alias("b"))
    i, a, c, k = (F.col(x) for x in "iack")
    counts = {"inline_present": i, "inline_missing": ~i, "metadata_absent": a, "metadata_complete": c, "metadata_inconsistent": ~a & ~c, "dual_copy": i & c, "blob_only": ~i & c, "inline_only": i & a, "exact_ledger_covered": k, "ledger_missing_or_conflicting": c & ~k, "clearable_rows": i & c & k}
    return got.agg(F.count("*").alias("total_rows"), *(F.count_if(test).alias(n) for n, test in counts.items()), F.coalesce(F.sum("b"), F.lit(0)).alias("inline_blob_bytes_estimated"))


def artifact_class(*, ref: Column, contract: Column, inline: Column, at: Column, kind: Column, replay: Column, size: Column, supported: str) -> Column:
    """Where an artifact's content is and what is wrong with it, as a struct of flags."""
    given = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    out, said, here, dated = given(ref), given(contract), _yes(inline), _yes(at)
    torn = (out & (~said | ~dated)) | (~out & (said | dated))
    needs = _yes(kind == "normalization") | _yes(replay == "bounded_evidence")
    bars = _yes(kind == "fetch") & _yes(replay.isin("full_snapshot", "non_replayable"))
    unexpected = bars & (here | out)
    return F.struct(
        out.alias("externalized"),
        (here & out).alias("dual_copy"),
        (~here & out).alias("blob_only"),
        (here & ~out).alias("inline_only"),
        (out & here & dated & _yes(contract == supported)).alias("clearable"),
        (torn | (needs & ~here & ~out) | unexpected).alias("metadata_inconsistent"),
        (out & said & ~_yes(contract == supported)).alias("contract_mismatch"),
        F.when(here & (size >= 0) & ~unexpected & ~torn, size).alias("recorded_size"),
    )


# -- duplicates, tags


def known_already(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """key, reason, of: new items that the archive has, by content hash, else by title (a blank one is none) and date
    and, where both have one, case number. Both: key, hash, title, date, case_number."""
    s = stored.select(F.col(key).alias("of"), *(F.col(c).alias(f"s_{c}") for c in ("hash", "title", "date", "case_number")))
    by_hash = new.join(s, F.col("hash") == F.col("s_hash")).groupBy(key).agg(F.min("of").alias("hash_of"))
    same_case = F.col("case_number").isNull() | F.col("s_case_number").isNull() | (F.col("case_number") == F.col("s_case_number"))
    by_title = new.where(F.trim("title") != "").join(s, (F.col("title") == F.col("s_title")) & (F.col("date") == F.col("s_date")) & same_case).groupBy(key).agg(F.min("of").alias("title_of"))
    got = by_hash.join(by_title, key, "full")
    return got.select(key, F.when(F.col("hash_of").isNotNull(), "content_hash").otherwise("title_date").alias("reason"), F.coalesce("hash_of", "title_of").alias("of"))


def summary_tags(entities: Column, tags: Column, slug) -> Column:
    """Tags of a summary: its entities and then its topics, the first of each slug."""
    named = F.transform(entities, lambda e: F.struct(e["name"].alias("name"), slug(F.coalesce(F.when(F.trim(e["normalized"]) != "", e["normalized"]), e["name"])).alias("slug"), e["type"].alias("type")))
    topics = F.transform(tags, lambda t: F.struct(t.alias("name"), slug(t).alias("slug"), F.lit("topic").alias("type")))
    every = F.concat(F.coalesce(named, F.array().cast("array<struct<name:string,slug:string,type:string>>")), F.coalesce(topics, F.array().cast("array<struct<name:string,slug:string,type:string>>")))
    slugs = F.transform(every, lambda x: x["slug"])
    return F.filter(every, lambda x, i: F.array_position(slugs, x["slug"]) == i + 1)


# -- rank gates and canaries


def policy_status(*, informational: Column, expected: Column, frozen: Column, validated: Column, observed: Column, oracle: Column) -> Column:
    """Status of a rank case: its first observed id, and the oracle's where there is one, must be expected."""
    top = lambda ids: F.get(ids, 0)
    inside = lambda ids: _yes(F.array_contains(expected, top(ids)))
    passed = inside(observed) & (top(oracle).isNull() | inside(oracle))
    return F.when(informational, "informational").when(F.size(F.coalesce(expected, F.array().cast("array<string>"))) == 0, "not_applicable").when(_yes(frozen) & ~_yes(validated), "fail").when(passed, "pass").otherwise("fail")


def meets(values: dict[str, Column], least: dict[str, float | None]) -> Column:
    """Whether no stated threshold is missed."""
    return reduce(lambda a, b: a & b, (values[k] >= v for k, v in least.items() if v is not None), F.lit(True))


def rank_gate(cases: DataFrame, by: str, metrics: dict[str, str], least: dict[str, float | None]) -> DataFrame:
    """by, cases, strict, failed, the means of metrics over compared cases, and ok: no strict case failed, and no
    stated threshold is missed. cases: by, status (see ``policy_status``) and the columns of ``metrics`` (name: column)."""
    strict = F.col("status").isin("pass", "fail")
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name) for name, c in metrics.items()]
    out = cases.groupBy(by).agg(F.count("*").alias("cases"), F.count_if(strict).alias("strict"), F.count_if(F.col("status") == "fail").alias("failed"), *means)
    return out.withColumn("ok", (F.col("failed") == 0) & meets({name: F.col(name) for name in metrics}, least))


def canary_ok(*, kind: Column, ids: Column, expected: Column, within: Column, score: Column, least: Column) -> Column:
    """Whether a page of ids is as a canary expects: exact-order, top-id, contains or self-top."""
    first = F.get(ids, 0) == F.get(expected, 0)
    order = F.slice(ids, F.lit(1), F.size(expected)) == expected
    held = F.array_contains(F.slice(ids, F.lit(1), F.greatest(within, F.lit(0))), F.get(expected, 0))
    return _yes(F.when(kind == "exact-order", order).when(kind == "top-id", first).when(kind == "contains", held).when(kind == "self-top", first & (score >= least)))


def oracle_parity(mode: Column, observed: Column, oracle: Column, strict: Column) -> Column:
    """match, mismatch, informational or absent: lexical pages must begin alike, others hold the oracle's first."""
    alike = F.get(observed, 0) == F.get(oracle, 0)
    held = F.array_contains(observed, F.get(oracle, 0))
    lexical = F.when(alike, "match").when(strict, "mismatch").otherwise("informational")
    return F.when(F.size(oracle) == 0, "absent").when(F.size(observed) == 0, "mismatch").when(mode == "fulltext", lexical).when(held, "match").otherwise("mismatch")


def canary_summary(cases: DataFrame, latency: str, least_passed: float = 1.0) -> DataFrame:
    """mode, cases, compared, passed, p50, p95 (nearest rank over compared ones) and pass, a row per mode.
    cases: mode, status (pass, mismatch, error, timeout, skipped), latency."""
    seen = F.col("status").isin("pass", "mismatch")
    out = cases.groupBy("mode").agg(F.count("*").alias("cases"), F.count_if(seen).alias("compared"), F.count_if(F.col("status") == "pass").alias("passed"))
    kind = cases.schema[latency].dataType
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        at = analytics.percentiles(cases.where(seen), latency, ["mode"], p).select(F.col("mode").alias("m"), F.col("nearest").cast(kind).alias(name))
        out = out.join(at, F.col("mode").eqNullSafe(F.col("m")), "left").drop("m")
    return out.withColumn("ok", (F.col("compared") > 0) & (F.col("passed") >= least_passed * F.col("cases")))


def pinned(snapshots: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first snapshot of each key: replays and late duplicates don't change what was pinned. On a
    stream, with a watermark, the same is ``dropDuplicatesWithinWatermark(key)``."""
    cols = snapshots.columns
    return snapshots.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select("r.*")

