"""Status ladders, publishability, state transitions and service levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS = 500

# Allowed publication transitions (from, to, by whom; None: by anyone). Anyone may also
# publish another version in the same state.
BULK = ("compatibility", "backfill")
TRANSITIONS = (
    (None, "draft", None),
    (None, "in_review", None),
    (None, "published", BULK),
    ("draft", "in_review", None),
    ("draft", "published", BULK),
    ("in_review", "draft", None),
    ("in_review", "published", None),
    ("in_review", "withdrawn", None),
    ("published", "withdrawn", None),
    ("withdrawn", "in_review", None),
    ("withdrawn", "published", ("human", *BULK)),
)

# What error codes and messages of crawl attempts say.
BLOCKED = "(?i)403|forbidden|access denied|blocked|bot protection"
TIMEOUT = "(?i)timeout|timed out|ETIMEDOUT|ERR_TIMED_OUT"
UNREADABLE = "(?i)PDF_EMPTY_BUFFER|PDF_TEXT_EXTRACTION_FAILED"

_yes = lambda c: F.coalesce(c, F.lit(False))


def source_text_at_hand(chars: Column, said: Column, strict: Column) -> Column:
    """Text is at hand where it is said to be, or is long enough; a strict source goes by what is said alone."""
    return _yes(said) | (~_yes(strict) & (F.coalesce(chars, F.lit(0)) >= MIN_CHARS))


def attempt_signals(attempts: Column) -> dict[str, Column]:
    """robots, blocked, timeout, unreadable: what any of an array of crawl attempts says
    (struct<status,blocked,timeout,errorCode,errorMessage>)."""
    said = lambda x: F.concat_ws(" ", x["errorCode"], x["errorMessage"])
    some = lambda test: _yes(F.exists(attempts, lambda x: _yes(test(x))))
    return {
        "robots": some(lambda x: said(x).rlike("(?i)ROBOTS_DISALLOW")),
        "blocked": some(lambda x: _yes(x["status"] == 403) | _yes(x["blocked"]) | said(x).rlike(BLOCKED)),
        "timeout": some(lambda x: _yes(x["timeout"]) | said(x).rlike(TIMEOUT)),
        "unreadable": some(lambda x: said(x).rlike(UNREADABLE)),
    }


def collection_status(*, robots: Column, blocked: Column, timeout: Column, unreadable: Column, review: Column, seed: Column, at_hand: Column, publishable: Column) -> Column:
    """Status of a collected item. What went wrong with crawling counts only where no source text is at
    hand; ``publishable`` is what was said before, and only false counts."""
    without = ~at_hand
    return (
        F.when(_yes(robots), "robots_disallowed")
        .when(without & _yes(blocked), "blocked")
        .when(without & _yes(timeout), "timeout")
        .when((without & _yes(unreadable)) | _yes(review), "needs_review")
        .when(_yes(seed) | without, "metadata_only")
        .when(_yes(publishable == False), "needs_review")  # noqa: E712
        .otherwise("cleaned")
    )


def publishable(status: Column, at_hand: Column, relevant: Column, seed: Column, robots: Column, said: Column, verified: Column) -> Column:
    """All conditions of publication; what was said before and the URL's verification count only if false."""
    return (status == "cleaned") & at_hand & _yes(relevant) & ~_yes(seed) & ~_yes(robots) & ~_yes(said == False) & ~_yes(verified == False)  # noqa: E712


def can_summarize(status: Column, text: Column, publishable_: Column, seed: Column, at_hand: Column, robots: Column) -> Column:
    """May be summarised (again): text enough, publishable, and not done or in work."""
    return _yes(status.isin("cleaned", "failed_summary")) & (F.length(F.trim(F.coalesce(text, F.lit("")))) >= MIN_CHARS) & _yes(publishable_) & ~_yes(seed) & _yes(at_hand) & ~_yes(robots)


def listed(status: Column, publishable_: Column) -> Column:
    return _yes(status == "summarized") & _yes(publishable_)


def transition_allowed(old: Column, new: Column, actor: Column, changed: Column) -> Column:
    """Whether a publication may go from old (null: none yet) to new; one rule that fits is enough."""
    fits = F.lit(False)
    for before, after, whom in TRANSITIONS:
        one = (old.isNull() if before is None else old == before) & (new == after)
        fits = fits | _yes(one if whom is None else one & actor.isin(*whom))
    return F.when(old == new, _yes(changed)).otherwise(fits)


def snapshot_ratios(df: DataFrame, by: list[str], counts: dict[str, Column], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    got = df.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in counts.items()))
    for name, (a, b) in ratios.items():
        got = got.withColumn(name, F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)))
    return got


def service_level(value: Column, warning: float, critical: float) -> Column:
    return F.when(value.isNull(), "unknown").when(value >= critical, "critical").when(value >= warning, "warning").otherwise("ok")


# Statuses that end an item's way.
DONE = ("published", "excluded", "duplicate", "withdrawn", "waived_failure")


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def work_needs(*, fetched: Column, normalized: Column, normalized_from: Column, verified: Column, published: Column, status: Column) -> dict[str, Column]:
    """Which of an item's artifacts are behind the one before: normalize, reverify, republish."""
    return {
        "normalize": fetched.isNotNull() & (normalized.isNull() | _differs(normalized_from, fetched)),
        "reverify": normalized.isNotNull() & _differs(normalized, verified),
        "republish": _yes(status == "published") & verified.isNotNull() & _differs(verified, published),
    }


def work_state(needs: dict[str, Column], *, attempt: Column, lease: Column, now: Column, status: Column, retry_phase: Column, next_attempt: Column) -> Column:
    """What an item of a backfill waits for."""
    waits = _yes(status == "retry_wait") | (retry_phase.isNotNull() & next_attempt.isNotNull())
    return F.when(attempt.isNotNull() & _yes(lease > now), "claimed").when(waits, "retry_wait").when(needs["normalize"], "needs_normalize").when(needs["reverify"], "needs_reverify").when(needs["republish"], "needs_republish").when(_yes(status.isin("terminal_failure", "waived_failure")), "failed").otherwise("idle")


def snapshot_status(items: DataFrame, snapshots: DataFrame, by: str) -> DataFrame:
    """Counts and ratios of each snapshot's items: by, discovered, terminal, completion, coverage, counts of
    work states, conformant, conformance.

    items: by, status, work, behind (any need), current (parser and policy are the snapshot's);
    snapshots: by, expected."""
    done = F.col("status").isin(*DONE)
    good = done & ~F.col("behind") & ((F.col("status") != "published") | _yes(F.col("current")))
    n = items.groupBy(by).agg(F.count("*").alias("discovered"), F.count_if(done).alias("terminal"), *(F.count_if(F.col("work") == w).alias(w) for w in ("claimed", "retry_wait", "needs_normalize", "needs_reverify", "needs_republish", "failed")), F.count_if(good).alias("conformant"))
    j = snapshots.join(n, by, "left").fillna(0, [c for c in n.columns if c != by])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return j.withColumns({"completion": F.coalesce(ratio("terminal", "discovered"), F.lit(0.0)), "coverage": ratio("discovered", "expected"), "conformance": F.coalesce(ratio("conformant", "terminal"), F.lit(0.0))})


def regression_guard(old: Column, new: Column) -> Column:
    """Keep the old text where the new one has under 60 % of its length."""
    return F.when(F.length(new) < 0.6 * F.length(old), old).otherwise(new)
