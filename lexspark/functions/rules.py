"""Rules over single values: tag aliases, error classes, retry delays, summary checks, terminology."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of one tag, the canonical one first.
ALIAS_GROUPS = (
    ("평등원칙", "평등 원칙", "Equal Protection", "Gleichheitssatz"),
    ("선거비용", "선거 비용", "Comptes de campagne"),
    ("피선거권 박탈", "피선거권박탈", "Ineligibilite", "Inéligibilité"),
    ("위헌결정", "위헌 결정", "Unconstitutionality"),
    ("선거무효", "선거 무효", "선거무효소송", "Election annulment"),
    ("헌법위원회", "프랑스 헌법위원회", "Conseil constitutionnel", "Constitutional Council"),
    ("독일 연방헌법재판소", "독일헌법재판소", "Bundesverfassungsgericht"),
    ("미국 연방대법원", "미국 연방 대법원", "미국 대법원", "미 연방대법원", "미 대법원", "연방대법원", "Supreme Court of the United States", "SCOTUS"),
    ("우선적 위헌심사절차", "우선적 위헌심사", "QPC", "Question prioritaire de constitutionnalite"),
    ("연방헌법재판소법", "BVerfGG", "Bundesverfassungsgerichtsgesetz"),
    ("독일 기본법", "Grundgesetz"),
    ("표현의 자유", "Free Speech", "Freedom of expression", "Meinungsfreiheit"),
    ("재판청구권", "Access to court", "Right of access to court"),
    ("적법절차", "Due Process"),
    ("가처분", "Interim measures", "Einstweilige Anordnung"),
    ("각하", "Inadmissibility", "Irrecevabilite", "Irrecevabilité"),
    ("불수리", "Non-admission", "Nichtannahme"),
    ("보충성 원칙", "Subsidiarity", "Subsidiaritat", "Subsidiarität"),
    ("정치자금", "Political finance"),
    ("재산권", "Property right", "Property"),
)
# Tag names that are written otherwise.
TAG_NAMES = {"free speech": "Free Speech", "freedom of expression": "Freedom of Expression", "first amendment": "First Amendment", "표현의자유": "표현의 자유"}
# Words that make a decision relevant.
KEYWORDS = ("constitution", "constitutional", "first amendment", "second amendment", "fourth amendment", "fifth amendment", "sixth amendment", "eighth amendment", "fourteenth amendment", "due process", "equal protection", "free speech", "religion clause", "establishment clause", "free exercise", "separation of powers", "federalism", "commerce clause", "takings clause", "sovereign immunity", "standing", "executive power", "congressional power")
# What messages of failed summaries say, in the order in which they are tested.
KEY_MISSING = ("api key", "key is required", "key is not configured", "key missing", "no gemini api key", "no llm completion available")
QUOTA = ("quota", "429", "rate limit", "rate_limit", "too many requests", "high demand")
SUMMARY_QUOTA = ("quota", "429", "high demand")
SUMMARY_KEY_MISSING = ("api key", "key missing", "no gemini routes are locally available")
ERROR_OF_STATUS = {"robots_disallowed": "crawl.robots_disallowed", "timeout": "crawl.timeout_response", "blocked": "crawl.blocked_403", "metadata_only": "extract.empty_text", "failed_summary": "summary.model_error"}
ROUTE = r'(?:Gemini route |"route"\s*:\s*")([^/"\s]+)/key-\d+'
# How messages say when to try again.
RETRY = r"(?i)retry\s+(?:after|in)\s+([0-9.]+)\s*(ms|s|seconds?)"
# Days to look back, least and most, by source; others have OTHER_DAYS at most.
MOST_DAYS = {"es-tribunal-constitucional": 730, "de-bverfg": 90}
OTHER_DAYS, SLACK_DAYS = 30, 2
# Hours to wait by kind of error and attempts so far (from the last line that fits).
WAIT_HOURS = {"variants-404": ((0, 12), (3, 24), (6, 48), (10, 72)), "empty": ((0, 3), (3, 12), (6, 24)), "blocked": ((0, 6), (3, 24), (6, 72))}
# Names of courts and how they are written, by source.
TERMS = {
    "fr-conseil-constitutionnel": ("프랑스 헌법위원회", (r"Conseil constitutionnel", r"French Constitutional Council", r"프랑스\s*헌법\s*이사회", r"헌법\s*이사회", r"프랑스\s*헌법\s*재판소", r"프랑스\s*헌법\s*위원회")),
    "us-scotus": ("미국 연방대법원", (r"Supreme Court of the United States", r"\bSCOTUS\b", r"미국\s*연방\s*대법원", r"미\s*연방\s*대법원", r"미국\s*대법원", r"미\s*대법원", r"(?<!미국\s)(?<!미국)(?<!미\s)(?<!미)(?<!독일\s)(?<!독일)연방\s*대법원")),
}


# -- tags


def tag_key(c: Column) -> Column:
    """A tag without case, white space, dashes and marks (NFKC is the caller's, where it matters)."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[#'’`´·.,:;()\\[\\]{}]", ""), "[\\s\\-_]+", "")


def _plain_key(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch not in "#'’`´·.,:;()[]{}-_" and not ch.isspace())


def canonical_tag(c: Column) -> Column:
    """The canonical name of a tag's group, or the tag itself, trimmed. The groups are a constant map."""
    names = F.create_map(*(F.lit(x) for k, v in {_plain_key(n): g[0] for g in ALIAS_GROUPS for n in g}.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(names, tag_key(c)), F.trim(c))


def expanded_tags(tags: Column) -> Column:
    """Tags, their canonical names, and all names of their groups, each once."""
    groups = F.create_map(*(x for g in ALIAS_GROUPS for x in (F.lit(g[0]), F.array(*map(F.lit, g)))))
    each = F.transform(tags, lambda t: F.concat(F.array(t, canonical_tag(t)), F.coalesce(F.try_element_at(groups, canonical_tag(t)), F.array().cast("array<string>"))))
    return F.filter(F.array_distinct(F.flatten(each)), lambda x: x != "")


def tag_name(c: Column) -> Column:
    """A tag as it is stored: no marks before it, single blanks, and a few names written otherwise."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "^#+", ""), "\\s+", " ")
    return F.coalesce(*(F.when(F.lower(bare) == k, v) for k, v in TAG_NAMES.items()), bare)


# -- dates and ranges


def recent(day: Column, today: Column, most: int = 15) -> Column:
    """Whether a decision's day lies at most so many days before today (a day in Seoul), and not after."""
    return F.coalesce(F.datediff(today, day).between(0, most), F.lit(False))


def in_collection_range(source: Column, published: Column, revised: Column, start: Column, revision_start: Column) -> Column:
    """Whether a found item is in the range asked for; one court's revisions have a range of their own."""
    inside = lambda d, s: F.coalesce(d >= s, F.lit(False))
    own = (source == "us-scotus") & revision_start.isNotNull()
    return (start.isNotNull() & inside(published, start)) | F.when(own, inside(revised, revision_start)).otherwise(start.isNull())


def range_days(source: Column, floor: Column, verified: Column, succeeded: Column, now: Column) -> Column:
    """Days to look back from a checkpoint (last verified publication, else last good run): since then and
    some slack, no fewer than the floor, no more than the source's most."""
    most = F.coalesce(*(F.when(source == k, F.greatest(F.lit(v), floor) if k == "de-bverfg" else F.lit(v)) for k, v in MOST_DAYS.items()), F.greatest(floor, F.lit(OTHER_DAYS)))
    least = F.least(F.greatest(floor, F.lit(1)), most)
    days = F.greatest(F.ceil((F.unix_timestamp(now) - F.unix_timestamp(F.coalesce(verified, succeeded))) / 86400.0), F.lit(1))
    known = F.coalesce(verified, succeeded).isNotNull()  # greatest and least pass over nulls
    return F.when(known, F.least(F.greatest(least, days + SLACK_DAYS), most)).otherwise(least).cast("int")


# -- errors and retries


def _says(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def summary_error(message: Column, retryable: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(F.coalesce(retryable, F.lit(False)) | _says(m, SUMMARY_QUOTA), "summary.retryable_quota").when(_says(m, SUMMARY_KEY_MISSING), "llm.key_missing").otherwise("summary.model_error")


def llm_error(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(_says(m, KEY_MISSING), "llm.key_missing").when(_says(m, QUOTA), "summary.retryable_quota").otherwise("summary.model_error")


def error_of_status(status: Column) -> Column:
    return F.coalesce(*(F.when(status == k, v) for k, v in ERROR_OF_STATUS.items()))


def provider(model: Column, said: Column) -> Column:
    """Who serves a model: as said, or by its name."""
    return F.coalesce(said, F.when(model.rlike("(?i)^claude-"), "anthropic").when(model.rlike("(?i)^gpt-|^o\\d|^chatgpt-"), "openai").when(model.contains("gemini"), "gemini").otherwise("unknown"))


def failed_models(requested: Column, message: Column) -> Column:
    """The model asked for, or all whose routes a message names, each once."""
    asked = F.when(F.trim(requested) != "", F.trim(requested))
    named = F.array_distinct(F.regexp_extract_all(F.coalesce(message, F.lit("")), F.lit(ROUTE), F.lit(1)))
    return F.when(asked.isNotNull(), F.array(asked)).otherwise(named)


def candidate_error(code: Column) -> Column:
    c = F.coalesce(code, F.lit(""))
    blocked = c.isin("BVERFG_OFFICIAL_DETAIL_UNVERIFIED", "BVERFG_SITE_BLOCK_CIRCUIT_OPEN")
    return F.when(c == "BVERFG_OFFICIAL_VARIANTS_404", "variants-404").when(c == "BVERFG_OFFICIAL_DETAIL_404", "single-404").when(c.rlike("(?i)403|blocked"), "blocked").when(c == "CRAWLEE_DETAIL_EMPTY", "empty").when(blocked, "blocked").otherwise("none")


def candidate_wait(attempts: Column, code: Column) -> Column:
    """Hours until a candidate is tried again."""
    kind = candidate_error(code)
    ladders = []
    for k, steps in WAIT_HOURS.items():
        wait = F.lit(steps[0][1])
        for least, hours in steps[1:]:
            wait = F.when(attempts >= least, hours).otherwise(wait)
        ladders.append(F.when(kind == k, wait))
    return F.coalesce(*ladders, F.lit(0))


def summary_wait(message: Column, retry: Column, base_ms: int, most_ms: int) -> Column:
    """Milliseconds until a summary is tried again: the longest wait that the message asks for and two
    seconds, or the base doubled for each retry, whichever is longer, at most ``most_ms``."""
    m = F.coalesce(message, F.lit(""))
    said = F.zip_with(F.regexp_extract_all(m, F.lit(RETRY), F.lit(1)), F.regexp_extract_all(m, F.lit(RETRY), F.lit(2)), lambda v, u: v.try_cast("double") * F.when(F.lower(u) == "ms", 1.0).otherwise(1000.0))
    asked = F.array_max(F.filter(said, lambda x: x > 0)) + 2000
    doubled = float(min(most_ms, max(1000, base_ms))) * F.pow(F.lit(2.0), F.greatest(retry, F.lit(0)))
    return F.least(F.lit(float(most_ms)), F.greatest(F.coalesce(asked, F.lit(0.0)), doubled))


# -- texts


def keyword_score(*fields: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", *(F.when(f != "", f) for f in fields)))
    return sum((F.when(hay.contains(k), 1).otherwise(0) for k in KEYWORDS), F.lit(0))


def terminology(text: Column, source: Column) -> Column:
    """A source's court under its canonical name."""
    out = text
    for key, (name, patterns) in TERMS.items():
        fixed = text
        for p in patterns:
            fixed = F.regexp_replace(fixed, p, name)
        out = F.when(source == key, fixed).otherwise(out)
    return out


SUMMARY = "struct<koreanTitle:string,summary:struct<coreSummary:array<string>,background:string,implications:string>,tags:array<string>,entities:array<struct<name:string,type:string,normalizedName:string>>>"


def valid_summary(json_text: Column) -> Column:
    """A summary's JSON as a struct, or null where it is no JSON or lacks a part of the right kind.

    Kinds are told by the parts' own JSON: texts are quoted, lists bracketed."""
    part = lambda path: F.try_variant_get(F.try_parse_json(json_text), f"$.{path}", "variant")
    kind = lambda path: F.schema_of_variant(part(path))
    texts = lambda path: kind(path).isin("ARRAY<STRING>", "ARRAY<VOID>")
    ok = (kind("koreanTitle") == "STRING") & texts("summary.coreSummary") & (kind("summary.background") == "STRING") & (kind("summary.implications") == "STRING") & texts("tags") & kind("entities").startswith("ARRAY<")
    got = F.from_json(json_text, SUMMARY)
    each = F.forall(got["entities"], lambda e: e["type"].isNotNull() & e["normalizedName"].isNotNull())
    return F.when(F.coalesce(ok & each, F.lit(False)), got)


@F.pandas_udf(StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """JSON with keys in order and no blanks; null where it is none. Numbers are written as Python does."""

    def one(v):
        try:
            return None if v is None else json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return x.map(one)


def covered_keys(terms: DataFrame) -> DataFrame:
    """key: alias keys of all that glossary terms (slug, term, korean, related) cover."""
    names = F.concat(F.array("slug", "term", "korean"), expanded_tags(F.coalesce("related", F.array().cast("array<string>"))))
    return terms.select(F.explode(names).alias("n")).where("n is not null").select(tag_key(F.col("n")).alias("key")).distinct()
