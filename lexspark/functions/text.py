"""Scalar text functions as column expressions; NFKC alone needs a UDF."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that only track, in any case.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "searchparams")


#: Characters that NFKC leaves as they are, whatever stands before or after them, if all of a text is of these.
LATIN, STABLE = "\\x00-\\x9f", "\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0400-\u0482\u2012-\u2015\u2018-\u201f\u2020-\u2022\u20ac\u3001-\u3003\u3008-\u3011\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fff\uac00-\ud7a3"
NORMALIZED_AT_A_TIME = 200


@F.arrow_udf(StringType())
def _nfkc(x: pa.Array) -> pa.Array:
    """As Python strings, a few texts are held at a time."""
    few = (x.slice(at, NORMALIZED_AT_A_TIME).to_pylist() for at in range(0, len(x), NORMALIZED_AT_A_TIME))
    parts = [pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in vs], pa.string()) for vs in few]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Only texts with a character that it may change go to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(f"[^{LATIN}](?<![{STABLE}])"), c)), c)


def collapse(c: Column) -> Column:
    """Control characters gone, white space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\\x00-\\x08\\x0E-\\x1F\\x7F]", ""), "\\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def clean(c: Column) -> Column:
    """Text cleaning: no-break spaces, runs of blanks, three or more newlines."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def alias_key(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(F.trim(c)), "\\s+", ""), "._-/#,;:()[]{}'\"", "")


def tag_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "^#+", ""), "\\s+", " "))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", "")


def content_hash(c: Column, n: int = 32) -> Column:
    """First n hex digits of the sha256 of the text with white space collapsed."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(c, "\\s+", " ")), 256), 1, n)


def dedup_keys(title: Column, date: Column, text: Column) -> tuple[Column, Column]:
    return F.substring(F.sha2(F.concat_ws("|", title, date), 256), 1, 16), F.substring(F.sha2(F.substring(text, 1, 1500), 256), 1, 16)


def once(c: Column, f) -> Column:
    """f(c), with c evaluated once however often f uses it (an alias that is used often may be written out in each place)."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no tracking parameters, and no slash at
    a path's end (one, and not the root's). Parameters that stay are not encoded anew."""
    pattern = "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)([^?]*)(?:\\?(.*))?$"

    def query(said):
        own = F.filter(F.split(said, "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
        return F.when(said == "", "").otherwise(once(F.array_join(own, "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))

    def made(head, bare):
        port = F.regexp_replace(head, "^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")
        path = once(F.regexp_extract(bare, pattern, 2), lambda p: F.when(p == "", "/").when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p))
        return F.concat(port, path, once(F.regexp_extract(bare, pattern, 3), query))

    bare = F.regexp_replace(F.trim(c), "#.*$", "")
    return once(bare, lambda b: once(F.lower(F.regexp_extract(b, pattern, 1)), lambda head: F.when(head != "", made(head, b)).otherwise(b)))


# What is taken out of search queries, and secrets that are taken out of logs.
QUERY_MARKS = (
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[email]"),
    (r"(?i)\b(?:https?:\/\/|www\.)\S+", "[url]"),
    (r"(?:\+?\d{1,3}[\s.-]?)?(?:0\d{1,2}|\(?\d{2,3}\)?)[\s.-]\d{3,4}[\s.-]\d{4}\b", "[number]"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f-]{27,}\b", "[identifier]"),
)
SECRET_MARKS = (
    (r"sk-(?:proj-)?[A-Za-z0-9_-]{8,}", "[redacted]"),
    (r"AIza[0-9A-Za-z_-]{20,}", "[redacted]"),
    (r"(?i)(Bearer\s+)[A-Za-z0-9._~+/-]{16,}", "$1[redacted]"),
    (r"(?i)([?&](?:secret|token|key|api_key)=)[^&\s]+", "$1[redacted]"),
    (r"(?i)((?:api[_-]?key|token|secret|password)\s*[:=]\s*)[^\s,;]+", "$1[redacted]"),
)


def redact_query(c: Column, most: int | None = 120) -> Column:
    """A search query as it is counted: lower case, single blanks, no addresses, URLs, numbers of people or
    identifiers, at most so many characters; null where nothing is left."""
    out = F.lower(F.regexp_replace(c, "\\s+", " "))
    for pattern, mark in QUERY_MARKS:
        out = F.regexp_replace(out, pattern, mark)
    out = F.nullif(F.trim(out), F.lit(""))
    return out if most is None else F.substring(out, 1, most)


def redact_secrets(c: Column) -> Column:
    """A log message without keys and passwords."""
    out = c
    for pattern, mark in SECRET_MARKS:
        out = F.regexp_replace(out, pattern, mark)
    return out


# What agents say of devices and browsers, tested in this order.
DEVICES = {"tablet": "(?i)ipad|tablet", "mobile": "(?i)mobile|iphone|ipod|android"}
CHROME, FIREFOX, SERVER = "(?i)chrome|crios", "(?i)firefox|fxios", "(?i)node|undici"


def device(agent: Column) -> Column:
    """tablet, mobile or desktop; null without an agent."""
    return F.coalesce(*(F.when(agent.rlike(p), name) for name, p in DEVICES.items()), F.when(agent != "", "desktop"))


def agent_family(agent: Column) -> Column:
    """The browser's family, Server or Other; null without an agent."""
    says = lambda p: agent.rlike(p)
    families = {"Edge": says("(?i)edg/"), "Chrome": says(CHROME), "Firefox": says(FIREFOX), "Safari": says("(?i)safari") & ~says("(?i)android"), "Server": says(SERVER), "Other": agent != ""}
    return F.coalesce(*(F.when(test, name) for name, test in families.items()))


# What the agents of machines that read pages say of themselves.
BOT_MARKERS = ("bot", "crawler", "spider", "preview", "facebookexternalhit", "slurp", "bingpreview", "duckduckbot", "ahrefs", "semrush")


def is_bot(agent: Column) -> Column:
    """Whether an agent says that it is a machine; false without an agent."""
    return F.coalesce(F.lower(agent).rlike("|".join(BOT_MARKERS)), F.lit(False))


def client_hash(address: Column, day: Column, salt: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(salt), day.cast("string"), address), 256)


# Months as German, French and Spanish pages write them.
MONTHS = {
    "janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "août": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12,
    "januar": 1, "februar": 2, "marz": 3, "märz": 3, "april": 4, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12,
}
SPANISH_MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}


def _month(names: dict[str, int], name: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), name)


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_timestamp(text, F.lit("y-M-d"))).cast("date")


def parse_date(c: Column) -> Column:
    """ISO, dd.MM.yyyy, German and French long dates, M/d/yy(yy), 'MMMM d, yyyy' and bare years; null
    where none fits."""
    return once(F.regexp_replace(F.trim(c), "\\s+", " "), _parsed)


def _parsed(c: Column) -> Column:
    one = lambda fmt: F.try_to_timestamp(c, F.lit(fmt))
    shaped = lambda pattern, fmt: F.when(c.rlike(pattern), one(fmt))
    written = "^(\\d{1,2})(?:er|\\.)?\\s+([a-zäöüéûôîïçàèù]+)\\s+(\\d{4})$"
    long = lambda i: F.regexp_extract(F.lower(c), written, i)
    localized = F.when(F.lower(c).rlike(written), once(_month(MONTHS, long(2)), lambda m: _day(long(3), m, long(1))))
    return F.coalesce(
        shaped("^\\d{4}-\\d{2}-\\d{2}$", "yyyy-MM-dd"),
        F.when(c.rlike("^\\d{4}-\\d{2}-\\d{2}T"), F.try_to_timestamp(c)),
        shaped("^\\d{1,2}\\.\\d{1,2}\\.\\d{4}$", "d.M.yyyy"),
        localized.cast("timestamp"),
        shaped("^\\d{1,2}/\\d{1,2}/\\d{4}$", "M/d/yyyy"),
        shaped("^\\d{1,2}/\\d{1,2}/\\d{2}$", "M/d/yy"),
        shaped("^[A-Za-z]+ \\d{1,2}, \\d{4}$", "MMMM d, yyyy"),
        shaped("^\\d{4}$", "yyyy"),
    ).cast("date")


def parse_spanish_date(c: Column, year: Column | None = None) -> Column:
    """A date within a Spanish title (de 3 de marzo de 2021), the year given where the title has none."""
    written = "(?:^|\\b)de\\s+(\\d{1,2})\\s+de\\s+([a-z]+)(?:\\s+de\\s+(\\d{4}))?"
    said = F.regexp_extract(F.translate(F.lower(F.regexp_replace(c, "\\s+", " ")), "áéíóúüñ", "aeiouun"), written, 0)

    def dated(said):
        part = lambda i: F.regexp_extract(said, written, i)
        when = F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), year if year is not None else F.lit(None).cast("int"))
        day = lambda y: once(_month(SPANISH_MONTHS, part(2)), lambda m: F.when(y >= 1900, _day(y, m, part(1))))
        return F.when(said != "", once(when, day))

    return once(said, dated)


def embedding_text(summary: Column) -> Column:
    """What is embedded of a summary (see rules.SUMMARY): title, core, background, implications, tags and
    entities by type, a line each."""
    said = F.transform(summary["entities"], lambda e: F.concat(e["type"], F.lit(": "), e["normalizedName"]))
    return F.array_join(F.concat(F.array(summary["koreanTitle"]), summary["summary"]["coreSummary"], F.array(summary["summary"]["background"], summary["summary"]["implications"]), summary["tags"], said), "\n")


def article_slug(jurisdiction: Column, source: Column, day: Column, title: Column, url: Column) -> Column:
    """A readable and unique part of a URL: place, source, day, title (80 characters) and the URL's hash."""
    filled = lambda c: F.when(c != "", c)
    short = F.substring(slugify(title), 1, 80)
    return F.concat_ws("-", filled(slugify(jurisdiction)), filled(slugify(source)), F.date_format(day, "yyyy-MM-dd"), filled(short), F.substring(F.sha2(F.trim(url), 256), 1, 6))


def kst_day(ts: Column) -> Column:
    """Calendar day in Seoul of a UTC timestamp without zone."""
    return F.date_format(ts + F.expr("interval 9 hours"), "yyyy-MM-dd")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    dot = F.aggregate(F.filter(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    d = norm(a) * norm(b)
    return F.when(d == 0, 0.0).otherwise(dot / d)


def l2_normalize(v: Column, width: int) -> Column:
    """Unit vector; raises on a wrong width or a zero norm."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    bad = (F.size(v) != width) | (n == 0) | F.isnan(n)
    return F.when(bad, F.raise_error(F.lit("vector of wrong width or without direction")).cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def parse_vector(c: Column) -> Column:
    return F.filter(F.from_json(c, "array<double>"), lambda x: x.isNotNull() & ~F.isnan(x))
