"""Case numbers of the four courts: keys per source, and references in queries and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sources, the case numbers of each, and names under which a decision is known.
PATTERNS = {
    "de-bverfg": r"\b([12])\s+Bv([A-Za-z]+)\s+([0-9]+)\s*/\s*([0-9]{2,4})\b",
    "fr-conseil-constitutionnel": r"\b([0-9]{4}-[0-9]+(?:[/_-][0-9]+)*(?:\s+(?:QPC|DC|AN|SEN))?)\b",
    "es-tribunal-constitucional": r"\b([0-9]{1,4})\s*/\s*([0-9]{4})\b",
    "us-scotus": r"\b(?:No\.\s*)?([0-9]{2,3})\s*-\s*([0-9]+)\b",
}
GERMAN_FILE = r"([12])bv([a-z]+)([0-9]{4})([0-9]{2})(?:\.html)?"
NICKNAMES = (r"\b(?:neubauer|klimabeschluss)\b", "de-bverfg", "1 BvR 2656/18")


def case_key(source: Column, number: Column, title: Column | None = None, url: Column | None = None) -> Column:
    """Key of the first case number of a source's grammar in a number, title or URL: lower-case letters
    and digits without leading zeros, German years of two digits; null where there is none."""
    value = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (number, title, url) if c is not None))
    got = lambda k, i: F.regexp_extract(value, "(?i)" + PATTERNS[k], i)
    file = lambda i: F.regexp_extract(F.lower(value), GERMAN_FILE, i)
    whole = lambda c: c.try_cast("decimal(38,0)").cast("string")
    de, fr, es, us = PATTERNS
    year = F.when(F.length(got(de, 4)) == 4, F.right(got(de, 4), F.lit(2))).otherwise(F.lpad(got(de, 4), 2, "0"))
    german = F.when(value.rlike("(?i)" + PATTERNS[de]), F.lower(F.concat(got(de, 1), F.lit("bv"), got(de, 2), whole(got(de, 3)), year)))
    german = F.coalesce(german, F.when(F.lower(value).rlike(GERMAN_FILE), F.concat(file(1), F.lit("bv"), file(2), whole(file(3)), file(4))))
    has = lambda k: (source == k) & value.rlike("(?i)" + PATTERNS[k])
    return (
        F.when(source == de, german)
        .when(has(fr), F.regexp_replace(F.lower(got(fr, 1)), "[^a-z0-9]", ""))
        .when(has(es), F.concat(whole(got(es, 1)), got(es, 2)))
        .when(has(us), F.concat(whole(got(us, 1)), whole(got(us, 2))))
    )


def references(text: Column) -> Column:
    """All case numbers of a text, by source and place: array<struct<source,number,key>>, each key once."""

    def of(source, numbers):
        return F.transform(numbers, lambda x: F.struct(F.lit(source).alias("source"), x.alias("number"), case_key(F.lit(source), x).alias("key")))

    pattern, source, number = NICKNAMES
    found = {s: of(s, F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0))) for s, p in PATTERNS.items()}
    nick = F.when(text.rlike("(?i)" + pattern), of(source, F.array(F.lit(number)))).otherwise(F.filter(of(source, F.array(F.lit(number))), lambda x: F.lit(False)))
    every = F.concat(found["de-bverfg"], nick, *(x for s, x in found.items() if s != "de-bverfg"))
    numbered = F.transform(every, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    # the first of each source and key
    first = F.filter(numbered, lambda a: ~F.exists(numbered, lambda b: (b["i"] < a["i"]) & (b["x"]["source"] == a["x"]["source"]) & (b["x"]["key"] == a["x"]["key"])))
    return F.transform(first, lambda a: a["x"])


def key_of(source: str, number: str) -> str:
    """case_key of one number that a source's grammar fits, for queries."""
    g = re.search("(?i)" + PATTERNS[source], number).groups()
    if source == "de-bverfg":
        return f"{g[0]}bv{g[1]}{int(g[2])}{g[3][-2:] if len(g[3]) == 4 else g[3].rjust(2, '0')[:2]}".lower()
    if source == "fr-conseil-constitutionnel":
        return re.sub("[^a-z0-9]", "", g[0].lower())
    return f"{int(g[0])}{g[1]}" if source == "es-tribunal-constitucional" else f"{int(g[0])}{int(g[1])}"


def exact_case(query: str) -> tuple[str, str, str] | None:
    """(source, number, key) of the case that a query names: a known name first, then the first grammar
    that fits."""
    pattern, source, number = NICKNAMES
    if re.search("(?i)" + pattern, query):
        return source, number, key_of(source, number)
    for source, pattern in PATTERNS.items():
        found = re.search("(?i)" + pattern, query)
        if found:
            return source, found.group(0), key_of(source, found.group(0))
    return None
