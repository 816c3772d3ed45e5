"""Sources of court decisions: what each finds, takes and makes of crawled pages.

A source is three steps over DataFrames of crawled pages (page_id, url, html), so all pages of a
run go through one plan: ``discover`` gives the decisions that list pages link, ``fetch`` joins
them with what the crawler has, and ``normalize`` makes article rows of that.  What differs between courts is
said as data: where list pages have their links, which URLs are decisions, and how dates and case numbers are
written (``Grammar``)."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import cases, text
from lexspark.sources import markup, web


@dataclass(frozen=True)
class Number:
    """A way to write a case number: a pattern, and what is made of its groups (``{1}`` and so on; ``{1:int}``
    without leading zeros, ``{1:title}`` with a capital)."""

    pattern: str
    form: str = "{1}"


@dataclass(frozen=True)
class Grammar:
    decision: str  # pattern of a decision's path
    numbers: tuple[Number, ...] = ()  # tried in order on title, then on URL
    dates: tuple[str, ...] = ()  # patterns of dates in what stands near a link, as text.parse_date reads them
    url_date: str | None = None  # pattern of year, month and day in a URL
    row: dict[str, int] = field(default_factory=dict)  # list pages that are tables: the cells of link, date and number
    spanish: bool = False  # dates are within titles, their year being that of the number


def _number(c: Column, n: Number) -> Column:
    """The number that a text holds, null if none."""
    out, form = [], n.form
    while form:
        plain, _, rest = form.partition("{")
        if plain:
            out.append(F.lit(plain))
        if not rest:
            break
        said, _, form = rest.partition("}")
        group, _, how = said.partition(":")
        x = F.regexp_extract(c, n.pattern, int(group))
        out.append(F.regexp_replace(x, "^0+(?=\\d)", "") if how == "int" else F.concat(F.upper(F.substring(x, 1, 1)), F.lower(x.substr(F.lit(2), F.char_length(x)))) if how == "title" else F.regexp_replace(x, "\\s+", " "))
    return F.when(c.rlike(n.pattern), F.concat(*out))


class _Cells(markup.Parser):
    """Rows of tables: texts of cells, and links as (cell, href, text, title)."""

    def __init__(self):
        super().__init__()
        self.rows, self.cells, self.links, self.inside, self.link = [], [], [], False, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self.end()
        elif tag == "td":
            self.cells.append("")
            self.inside = True
        elif tag == "a" and a.get("href") and self.cells:
            self.link = {"cell": len(self.cells) - 1, "href": a["href"].strip(), "text": "", "title": a.get("title") or ""}
            self.links.append(self.link)

    def handle_endtag(self, tag):
        if tag == "td":
            self.inside = False
        elif tag == "a":
            self.link = None
        elif tag in ("tr", "table"):
            self.end()

    def end(self):
        if self.cells:
            tidy = lambda s: " ".join(s.split())
            self.rows.append(([tidy(c) for c in self.cells], [x | {"text": tidy(x["text"])} for x in self.links]))
        self.cells, self.links, self.inside, self.link = [], [], False, None

    def handle_data(self, data):
        if self.inside and self.cells:
            self.cells[-1] += data
        if self.link is not None:
            self.link["text"] += data


def table_links(pages: DataFrame) -> DataFrame:
    """page_id, place, cells, cell, href, anchor, title: the links of the rows of tables (page_id, url, html)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for page, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                p = _Cells()
                p.feed(html or "")
                p.close()
                p.end()
                for cells, links in p.rows:
                    for x in links:
                        try:
                            rows.append((page, len(rows), cells, x["cell"], markup.joined(url or "", x["href"]), x["text"], x["title"]))
                        except ValueError:  # not a URL
                            continue
            yield pd.DataFrame(rows, columns=["page_id", "place", "cells", "cell", "href", "anchor", "title"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, place long, cells array<string>, cell int, href string, anchor string, title string")


@dataclass(frozen=True)
class Source:
    key: str
    jurisdiction: str
    language: str
    host: str  # pattern of its URLs
    grammar: Grammar
    selectors: list[str] = field(default_factory=list)

    def _dated(self, near: Column, url: Column) -> Column:
        g = self.grammar
        said = [text.parse_date(F.regexp_extract(near, p, 0)) for p in g.dates]
        if g.spanish:
            year = F.regexp_extract(near, r"\b\d+/(\d{4})\b", 1).try_cast("int")
            said.append(text.parse_spanish_date(near, year))
        if g.url_date:
            part = lambda i: F.regexp_extract(url, g.url_date, i)
            said.append(F.try_to_date(F.when(url.rlike(g.url_date), F.concat_ws("-", part(1), part(2), part(3))), "yyyy-MM-dd"))
        return F.coalesce(*said) if said else F.lit(None).cast("date")

    def numbered(self, *texts: Column) -> Column:
        found = [_number(t, n) for t in texts for n in self.grammar.numbers]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def is_decision(self, url: Column) -> Column:
        path = F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z]+://[^/?#]*", ""), "[?#].*$", "")
        return url.rlike(self.host) & path.rlike(self.grammar.decision)

    def discover(self, pages: DataFrame) -> DataFrame:
        """source_key, url, title, number, published: the decisions that the source's list pages link, each once."""
        own, row = pages.where(F.col("url").rlike(self.host)), self.grammar.row
        if row:
            cell = lambda n: F.get("cells", F.lit(row[n])) if n in row else F.lit(None).cast("string")
            found = table_links(own).where((F.size("cells") > max(row.values())) & (F.col("cell") == row["link"]))
            got = found.select("page_id", "place", F.col("href").alias("said"), "anchor", cell("date").alias("near"), cell("number").alias("said_number"))
        else:
            found = web.links(own, selectors=self.selectors)
            got = found.select("page_id", F.lit(0).cast("long").alias("place"), F.col("href").alias("said"), "anchor", F.col("near"), F.lit(None).cast("string").alias("said_number"))
        got = got.select("*", F.explode(F.filter(F.array(text.canonical_url(F.col("said"))), self.is_decision)).alias("url"))
        number = F.coalesce(F.nullif(F.col("said_number"), F.lit("")), self.numbered(F.col("anchor"), F.col("near"), F.col("url")))
        got = got.withColumns({"number": number, "published": self._dated(F.col("near"), F.col("url"))})
        first = F.min_by(F.struct("anchor", "number", "published"), F.struct("page_id", "place")).alias("r")
        return got.groupBy("url").agg(first).select(F.lit(self.key).alias("source_key"), "url", F.nullif(F.col("r.anchor"), F.lit("")).alias("title"), "r.number", "r.published")

    def fetch(self, items: DataFrame, crawled: DataFrame) -> DataFrame:
        """The items with the page that the crawler has of them; missing ones have no page."""
        own = crawled.select(text.canonical_url(F.col("url")).alias("url"), "page_id", "html")
        return items.join(own, "url", "left").withColumn("fetched", F.col("page_id").isNotNull())

    def normalize(self, fetched: DataFrame) -> DataFrame:
        """source_key, url, jurisdiction, language, title, text, published, case_number, case_key, content_hash."""
        have = fetched.where("fetched")
        body = web.readable(have).drop("found").withColumnRenamed("title", "page_title")
        said = web.metadata(have).withColumnRenamed("title", "said_title").withColumnRenamed("published", "said_published")
        j = have.drop("html").join(body, "page_id").join(said, "page_id")
        title = F.coalesce("said_title", F.nullif(F.col("page_title"), F.lit("")), "title")
        number = F.coalesce("decision_number", "case_number", "number", self.numbered(title, F.col("url")))
        published = F.coalesce("said_published", F.col("published").cast(have_type(said, "said_published")))
        cleaned = text.clean(F.col("text"))
        return j.select("source_key", "url", F.lit(self.jurisdiction).alias("jurisdiction"), F.lit(self.language).alias("language"), title.alias("title"), cleaned.alias("text"), published.alias("published"), number.alias("case_number"), cases.case_key(F.col("source_key"), number, title, F.col("url")).alias("case_key"), text.content_hash(cleaned).alias("content_hash"))


def have_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


# The four sources, the URLs of their decisions, and how they write dates and case numbers.
SOURCES = {
    s.key: s
    for s in (
        Source(
            "de-bverfg", "Germany", "de", r"^https?://(?:www\.)?(?:bundesverfassungsgericht|bverfg)\.de/",
            Grammar(
                decision=r"(?i)/SharedDocs/Entscheidungen/(?:DE|EN)/20\d{2}/\d{2}/[a-z]{2}\d{8}_[a-z0-9]+\.html$",
                numbers=(Number(r"\b([12]\s+Bv[A-Za-z]+\s+\d+/\d{2,4})\b"), Number(r"(?i)[_./]([12])bv([a-z]+?)(\d{4})(\d{2})(?:\.html)?\b", "{1} Bv{2:title} {3:int}/{4}")),
                dates=(r"\b\d{1,2}\.\d{1,2}\.\d{4}\b",), url_date=r"(?i)/[a-z]{2}(20\d{2})(\d{2})(\d{2})_[a-z0-9]+",
            ),
        ),
        Source(
            "us-scotus", "United States", "en", r"^https?://(?:www\.)?supremecourt\.gov/",
            Grammar(decision=r"(?i)^/opinions/.+\.pdf$", dates=(r"^\d{1,2}/\d{1,2}/\d{2,4}$",), row={"date": 1, "number": 2, "link": 3}),
        ),
        Source(
            "fr-conseil-constitutionnel", "France", "fr", r"^https?://(?:(?:www|qpc360)\.)?conseil-constitutionnel\.fr/",
            Grammar(
                decision=r"(?i)^/decision/20\d{2}/[^/]+\.html?$|^/20\d{2}-\d{2}-\d{2}/decision-",
                numbers=(Number(r"(?i)\bn[°o]\s*(\d{4}-\d+)\s*(QPC|DC|AN|SEN)\b", "{1} {2}"), Number(r"(?i)\bn[°o]\s*(\d{4}-\d+)\b"), Number(r"(?i)/decision/20\d{2}/(\d{4})(\d+)(QPC|DC|AN|SEN)\.", "{1}-{2:int} {3}")),
                dates=(r"(?i)\b\d{1,2}\s+[a-zéûôîïçàèù]+\s+\d{4}\b",), url_date=r"/(20\d{2})-(\d{2})-(\d{2})/decision-",
            ),
        ),
        Source(
            "es-tribunal-constitucional", "Spain", "es", r"^https?://(?:hj\.|www\.)?tribunalconstitucional\.es/",
            Grammar(decision=r"(?i)/Resolucion/Show/0*[1-9]\d*$", numbers=(Number(r"(?i)\b(?:SENTENCIA|AUTO|DECLARACI[OÓ]N|STC|ATC|DTC)\s+(\d+/\d{4})\b"),), spanish=True),
        ),
    )
}


def discover_all(pages: DataFrame) -> DataFrame:
    """The decisions that any source's list pages link."""
    out = None
    for s in SOURCES.values():
        one = s.discover(pages)
        out = one if out is None else out.unionByName(one)
    return out
