"""Readers of crawled pages: links, feeds, sitemaps, robots rules and readable text.

Parsing is per page and needs the standard library's parser; pages come and go in Arrow
batches, and everything after the parse is columns."""

from __future__ import annotations

import re
from functools import partial, reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.sources import markup

SKIPPED = {"script", "style", "noscript", "template", "nav", "header", "footer", "aside", "form"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br", "section", "article", "blockquote", "pre", "table", "ul", "ol"}
MIN_TEXT = 200
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


#: Elements that end an open one of their kind (and what is open in it), as their end tags may be left out.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Where the text of official pages is if nothing stands out, tried in this order.
PLACES = ("main", "article", "#pagemaindiv", ".field--name-body", ".content")
#: Words of class and id that speak for and against an element as the place of the text.
FOR = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
AGAINST = re.compile(r"banner|combx|comment|footer|menu|meta|nav|promo|related|share|sidebar|sponsor|teaser|widget|(?:^|[\s_-])ads?(?:[\s_-]|$)", re.I)
LEAST_CHARS, SIBLING, HINT = 25, 0.2, 25
READ_AT_A_TIME = 200


class _Page(HTMLParser):
    """A page's blocks of text, each with its place in the tree of elements.

    nodes: (parent, tag, hint for or against, places of PLACES); blocks: (node, text, characters in links).
    Words end at any white space, or at ``blanks`` only; blocks don't begin or end with ``edges``."""

    def __init__(self, blanks: str | None = None, edges: str = ""):
        super().__init__(convert_charrefs=True)
        self.edges = edges
        self.words = str.split if blanks is None else re.compile(f"[^{re.escape(blanks)}]+").findall
        self.nodes, self.blocks, self.title, self.in_title = [(-1, "", 0, frozenset())], [], [], False
        self.open, self.skipped, self.linked = [0], 0, 0
        self.text, self.link_chars = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in BLOCKS:
            self._cut()
        if tag == "br" or tag in VOID:
            return
        ends = CLOSES.get(tag)
        if ends:
            self._close(ends, stop={"table", "ul", "ol", "dl"})
        if tag in SKIPPED:
            self.skipped += 1
        if tag == "a":
            self.linked += 1
        a = dict(attrs)
        names = f"{a.get('class') or ''} {a.get('id') or ''}"
        hint = HINT * bool(FOR.search(names)) - HINT * bool(AGAINST.search(names))
        own = {tag, f"#{a.get('id')}", *(f".{c}" for c in (a.get("class") or "").split())}
        self.nodes.append((self.open[-1], tag, hint, frozenset(p for p in PLACES if p in own)))
        self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in BLOCKS:
            self._cut()
        if any(self.nodes[n][1] == tag for n in self.open[1:]):
            self._close({tag}, stop=set())

    def _close(self, tags, stop):
        """Close the innermost open element of the tags, and all within it, unless a stop is met before."""
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.nodes[self.open[k]][1] in tags | stop), 0)
        if at and self.nodes[self.open[at]][1] in tags:
            self._cut()
            for n in self.open[at:]:
                self.skipped -= self.nodes[n][1] in SKIPPED
                self.linked -= self.nodes[n][1] == "a"
            del self.open[at:]

    def _cut(self):
        text = " ".join(self.words("".join(self.text))).strip(self.edges)
        if text:
            owner = next((n for n in reversed(self.open) if self.nodes[n][1] in BLOCKS), 0)
            self.blocks.append((owner, text, min(self.link_chars, len(text))))
        self.text, self.link_chars = [], 0

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skipped:
            self.text.append(data)
            if self.linked:
                self.link_chars += len("".join(self.words(data)))

    def above(self, node):
        """The node and what it lies in, from the inside out."""
        while node >= 0:
            yield node
            node = self.nodes[node][0]


def _main_blocks(page: _Page, least: int = LEAST_CHARS) -> list[str]:
    """The blocks of the element that most of the running text is in, and of its siblings that are like it.

    A block of some length is worth 1, its commas, and its length in hundreds up to 3. The element
    around it gets that, the one above a half, those above a third and so on of it; class and id speak for or against. An
    element's worth falls by the share of its characters that are links."""
    parent = [n[0] for n in page.nodes]
    inner = {parent[n] for n, x in enumerate(page.nodes) if x[1] in BLOCKS}
    worth, chars, links = {}, [0] * len(parent), [0] * len(parent)
    for owner, text, linked in page.blocks:
        for n in page.above(owner):
            chars[n] += len(text)
            links[n] += linked
        if len(text) >= least:
            points = 1 + text.count(",") + min(len(text) // 100, 3)
            around = page.above(owner if owner in inner else parent[owner])  # an element of text alone is a paragraph
            for k, n in enumerate(around):
                worth[n] = worth.get(n, 0) + points / (1 if k == 0 else 2 if k == 1 else 3 * k)
    if not worth:
        return []
    final = {n: (w + page.nodes[n][2]) * (1 - links[n] / chars[n]) for n, w in worth.items()}
    best = max(final, key=lambda n: (final[n], -n))
    like = max(10, SIBLING * final[best])
    kept = {best} | {n for n, w in final.items() if parent[n] == parent[best] and w >= like}
    kept |= {n for n, x in enumerate(page.nodes) if parent[n] == parent[best] and x[1] == "p" and chars[n] > 80 and links[n] < 0.25 * chars[n]}

    def belongs(node):
        """Whether a kept element is met on the way up, before any that class or id speak against."""
        for n in page.above(node):
            if n in kept or page.nodes[n][2] < 0:
                return n in kept
        return False

    return [text for owner, text, linked in page.blocks if 2 * linked <= len(text) and belongs(owner)]


def _readable(page: _Page, least: tuple[int, ...] = (LEAST_CHARS,)) -> tuple[str, str]:
    """The text, and how it was found: scored, one of PLACES, or body."""
    for n in least:
        text = "\n".join(_main_blocks(page, n))
        if len(text) > MIN_TEXT:
            return text, "scored"
    for place in PLACES:
        text = "\n".join(t for owner, t, _ in page.blocks if any(place in page.nodes[n][3] for n in page.above(owner)))
        if len(text) > MIN_TEXT:
            return text, place
    return "\n".join(t for _, t, _ in page.blocks), "body"


def _tidy(parts) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def _parse(html: str, blanks: str | None = None, edges: str = "") -> _Page:
    p = _Page(blanks, edges)
    p.feed(html or "")
    p.close()
    p._cut()
    return p


def _read_page(html: str, whole: str = "", blanks: str | None = None, edges: str = "", least: tuple[int, ...] = (LEAST_CHARS,)) -> tuple[str, str, str]:
    page = _parse(html, blanks, edges)
    text, found = _readable(page, least)
    if found == "body" and whole:
        text = "\n".join(t for _, t, _ in _parse(whole, blanks, edges).blocks)
    return _tidy(page.title), text, found


def _read_pages(batches, **how):
    """key, title, text, found of pages; the elements of one page and the texts of READ_AT_A_TIME are held."""
    for pdf in batches:
        for at in range(0, len(pdf), READ_AT_A_TIME):
            own = pdf.iloc[at : at + READ_AT_A_TIME]
            titles, texts, found = zip(*(_read_page(*x, **how) for x in zip(*(own[c] for c in ("html", "whole") if c in own))))
            yield pd.DataFrame({"key": own["key"], "title": titles, "text": texts, "found": found})


def readable(pages: DataFrame, key: str = "page_id", html: str = "html", whole: str | None = None, blanks: str | None = None, edges: str = "", least: tuple[int, ...] = (LEAST_CHARS,)) -> DataFrame:
    """key, title, text, found: the element that holds the running text, by the lengths, commas and links of
    its blocks; if that has no more than 200 characters, the first of PLACES with more, or else the body.

    least: how long a block must be to count; a further length is tried if the one before finds no text.
    blanks: the characters that count as white space in the text (none given: all that Unicode has);
    edges: further ones that a block neither begins nor ends with.
    whole: a column of the HTML that is the body, where ``html`` is a part of the page (empty: it is the page)."""
    kind = pages.schema[key].dataType.simpleString()
    held = "string" if kind == "bigint" else kind  # pandas makes floats of long numbers beside nulls
    given = pages.select(F.col(key).cast(held).alias("key"), F.col(html).alias("html"), *([] if whole is None else [F.col(whole).alias("whole")]))
    got = given.mapInPandas(partial(_read_pages, blanks=blanks, edges=edges, least=least), f"key {held}, title string, text string, found string")
    return got.select(F.col("key").cast(kind).alias(key), "title", "text", "found")


class _Tree(markup.Parser):
    """Open elements as a stack of [tag, classes, id, text, links]; links with what selects them."""

    def __init__(self, selectors: list[list[tuple]]):
        super().__init__()
        self.selectors, self.stack, self.links = selectors, [["", set(), None, [], []]], []
        self.meta, self.times, self.headings = {}, [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault(a.get("property") or a.get("name") or "", a.get("content", ""))
        if tag in VOID:
            return
        self.stack.append([tag, set(a.get("class", "").split()), a.get("id"), [], []])
        if tag == "a" and a.get("href"):
            place = [k for k, chain in enumerate(self.selectors) if self._fits(chain)]
            if place or not self.selectors:
                self.links.append({"order": place[0] if place else 0, "href": a["href"], "title": a.get("title") or a.get("aria-label") or "", "text": "", "near": ""})
                self.stack[-2][4].append(self.links[-1])
                self.stack[-1].append(self.links[-1])
        if tag == "time":
            self.times.append([a.get("datetime", ""), ""])
        if tag == "h1":
            self.headings.append([" ".join(a.get("class", "").split()), ""])

    def _fits(self, chain) -> bool:
        """Whether the elements that are open hold the chain, in order, the innermost in or above the link."""
        at = len(chain) - 1
        for tag, classes, name, *_ in reversed(self.stack):
            want_tag, want_classes, want_id = chain[at]
            if (not want_tag or want_tag == tag) and want_classes <= classes and (want_id is None or want_id == name):
                at -= 1
                if at < 0:
                    return True
        return False

    def handle_endtag(self, tag):
        if self.stack[-1][0] != tag and not any(e[0] == tag for e in self.stack[1:]):
            return
        while True:
            done = self.stack.pop()
            text = "".join(done[3])
            for link in done[4]:
                link["near"] = " ".join(text.split())
            if len(done) > 5:
                done[5]["text"] = " ".join(text.split())
            if done[0] == "time":
                self.times[-1][1] = " ".join(text.split())
            if done[0] == "h1":
                self.headings[-1][1] = " ".join(text.split())
            if done[0] not in ("script", "style"):
                self.stack[-1][3].append(text)
            if done[0] == tag:
                return

    def handle_data(self, data):
        self.stack[-1][3].append(data)


def _selector(text: str) -> list[tuple]:
    """A descendant selector of tags, classes and ids: ``ul.list li a``."""
    return [((re.match(r"[\w-]*", x).group(0) or None), set(re.findall(r"\.([\w-]+)", x)), next(iter(re.findall(r"#([\w-]+)", x)), None)) for x in text.split()]


def _tree(html: str, selectors: list[list[tuple]]) -> _Tree:
    p = _Tree(selectors)
    p.feed(html or "")
    p.close()
    while len(p.stack) > 1:
        p.handle_endtag(p.stack[-1][0])
    return p


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", selectors: list[str] | None = None) -> DataFrame:
    """key, href (absolute), anchor, near: a row per distinct link of a page, in order of the selectors and
    of the page; the anchor is the link's text, or else its title or label; near is its parent's text."""

    chains = [_selector(x) for x in selectors or []]

    def run(batches):
        for pdf in batches:
            rows = []
            for k, u, h in zip(pdf["key"], pdf["url"], pdf["html"]):
                seen = {}
                for x in sorted(_tree(h, chains).links, key=lambda x: x["order"]):
                    if not x["href"].startswith(("#", "javascript:", "mailto:")):
                        seen.setdefault(markup.joined(u or "", x["href"]).split("#")[0], (x["text"] or x["title"].strip(), x["near"]))
                rows += [(k, a, *b) for a, b in seen.items()]
            yield pd.DataFrame(rows, columns=["key", "href", "anchor", "near"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, href string, anchor string, near string").withColumnRenamed("key", key)


# How pages write dates, decisions, cases and panels.
DAY = r"\b\d{1,2}\.\d{1,2}\.\d{4}\b"
LONG_DAY = r"(?iu)\b\d{1,2}(?:er|\.)?\s+(?:janvier|fevrier|février|mars|avril|mai|juin|juillet|aout|août|septembre|octobre|novembre|decembre|décembre|januar|februar|marz|märz|april|juni|juli|august|september|oktober|dezember)\s+\d{4}\b"
DECISION = r"(?iu)\b(?:Décision|Decision)\s+n[°o]\s*[0-9]{4}-[0-9]+\s*(?:QPC|DC|AN|SEN)?\b"
CASE = r"(?iu)\b(?:Az\.?|Case|Docket|Aktenzeichen)\s*[:：]?\s*[-A-Za-z0-9./ ]{3,40}\b"
SENATE, CHAMBER = r"(?i)\b(?:Erster|Zweiter)\s+Senat\b", r"(?i)\b\d+\.\s+Kammer\b"


def metadata(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, description, published, decision_number, case_number, senate: what a page says of a
    decision. The parser gives headings, properties, times and text; the rest is columns."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, h in zip(pdf["key"], pdf["html"]):
                t = _tree(h, [])
                shown = [x for c, x in t.headings if x and "title" in c.split()] or [x for c, x in t.headings if x and not re.search("search|visually-hidden|sr-only", c, re.I)]
                rows.append((k, shown[0] if shown else None, t.meta.get("og:title") or None, _tidy(_parse(h).title) or None, t.meta.get("description") or t.meta.get("og:description") or None, next((a or b for a, b in t.times if a or b), None), " ".join("".join(t.stack[0][3]).split())))
            yield pd.DataFrame(rows, columns=["key", "shown", "og", "page", "description", "time", "text"])

    kind = pages.schema[key].dataType.simpleString()
    raw = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key {kind}, shown string, og string, page string, description string, time string, text string")
    said = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 0), F.lit(""))
    title = F.coalesce("shown", "og", "page")
    dated = F.concat_ws(" ", title, "og", "page", "text")
    return raw.select(F.col("key").alias(key), title.alias("title"), F.trim("description").alias("description"), F.coalesce("time", said(dated, DAY), said(dated, LONG_DAY)).alias("published"), said(F.col("text"), DECISION).alias("decision_number"), said(F.col("text"), CASE).alias("case_number"), F.coalesce(said(F.col("text"), SENATE), said(F.col("text"), CHAMBER)).alias("senate"))


def sitemap_urls(xml: Column) -> Column:
    return F.expr("xpath({0}, '//*[local-name()=\"loc\"]/text()')".format(_name(xml)))


def sitemap_walk(start: DataFrame, fetched: DataFrame, words: list[str], depth: int = 2, nested: int = 20, most: int = 200) -> DataFrame:
    """url of the pages that sitemaps name: those of a sitemap that names others are read in its place (the
    first 20 of each, two levels deep), and URLs that hold none of the words (if any) are left out.

    start: url of sitemaps; fetched: url, xml of what the crawler has. One join for each level."""
    level, out = start.select("url").distinct(), None
    for k in range(depth + 1):
        locs = level.join(fetched, "url").select(F.col("url").alias("map"), F.posexplode(sitemap_urls(F.col("xml"))).alias("at", "loc")).select("map", "at", F.trim("loc").alias("loc"))
        inner = F.col("loc").endswith(".xml")
        index = locs.where(inner).select("map").distinct()
        pages = locs.where(~inner) if k == depth else locs.join(index, "map", "left_anti")
        pages = pages.select("loc") if k < depth else locs.select("loc")
        out = pages if out is None else out.unionByName(pages)
        if k < depth:
            first = locs.where(inner).withColumn("n", F.row_number().over(Window.partitionBy("map").orderBy("at")))
            level = first.where(F.col("n") <= nested).select(F.col("loc").alias("url")).distinct()
    hit = reduce(or_, (F.lower("loc").contains(w.lower()) for w in words), F.lit(not words))
    return out.where(hit).select(F.col("loc").alias("url")).distinct().orderBy("url").limit(most)


def feed_links(xml: Column) -> Column:
    """Links of RSS items and Atom entries."""
    return F.expr("concat(xpath({0}, '//item/link/text()'), xpath({0}, '//*[local-name()=\"entry\"]/*[local-name()=\"link\"]/@href'))".format(_name(xml)))


def json_feed_links(feed: Column) -> Column:
    """Links of a JSON feed: array<struct<url,title,published>> of the objects in its list, or in the lists
    of its object; those without a URL are left out."""
    item = "array<struct<url:string,link:string,href:string,title:string,name:string,date:string,publishedAt:string,pubDate:string>>"
    listed = F.when(F.trim(feed).startswith("["), F.from_json(feed, item))
    held = F.flatten(F.transform(F.filter(F.map_values(F.from_json(feed, "map<string,string>")), lambda v: F.trim(v).startswith("[")), lambda v: F.from_json(v, item)))
    items = F.coalesce(listed, held, F.array().cast(item))
    made = F.transform(items, lambda i: F.struct(F.coalesce(i["url"], i["link"], i["href"]).alias("url"), F.trim(F.coalesce(i["title"], i["name"], F.lit(""))).alias("title"), F.coalesce(i["date"], i["publishedAt"], i["pubDate"]).alias("published")))
    return F.filter(made, lambda i: F.coalesce(i["url"] != "", F.lit(False)))


def _name(c: Column) -> str:
    return c._jc.toString() if hasattr(c, "_jc") else str(c)


def robots_rules(text: str, agent: str = "*") -> list[tuple[bool, str]]:
    """(allowed, path prefix) rules of the group of an agent, else of *."""
    groups: dict[str, list] = {}
    names, in_rules = [], False
    for line in text.splitlines():
        k, _, v = (x.strip() for x in line.split("#")[0].partition(":"))
        k = k.lower()
        if k == "user-agent":
            names = [v.lower()] if in_rules or not names else [*names, v.lower()]
            in_rules = False
            for n in names:
                groups.setdefault(n, [])
        elif k in ("allow", "disallow") and names:
            in_rules = True
            if v:
                for n in names:
                    groups[n].append((k == "allow", v))
    return groups.get(agent.lower(), groups.get("*", []))


def crawl_delay(text: str, agent: str = "*") -> float | None:
    """Seconds between requests that the group of an agent, else of *, asks for."""
    groups: dict[str, float] = {}
    names, in_rules = [], False
    for line in text.splitlines():
        k, _, v = (x.strip() for x in line.split("#")[0].partition(":"))
        k = k.lower()
        if k == "user-agent":
            names = [v.lower()] if in_rules or not names else [*names, v.lower()]
            in_rules = False
        elif k:
            in_rules = True
            if k == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", v):
                for n in names:
                    groups.setdefault(n, float(v))
    return groups.get(agent.lower(), groups.get("*"))


def robots_allowed(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The longest matching rule decides, allow before disallow; none allows."""
    out = F.lit(True)
    for allow, prefix in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        pattern = "^" + ".*".join(re.escape(x) for x in prefix.rstrip("$").split("*")) + ("$" if prefix.endswith("$") else "")
        out = F.when(path.rlike(pattern), F.lit(allow)).otherwise(out)
    return out


def ndjson(spark, path: str, schema: str) -> DataFrame:
    """Line-delimited events; lines that do not parse are kept in _corrupt."""
    return spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
