"""Readers of pages, feeds, sitemaps and the sources of decisions, on small inline pages."""

from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import lifecycle, reading
from lexspark.sources import courts, web

LIST = """<html><body><div class=menu><a href="/home">Home</a></div><ul class="list hits"><li>On 1.2.2021 <a href="rs1.html">First <b>order</b></a> stands</li>
<li><a href="/d/2?utm_source=x" title=" Second "><img src=i></a></li><li><a href='rs1.html#top' aria-label="again"></a></li></ul><p id=more><a href="/old" aria-label="Older"></a></p></body></html>"""


def test_links_by_selector(spark):
    pages = spark.createDataFrame([(1, "https://e.org/list/", LIST), (2, None, None)], "page_id long, url string, html string")
    got = lambda s: [(r.href, r.anchor, r.near) for r in web.links(pages, selectors=s).collect()]
    assert got(["ul.hits li a"]) == [("https://e.org/list/rs1.html", "First order", "On 1.2.2021 First order stands"), ("https://e.org/d/2?utm_source=x", "Second", "")]
    assert [h for h, *_ in got(["#more a", ".menu a"])] == ["https://e.org/old", "https://e.org/home"] and got(["ol a"]) == []
    assert len(got(None)) == 4


def test_feeds(spark):
    rss = "<rss><channel><item><link>https://e.org/1</link></item></channel></rss>"
    feed = '{"version": "1", "items": [{"url": "https://e.org/1", "title": " A ", "date": "2020"}, {"name": "no link"}, {"link": "https://e.org/2", "name": "B"}]}'
    rows = spark.createDataFrame([(rss, feed), (rss, '[{"href": "x"}]'), (rss, "{broken"), (rss, None)], "x string, j string")
    got = rows.select(web.feed_links(F.col("x")).alias("x"), web.json_feed_links(F.col("j")).alias("j")).collect()
    assert got[0].x == ["https://e.org/1"] and [tuple(i) for i in got[0].j] == [("https://e.org/1", "A", "2020"), ("https://e.org/2", "B", None)]
    assert [i.url for i in got[1].j] == ["x"] and got[2].j == got[3].j == []


def test_sitemaps(spark):
    site = lambda *urls: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    have = [("r.xml", site("a.xml", "b.xml", "lost.xml", "page-of-index")), ("a.xml", site("x/decision/1", "x/other")), ("b.xml", site("c.xml")), ("c.xml", site("deep/decision/9", "d.xml")), ("d.xml", site("too/deep/decision"))]
    fetched = spark.createDataFrame(have, "url string, xml string")
    start = spark.createDataFrame([("r.xml",), ("r.xml",)], "url string")
    urls = lambda **k: [r.url for r in web.sitemap_walk(start, fetched, **k).collect()]
    assert urls(words=["DECISION"]) == ["deep/decision/9", "x/decision/1"] and urls(words=[], most=2) == ["d.xml", "deep/decision/9"]
    assert urls(words=[], nested=1) == ["x/decision/1", "x/other"]


def test_robots_delay():
    rules = "User-agent: *\nCrawl-delay: 5\nUser-agent: bot\nAllow: /\nCrawl-delay: 0.5 # s\n"
    assert web.crawl_delay(rules) == 5 and web.crawl_delay(rules, "Bot") == 0.5 and web.crawl_delay("User-agent: x\nCrawl-delay: no") is None


def test_metadata(spark):
    html = "<title>Page</title><meta property='og:title' content='Og'><meta name=description content=' about it '><body><h1 class=sr-only>Skip</h1><h1>Urteil vom 3. März 2021</h1> <p>Erster  Senat, Az.: 1 BvR 2/20</p></body>"
    french = "<h1 class='title x'>Décision n° 2020-800 QPC</h1> <time datetime='2020-05-11'>le 11 mai</time>"
    rows = web.metadata(spark.createDataFrame([(1, html), (2, french), (3, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (rows[0].title, rows[0].description, rows[0].published, rows[0].senate) == ("Urteil vom 3. März 2021", "about it", "3. März 2021", "Erster Senat") and rows[0].case_number.startswith("Az.: 1 BvR 2/20")
    assert (rows[1].title, rows[1].published, rows[1].decision_number) == ("Décision n° 2020-800 QPC", "2020-05-11", "Décision n° 2020-800 QPC") and rows[2].title is None


def test_source(spark):
    host = "https://www.conseil-constitutionnel.fr"
    body = "<title>t</title><h1>Décision n° 2020-800 QPC</h1><article><p>" + "mot " * 100 + "</p></article>"
    pages = spark.createDataFrame([(1, host + "/list", f'<a href="/decision/2020/1.htm#a">One</a><a href="/decision/2020/2.htm?utm_id=1">Two</a><a href="/decision">list</a><a href="https://elsewhere.org/x">No</a>'), (2, host + "/decision/2020/1.htm", body), (3, "https://elsewhere.org/", "<a href='/z'>z</a>")], "page_id long, url string, html string")
    s = courts.SOURCES["fr-conseil-constitutionnel"]
    found = s.discover(pages)
    assert sorted((r.url, r.title) for r in found.collect()) == [(host + "/decision/2020/1.htm", "One"), (host + "/decision/2020/2.htm", "Two")]
    fetched = s.fetch(found, pages)
    assert {r.url: r.fetched for r in fetched.collect()} == {host + "/decision/2020/1.htm": True, host + "/decision/2020/2.htm": False}
    row = s.normalize(fetched).collect()
    assert [(r.source_key, r.language, r.title, r.case_key) for r in row] == [(s.key, "fr", "Décision n° 2020-800 QPC", "2020800qpc")] and row[0].text.startswith("mot mot") and len(row[0].content_hash) == 32


def test_blobs_are_put_once(spark, tmp_path):
    path = str(tmp_path / "blobs")
    rows = lambda *t: spark.createDataFrame([(x,) for x in t], "t string").select(lifecycle.blob(F.col("t"), F.lit("s")).alias("b")).select("b.ref", "b.document", "b.too_large")
    lifecycle.put_blobs(rows("a", "b", "a"), path)
    lifecycle.put_blobs(rows("b", "c"), path)
    assert sorted(r.document for r in spark.read.parquet(path).collect()) == ['"a"', '"b"', '"c"']


def test_broken_json_stops(spark):
    df = spark.createDataFrame([('{"a": 1}',), (None,)], "j string")
    assert [r.j and r.j.a for r in reading.revive(df, {"j": "struct<a:int>"}).collect()] == [1, None]
    bad = spark.createDataFrame([("{a",)], "j string")
    try:
        reading.revive(bad, {"j": "struct<a:int>"}).collect()
    except Exception as e:
        assert "not valid JSON" in str(e)
    else:
        raise AssertionError("no error")


def test_review_decisions(spark):
    rows = [("closed_private", "approved", []), ("odd", "needs_triage", ["approved"]), (None, "approved", ["published"]), (None, None, ["approved", "published", "x"]), (None, "odd", [])]
    df = spark.createDataFrame(rows, "c string, s string, h array<string>")
    got = df.select(lifecycle.review_decision(F.col("c"), F.col("s"), F.col("h")).alias("d")).collect()
    assert [r.d for r in got] == ["closed_private", "needs_triage", "approved", "published", "odd"]


def test_slug_and_device(spark):
    got = spark.range(1).select(text.slugify(F.lit("  A b/C! ")).alias("s"), text.device(F.lit("Mozilla iPhone")).alias("d"), text.client_hash(F.lit("1.2.3.4"), F.lit("2020-01-01"), "salt").alias("h")).first()
    assert got.s == "a-b-c" and got.d == "mobile" and len(got.h) == 64
