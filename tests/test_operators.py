"""Operators on small inline tables: edges, ties, empty inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexspark.functions import cases, text
from lexspark.operators import quality, reconcile, search
from lexspark.sources import web
from lexspark.streaming import jobs


def test_query_language():
    q = search.compile_query('alpha "beta gamma" or delta -"no go"')
    assert q.groups == ((("alpha",), ("beta", "gamma")), (("delta",),)) and q.without == (("no", "go"),)
    for bad in ("", '"x', "-", "-x", "or x", "x or"):
        with pytest.raises(search.QueryError):
            search.compile_query(bad)


@pytest.fixture(scope="module")
def shelf(spark):
    """Documents with titles, dates, sources and tags, and their index."""
    rows = [(1, "red fox", "red fox", "a", None, None), (2, "red red dog", "dogs", "a", "2020-01-02", "x"), (3, "blue", "blue", "b", "2020-01-03", "x"), (4, None, None, "b", "2020-01-03", None), (5, "a red tree", "red", "us-scotus", "2020-01-01", None)]
    docs = spark.createDataFrame(rows, "id long, text string, title string, source_key string, date string, tag string").withColumn("date", F.col("date").cast("date"))
    tags = F.when(F.col("tag").isNotNull(), F.array(F.struct(F.col("tag").alias("slug"), F.upper("tag").alias("name"))))
    docs = docs.withColumn("tags", tags).withColumn("case_key", F.when(F.col("id") == 5, "2112"))
    return docs, search.Index.build(docs, "id", {"title": F.col("title"), "search_text": F.col("text")})


def test_search_page_branches(spark, shelf):
    docs, index = shelf
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0]), (9, [1.0, 0.0])], "id long, embedding array<float>")
    ids = lambda *a, **k: [r.id for r in search.search_page(docs, index, *a, **k).entries.orderBy("rank").collect()]
    assert ids(None, "red -fox", "fulltext") == [2, 5]
    assert ids(None, "red", "fulltext")[0] == 5  # the exact title comes before better scores
    assert ids(None, "", limit=2) == [3, 4, 2] and ids(None, "", filters={"source_key": "a"}) == [2, 1]
    assert ids(None, "", tag="x") == [3, 2] and ids(None, "", tag="X") == [3, 2] and ids(None, "", tag="y") == []
    assert ids(None, "No. 21-00002") == [] and ids(None, "see 021-12") == [5] and ids(None, "21-12", filters={"source_key": "a"}) == []
    assert ids(vec, "x", "semantic", [1.0, 0.0]) == [1, 3] and ids(vec, "fox", "hybrid", [1.0, 0.0])[0] == 1
    assert ids(None, "", period="today", now=datetime(2020, 1, 3, 9)) == [3, 4]
    page = search.search_page(docs, index, None, "", limit=2).summary("exact").first()
    assert (page.ids, page["mode"], page.total, page.has_more, page.total_is_exact) == ([3, 4], "latest", 5, True, True)
    page = search.search_page(docs, index, None, "", limit=2).summary().first()
    assert (page.total, page.total_is_exact) == (3, False)
    for bad in (dict(query="x", mode="semantic"), dict(query="x", mode="odd"), dict(query="", limit=0), dict(query="", offset=-1), dict(query="x" * 201)):
        with pytest.raises(search.QueryError):
            search.search_page(docs, index, vec, **bad)
    with pytest.raises(search.QueryError):
        search.has_encoded_tag(F.lit("x"), " ")


def test_index_fields_and_phrases(shelf):
    docs, index = shelf
    ids = lambda q: sorted(r.id for r in index.matching(search.compile_query(q)).collect())
    assert ids('"red dog"') == [2] and ids('"red red dog"') == [2] and ids("red dogs") == [2] and ids('"dog red"') == []
    title = {r.id: r.score for r in index.bm25(["red"], {"title": 10.0, "search_text": 1.0}).collect()}
    assert title[5] > title[2] and set(title) == {1, 2, 5}
    assert index.frequencies(["red"], ["title"]) == {"red": 2} and index.frequencies(["red"], ["title", "search_text"]) == {"red": 3}


def test_empty_index(spark):
    docs = spark.createDataFrame([(1, None)], "id long, text string")
    for df in (docs, docs.limit(0)):
        index = search.Index.build(df, "id", {"text": F.col("text")})
        assert index.bm25(["x"]).collect() == [] and index.matching(search.compile_query("x")).collect() == []


def test_catalogue_cursor(spark):
    rows = [(i, float(i // 3), f"2020-01-0{1 + i % 2}") for i in range(9)]
    df = spark.createDataFrame(rows, "id long, score double, date string").withColumn("date", F.col("date").cast("date"))
    mark, cursor, seen = search.request_fingerprint(" Query ", "v"), None, []
    while True:
        page, cursor = search.catalogue_page(df, cursor, mark, 4)
        seen += [r.id for r in page.orderBy(F.desc("score"), F.desc("date"), "id").collect()]
        if cursor is None:
            break
    assert seen == [i for i, *_ in sorted(rows, key=lambda r: (-r[1], r[2] != "2020-01-02", r[0]))]
    assert mark == search.request_fingerprint("query", "v") != search.request_fingerprint("query", "w")
    assert search.fnv1a64("") == "cbf29ce484222325" and search.fnv1a64("a") == "af63dc4c8601ec8c"


def test_rerank_keeps_ties_in_place(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "place long, t string")
    assert [r.place for r in search.rerank(df, F.when(F.col("t") == "a", 1).otherwise(0), "place").collect()] == [1, 0, 2]


def test_cursor():
    f = search.fingerprint(q="x")
    c = search.encode_cursor((1.5, 7), f)
    assert search.decode_cursor(c, f) == (1.5, 7)
    for bad, g in ((c, "other"), ("!!", f), (c[:-4], f)):
        with pytest.raises(search.QueryError):
            search.decode_cursor(bad, g)


def test_range_thresholds():
    now = datetime(2026, 9, 25, 12)
    assert search.since("today", now) == datetime(2026, 9, 25) and search.since("week", now) == datetime(2026, 9, 18) and search.since("latest", now) is None


def test_text_functions(spark):
    rows = [("HTTP://Ex.org/A/?utm_source=x&b=1#f", "a@B.co  call +49 030 1234 5678 www.x.org password=abc", "3. ")]
    got = spark.createDataFrame(rows, "u string, t string, d string").select(text.canonical_url(F.col("u")), text.redact_query(F.col("t")), text.parse_date(F.lit("14.3.2020")), text.parse_date(F.lit("March 4, 2020")), text.parse_date(F.lit("x")), text.nfkc(F.lit("ﬁ")), text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert got[0] == "http://ex.org/A?b=1" and got[1] == "[email] call [number] [url] password=abc"
    assert str(got[2]) == "2020-03-14" and str(got[3]) == "2020-03-04" and got[4] is None and got[5] == "fi" and got[6] == 0.0


def test_case_keys(spark):
    rows = [("fr-conseil-constitutionnel", "Décision 2020-0805 QPC", None), ("us-scotus", "No. 021-00123", None), ("es-tribunal-constitucional", "none", None), ("de-bverfg", "x", "https://e.org/rs20210324_1bvr265618.html"), ("de-bverfg", "1 BvR 007/2015", None), ("es-tribunal-constitucional", "STC 031/2010", None)]
    got = spark.createDataFrame(rows, "s string, t string, u string").select(cases.case_key(F.col("s"), F.col("t"), None, F.col("u")).alias("k")).collect()
    assert [r.k for r in got] == ["20200805qpc", "21123", None, "1bvr265618", "1bvr715", "312010"]
    assert cases.exact_case("what of 1 BvR 16/13?") == ("de-bverfg", "1 BvR 16/13", "1bvr1613") and cases.exact_case("hello") is None
    assert cases.exact_case("Neubauer 21-12") == ("de-bverfg", "1 BvR 2656/18", "1bvr265618")


def test_reconcile(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(2, ""), (3, "c"), (4, "d")], "k long, v string")
    assert {(r.k, r.change) for r in reconcile.diff(old, new, "k", ["v"]).collect()} == {(1, "removed"), (2, "changed"), (4, "added")}
    changes = spark.createDataFrame([(1, None, 1, True), (3, "z", 2, False), (5, "n", 3, False)], "k long, v string, seq long, deleted boolean")
    assert {(r.k, r.v) for r in reconcile.overlay(old, changes, "k", "seq", "deleted").collect()} == {(2, None), (3, "z"), (5, "n")}
    lists = spark.createDataFrame([([1, 2, 3], [1, 3, 2])], "o array<int>, e array<int>")
    r = reconcile.parity(lists, "o", "e", 3).first()
    assert (r.overlap, r.same_set, r.same_order, r.prefix) == (1.0, True, False, 1)


def test_ledger(spark):
    ev = spark.createDataFrame([(k, i, f"p{i}") for k in (1, 2) for i in range(5)], "k long, i long, p string")
    ledger = reconcile.chain(ev, "k", "i", F.col("p"))
    assert {(r.entries, r.broken) for r in reconcile.verify_chain(ledger, "k", "i").collect()} == {(5, 0)}
    forged = ledger.withColumn("payload", F.when((F.col("k") == 1) & (F.col("i") == 2), "x").otherwise(F.col("payload")))
    assert {(r.k, r.broken) for r in reconcile.verify_chain(forged, "k", "i").collect()} == {(1, 1), (2, 0)}


def test_rate_limit_opens_at_first_hit(spark):
    rows = [(1, i, datetime(2026, 1, 1, m // 60, m % 60)) for i, m in enumerate((50, 55, 59, 65, 111))]
    ev = spark.createDataFrame(rows, "u long, i long, ts timestamp_ntz")
    got = [(r.n, r.allowed) for r in jobs.rate_limit(ev, "u", "ts", "i", 3600, 2).orderBy("i").collect()]
    assert got == [(1, True), (2, True), (3, False), (4, False), (1, True)]


def test_streaming_register(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, k string").write.parquet(src)
    seen = []
    stream = spark.readStream.schema("id long, k string").parquet(src)
    jobs.drain(stream, str(tmp_path / "cp"), lambda df, n: seen.extend(r.k for r in jobs.register(df, None, ["k"], "id").collect()))
    jobs.drain(stream, str(tmp_path / "cp"), lambda df, n: seen.append("again"))
    assert sorted(seen) == ["a", "b"]


def test_web(spark):
    html = "<html><title>T</title><nav><a href='/n'>nav</a></nav><article><p>" + "word " * 60 + "</p></article><a href='x#y'>X</a></html>"
    pages = spark.createDataFrame([(1, "http://e.org/a/", html), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in web.readable(pages).collect()}
    assert got[1].title == "T" and got[1].text.startswith("word word") and got[2].text == ""
    assert {r.href for r in web.links(pages).collect()} == {"http://e.org/n", "http://e.org/a/x"}
    rules = web.robots_rules("User-agent: *\nDisallow: /a\nAllow: /a/b\n")
    got = spark.createDataFrame([("/a/c",), ("/a/b/d",), ("/z",)], "p string").select(web.robots_allowed(F.col("p"), rules).alias("ok")).collect()
    assert [r.ok for r in got] == [False, True, True]


def test_quality(spark):
    got = spark.range(1).select(quality.service_level(F.lit(None).cast("double"), 1, 2).alias("a"), quality.service_level(F.lit(2.0), 1, 2).alias("b"), text.redact_secrets(F.lit("Bearer abcdefghijklmnop1 password: x")).alias("c")).first()
    assert (got.a, got.b, got.c) == ("unknown", "critical", "Bearer [redacted] password: [redacted]")


def test_only_texts_that_nfkc_changes_are_sent(spark):
    import re
    import unicodedata

    stable = [chr(c) for c in range(0x110000) if re.match(f"[{text.LATIN}{text.STABLE}]".replace("\\\\", "\\"), chr(c))]
    assert len(stable) > 30_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stable)
    assert all(unicodedata.normalize("NFKC", b + c) == b + c for b in "aAéЕか가" for c in stable)
    said = ["ﬁ", "é", "각", "é", "𝐀", None, "", "x" * 1000 + "ª", "が", "«a» – 1½", "1 BvR 7/18"]
    got = spark.createDataFrame(list(enumerate(said)), "k int, t string").select("k", text.nfkc(F.col("t"))).orderBy("k").collect()
    assert [r[1] for r in got] == [None if t is None else unicodedata.normalize("NFKC", t) for t in said]


def test_texts_are_normalized_once(spark):
    from lexspark.plans import registry

    plan = registry.QUERIES["legal_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") == 1
