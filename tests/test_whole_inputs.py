"""Queries that must read all of their input rows and texts."""

from datetime import datetime

import duckdb
import pandas as pd
import pytest

from lexspark.plans import registry
from lexspark.sources import web


def test_known_terms_are_all_used(spark, tmp_path):
    rows = pd.DataFrame([(f"Brand#{b}", 1 if b < 3 else 2) for b in range(6) for _ in range(2)], columns=["p_brand", "p_size"])
    spark.createDataFrame(rows, "p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.register("part", rows)
    got = sorted(map(tuple, registry.QUERIES["glossary_candidates"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(registry.ORACLES["glossary_candidates"]).fetchall()) == [(f"Brand#{b}", 2, f"brand{b}") for b in (3, 4, 5)]


def test_titles_are_whole(spark, tmp_path):
    title = "The " + "long title " * 60
    rows = [(1, title + "\nbody", "en", "s"), (2, "a title", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["nfkc_title_match"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(1, title.lower().strip(), False)]


def _order(key, cust, day="1997-01-01"):
    return (key, cust, "F", 1.0, datetime.fromisoformat(day), "1-URGENT")


_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def _both(spark, folder, name, **tables):
    """A query's rows and those of its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(map(tuple, registry.QUERIES[name](spark, str(folder)).collect())), sorted(con.execute(registry.ORACLES[name]).fetchall())


@pytest.mark.parametrize("lines", [[(1, 7, 1)], [(2, 8, 3), (2, 7, 2), (2, 7, 1)], [(2, 9, 1)]])
def test_article_without_tags_is_no_row(spark, tmp_path, lines):
    parts = [(7, "Brand#1", "a"), (8, "Brand#0", "b"), (9, "Brand#2", None)]
    got, want = _both(spark, tmp_path, "article_detail", orders=([_order(1, 1), _order(2, 1)], _ORDERS), lineitem=(lines, "l_orderkey long, l_partkey long, l_linenumber int"), part=(parts, "p_partkey long, p_brand string, p_name string"))
    assert got == want


def test_last_runs_that_are_equal_go_by_their_id(spark, tmp_path):
    # runs of source 46, completed at one time: success, degraded, failed and none, the first by id being what counts
    keys = [22, 5, 10, 35, 2, 15]
    for n, first in enumerate(keys):
        rows = [_order(k, 46, "1998-08-01") for k in sorted(k for k in keys if k >= first)]
        got, want = _both(spark, tmp_path / str(n), "watchdog_violations", orders=(rows, _ORDERS), nation=([(6,)], "n_nationkey int"))
        assert got == want


def test_cut_references_are_text(spark, tmp_path):
    page = "<html><head><title>t</title></head><body><nav>x</nav><article><h1>a &amp;&amp;&amp</h1><p>" + "Some words, and &lt;more&gt; &ampersand &eacute; &#65; &copy &copy; &amp;lt; words, " * 8 + "</p></article></body></html>"
    got, want = _both(spark, tmp_path, "scored_text", pages=([(1, "https://e.org/", page)], "page_id long, url string, html string"))
    assert got == want and got[0][1] == "scored"


def test_pages_of_short_lines_odd_blanks_and_none(spark, tmp_path):
    page = lambda title, body: f"<html><head><title>t</title></head><body><nav>x</nav><div class='ad'>An ad.</div><article><h1>{title}</h1>{body}</article></body></html>"
    rows = [page("a", "".join(f"<p>line {i}</p>" for i in range(60))), page("a", "<p>" + "Some\u00a0words,\u3000and&nbsp; more\x0b words\x85. " * 12 + "</p>"), page("\u2028short", "<p>x</p>"), "", None]
    got, want = _both(spark, tmp_path, "scored_text", pages=([(i, "https://e.org/", h) for i, h in enumerate(rows)], "page_id long, url string, html string"))
    assert got == want and [g[1] for g in got] == ["scored", "scored", "body", "body", "body"]


_SOME = "Some words of the court, and more of them. "
_ARTICLE = f"<article><h1>t</h1><p>{_SOME * 8}</p></article>"


@pytest.mark.parametrize(
    "html, found",
    [
        (f"<body><article><p>\u00a0{_SOME}\u3000</p><p>\u2003</p><p><b>\u00a0&nbsp;{_SOME * 8}<br></article>", "scored"),  # lines that begin and end with other blanks
        (f"<body><main><p>{_SOME * 8}</p></main>", "body"),  # no article
        (f"<body><article class='x'><p>{_SOME * 8}</p></article>", "body"),
        (f"<article><p>{_SOME * 8}</p></article><p>{_SOME}</p>", "scored"),  # no body
        (f"<body>{_ARTICLE}<p>{_SOME * 20}</p>{_ARTICLE}", "scored"),  # several articles, and what is between them
        (f"<body>{_ARTICLE}<div>{f'<p>{_SOME * 9}</p>' * 9}</div>", "scored"),  # more text beside the article than in it
        (f"<body><article><p>Short.</p></article><div><p>{_SOME * 9}</p></div>", "body"),
        (f"<body><article><nav>x</nav><header>{_SOME}</header><div><p>{_SOME * 8}</p></div><div class='ad'>An ad.</div><p><a href='/'>{_SOME * 3}</a><td>y</td></article>", "scored"),
        (f"<body><header>{_SOME}</header><form>x</form><noscript>y</noscript><article>z</article>", "body"),
        (f"<body><article><P>{_SOME * 4}<P>{_SOME * 4} 1 < 2 <3 &am<b>p;</b> <x</article>", "scored"),
        (f"<body><!-- <nav> --><article><textarea><p>{_SOME * 8}</textarea></article><style>x", "scored"),
    ],
)
def test_pages_that_are_not_plain(spark, tmp_path, html, found):
    head = "<!DOCTYPE html><html lang=\"en\"><head><title>t</title></head>"
    got, want = _both(spark, tmp_path, "scored_text", pages=([(1, "https://e.org/", head + html)], "page_id long, url string, html string"))
    assert got == want and got[0][1] == found


def test_keys_of_pages_are_whole_beside_one_that_is_missing(spark):
    pages = spark.createDataFrame([(2**60 + 1, "<p>x"), (None, "<p>x")], "page_id long, html string").coalesce(1)
    assert {r.page_id for r in web.readable(pages).collect()} == {2**60 + 1, None}
