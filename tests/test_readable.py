"""Text of pages by content scoring, on pages that don't say where it is."""

import gc

import pandas as pd
import pytest

from lexspark.sources import web

LONG = "The court finds, with the applicant, that the rule of the statute can't be read in this way, and holds that it is void. "
LINKS = "".join(f"<li><a href='/{i}'>Another decision of the court, number {i}</a></li>" for i in range(30))


def _text(html):
    return web._readable(web._parse(html))


def test_running_text_wins_over_link_lists_and_short_boxes():
    html = f"<body><div class=x><ul>{LINKS}</ul></div><div><div><p>{LONG}</p><p>{LONG * 2}</p><p>Short.</p></div></div><div><p>Contact us here.</p></div></body>"
    text, found = _text(html)
    assert found == "scored" and text.split("\n") == [LONG.strip(), (LONG * 2).strip(), "Short."]


def test_siblings_alike_are_kept_and_links_left_out():
    html = f"<body><div id=a><p>{LONG}</p><p>{LONG}</p></div><div id=b><p>{LONG}</p><p>{LONG}</p><p><a href=x>{LONG}</a></p></div><div class='sidebar'><p>{LONG}</p></div></body>"
    assert _text(html) == ("\n".join([LONG.strip()] * 4), "scored")


def test_class_and_id_speak_for_and_against():
    box = lambda name: f"<div><div class='{name}'><p>{LONG}</p><p>{LONG}</p></div></div>"
    text, _ = _text(f"<body>{box('comments').replace('finds', 'says')}{box('content')}</body>")
    assert "finds" in text and "says" not in text


def test_text_without_paragraphs():
    assert _text(f"<body><table><tr><td>Menu</td><td>{LONG}<br>{LONG}<br>{LONG}</td></tr></table></body>")[0].count("finds") == 3
    assert _text(f"<body><div>{LONG}{LONG}</div></body>") == ((LONG * 2).strip(), "scored")


def test_open_paragraphs_and_skipped_parts():
    text, _ = _text(f"<body><nav><p>{LONG}</p></nav><div><p><b>{LONG}<p>{LONG}<li>{LONG}<li>x</div><script>var a = '</p>';</script><footer>{LONG}</footer>")
    assert text.split("\n") == [LONG.strip()] * 3 + ["x"]


@pytest.mark.parametrize("place, html", [("main", "<main><p>{}</p></main>"), ("#pagemaindiv", "<div id='pagemaindiv'>{}</div>"), (".field--name-body", "<div class='a field--name-body'>{}</div>"), ("body", "<div>{}</div>")])
def test_places_if_nothing_stands_out(place, html):
    lines = "<br>".join(f"line {i} of a list" for i in range(20))  # no block is long enough to count
    assert _text(f"<body>{html.format(lines)}</body>")[1] == place


@pytest.mark.parametrize("html", ["", None, "<", "plain", "<p>", "</div></div>", "<div>" * 3000 + "x", "<a>" * 50, "<li><td></p></li>"])
def test_odd_pages(html):
    assert _text(html)[1] == "body"


def test_on_spark(spark):
    pages = spark.createDataFrame([(1, f"<title>T</title><div><p>{LONG}</p><p>{LONG}</p></div>"), (2, None), (1, "<p>x")], "page_id long, html string")
    assert sorted((r.page_id, r.title, len(r.text), r.found) for r in web.readable(pages).collect()) == [(1, "", 1, "body"), (1, "T", 2 * len(LONG.strip()) + 1, "scored"), (2, "", 0, "body")]


def test_the_elements_of_one_page_are_held_at_a_time():
    alive = []

    def pages():
        yield pd.DataFrame({"key": range(450), "html": [f"<title>t{i}</title><p>{LONG}{LONG}{LONG}</p>" for i in range(450)]})

    keys = []
    for got in web._read_pages(pages()):
        alive.append(sum(isinstance(x, web._Page) for x in gc.get_objects()))
        keys += got["key"].tolist()
        assert len(got) <= web.READ_AT_A_TIME and got["title"].tolist() == [f"t{k}" for k in got["key"]]
    assert keys == list(range(450)) and max(alive) <= 1
