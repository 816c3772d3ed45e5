"""Members of archives by ranges, typed records, tables of cases and the four courts' grammars."""

import gzip
import hashlib
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from lexspark.sources import archives, courts, records


def _tar(path, members, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_members_by_ranges(spark, tmp_path):
    members = [(f"a/{i:03}.xml", f"<x>{i}</x>".encode() * (i % 7 + 1)) for i in range(200)] + [("b.txt", b"no"), ("../up.xml", b"<x/>"), ("a/000.xml", b"<again/>"), ("empty.xml", b""), ("big.xml", b"y" * 5000), ("latin.xml", b"\xe9")]
    _tar(tmp_path / "one.tar", members)
    _tar(tmp_path / "two.tar.gz", members, "w:gz")
    (tmp_path / "bad.tar").write_bytes(b"no archive" * 100)
    (tmp_path / "bad.tar.gz").write_bytes(gzip.compress(b"no archive" * 100)[:60])
    whole = (tmp_path / "one.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[:40_000])
    for size in (1 << 25, 2_000):
        got = records.members(spark, f"{tmp_path}/*", most=4000, range_bytes=size).withColumn("path", F.regexp_extract("path", "[^/]+$", 0)).collect()
        for name in ("one.tar", "two.tar.gz"):
            own = [r for r in got if r.path == name]
            assert {r.member: r.text for r in own if r.error is None} == {n: d.decode() for n, d in members[:200]}
            assert all(r.sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r.bytes == len(r.text) for r in own if r.error is None)
            assert sorted((r.member, r.error) for r in own if r.error) == [("../up.xml", "path_invalid"), ("a/000.xml", "duplicate_path"), ("big.xml", "too_large"), ("empty.xml", "empty"), ("latin.xml", "encoding_invalid")]
        assert {(r.path, r.error) for r in got if r.member is None} == {("bad.tar", "unreadable"), ("bad.tar.gz", "unreadable"), ("cut.tar", "truncated")} or {(r.path, r.error) for r in got if r.member is None} == {("bad.tar", "unreadable"), ("bad.tar.gz", "unreadable"), ("cut.tar", "unreadable")}


GOOD = dict(ID="CONSTEXT000000000007", ORIGINE="CONSTIT", NATURE="qpc", TITRE="A &amp; B", DATE_DEC="2020-03-04", JURIDICTION="Conseil  constitutionnel", NUMERO="2020-1", NOR="", URL_CC="http://www.conseil-constitutionnel.fr:80/decision/2020/20201QPC.htm#x", ECLI="ECLI:FR:CC:2020:1", NATURE_QUALIFIEE="Q")


def _xml(**over):
    v = GOOD | over
    e = lambda *names: "".join(f"<{n}>{v[n]}</{n}>" for n in names if v[n] is not None)
    return f"<?xml version='1.0'?>\n<TEXTE_JURI_CONSTIT><META><META_COMMUN>{e('ID', 'ORIGINE', 'NATURE')}</META_COMMUN><META_SPEC><META_JURI>{e('TITRE', 'DATE_DEC', 'JURIDICTION', 'NUMERO', 'NOR')}</META_JURI><META_JURI_CONSTIT>{e('URL_CC', 'ECLI', 'NATURE_QUALIFIEE')}</META_JURI_CONSTIT></META_SPEC></META></TEXTE_JURI_CONSTIT>"


def test_typed_records(spark):
    cases = {
        None: _xml(), "id_missing": _xml(ID=None), "origin_missing": _xml(ORIGINE=" "), "nature_missing": _xml(NATURE=""), "identity_invalid": _xml(ORIGINE="JURI"), "other_nature": _xml(NATURE="LOI", DATE_DEC="x"),
        "date_invalid": _xml(DATE_DEC="2020-02-30"), "jurisdiction_invalid": _xml(JURIDICTION="Cour"), "title_missing": _xml(TITRE=None), "number_missing": _xml(NUMERO=None), "url_invalid": _xml(URL_CC="https://www.conseil-constitutionnel.fr/decision/2019/1QPC.htm"),
        "ecli_invalid": _xml(ECLI="ECLI:DE:X"), "entity_forbidden": "<!DOCTYPE a [<!ENTITY b 'c'>]>" + _xml(), "root_invalid": "<other/>", "xml_missing": None, "too_large": None,
    }
    rows = [(str(k), x, "too_large" if k == "too_large" else None, "mine") for k, x in cases.items()] + [("broken", "<TEXTE_JURI_CONSTIT><META><a></TEXTE_JURI_CONSTIT>", None, "mine")]
    got = {r.member: r for r in records.xml_records(spark.createDataFrame(rows, "member string, text string, error string, title string")).collect()}
    assert {k: got[str(k)].error for k in cases} == {k: k for k in cases}
    r = got["None"]
    assert (r.record_id, r.nature, r.qualified_nature, r.title, str(r.decided), r.number, r.ecli, r.nor, r.url, r.court_record) == ("CONSTEXT000000000007", "QPC", "Q", "A & B", "2020-03-04", "2020-1", "ECLI:FR:CC:2020:1", None, "https://www.conseil-constitutionnel.fr/decision/2020/20201QPC.htm", "20201QPC")
    assert got["date_invalid"].record_id is None and got["broken"].error is not None


def test_a_record_once(spark):
    rows = [("p", "b", "ID1", None), ("p", "a", "id1", None), ("q", "a", "x", None), ("q", "b", None, "url_invalid")]
    got = records.once(spark.createDataFrame(rows, "path string, member string, record_id string, error string")).collect()
    assert {(r.path, r.member): r.error for r in got} == {("p", "b"): "record_duplicate", ("p", "a"): None, ("q", "a"): None, ("q", "b"): "url_invalid"}


@pytest.mark.parametrize(
    "said, want, court",
    [
        ("12 U. S.  34", "12 U.S. 34", "scotus_candidate"), ("12 u.s. 34 (1 Cranch) x", "12 U.S. 34 (1 Cranch)", "unknown"), ("5 U.S. (1 Cranch) 137 (1803)", "5 U.S. (1 Cranch) 137 (1803)", "scotus_candidate"), ("103 F.Supp. 569 (D.D.C. 1952)", "103 F. Supp. 569 (D.D.C. 1952)", "lower_federal"),
        ("7 F. 3d 19", "7 F.3d 19", "lower_federal"), ("1 F. Supp.2d 2", "1 F. Supp. 2d 2", "lower_federal"), ("3 F. App’x 4", "3 F. App’x 4", "unknown"), ("3 F. App'x 4", "3 F. App'x 4", "lower_federal"), ("139 S. Ct. 2484 (2019)", "139 S. Ct. 2484 (2019)", "unknown"),
        ("9 N.E. 2d 10", "9 N.E.2d 10", "state_or_other"), ("1 So.2d 2", "1 So. 2d 2", "state_or_other"), ("no citation", "no citation", "unknown"),
    ],
)
def test_citations(spark, said, want, court):
    got = spark.createDataFrame([(said,)], "c string").select(archives.citation(F.col("c")).alias("n"), archives.court(F.col("c")).alias("k")).first()
    assert (got.n, got.k) == (want, court)


def test_cases_and_essays(spark):
    row = lambda name, *essays: f"<tr><td>{name}</td><td>" + "".join(f"<a href='{h}'>{t}</a>" for h, t in essays) + "</td></tr>"
    one, two = ("/browse/essay/artI-S2/ALDE_00000001/", "First <b>essay</b>"), ("https://constitution.congress.gov/browse/essay/x.1/alde_00000002", "Second")
    html = (
        "<table><thead><tr><th>Case Name</th><th>Essay</th></tr></thead><tbody>" + row("In 1962 the Court 5 Smith v. Doe, 369 U. S. 186 (1962)", one, ("http://constitution.congress.gov/browse/essay/x/ALDE_3/", "not secure"), ("https://e.org/browse/essay/x/ALDE_4/", "elsewhere"))
        + row("SMITH v. Doe, 369 U.S. 186 (1962)", one, two) + "</tbody></table><h2>State courts</h2><table>" + row("Ann v. Bob, 12 N.W.2d 30", two) + "<tr><td data-case-citation='5 U.S. (1 Cranch) 137 (1803)' data-case-name='Marbury'>M.</td><td></td></tr>" + row("only one cell is no case 1 U.S. 2")[:-19] + row(", 3 U.S. 4") + "</table>"
    )
    gate = "<title>Just a moment...</title>" + html
    found = archives.cases(spark.createDataFrame([(1, html), (2, gate), (3, None)], "page_id long, html string"))
    got = {r.citation: r for r in found.collect()}
    assert set(got) == {"369 U.S. 186 (1962)", "12 N.W.2d 30", "5 U.S. (1 Cranch) 137 (1803)"} | ({"1 U.S. 2"} & set(got))
    smith = got["369 U.S. 186 (1962)"]
    assert (smith.name, smith.section, smith.court) == ("In 1962 the Court 5 Smith v. Doe", "Essay", "scotus_candidate")
    assert [(e.essay_id, e.title) for e in smith.essays] == [("ALDE_00000001", "First essay"), ("ALDE_00000002", "Second")]
    assert smith.candidate_key == "conan:" + hashlib.sha256(b"369 u.s. 186 (1962)").hexdigest()[:24]
    assert (got["12 N.W.2d 30"].section, got["5 U.S. (1 Cranch) 137 (1803)"].name) == ("State courts", "Marbury")
    assert sorted((r.citation, r.essay_id) for r in archives.essay_edges(found).collect() if r.citation != "1 U.S. 2") == [("12 N.W.2d 30", "ALDE_00000002"), ("369 U.S. 186 (1962)", "ALDE_00000001"), ("369 U.S. 186 (1962)", "ALDE_00000002")]


PAGES = {
    "de-bverfg": ("https://www.bundesverfassungsgericht.de/list", "<ul><li>Beschluss vom 24. März 2021 - <a href='/SharedDocs/Entscheidungen/DE/2021/03/rs20210324_1bvr265618.html#a'>1 BvR 2656/18</a></li><li><a href='/SharedDocs/Entscheidungen/EN/2020/05/rs20200505_2bvr085915.html'>PSPP</a></li><li><a href='/SharedDocs/Pressemitteilungen/DE/2021/x.html'>press</a></li></ul>"),
    "us-scotus": ("https://www.supremecourt.gov/opinions/slipopinion/20", "<table class='table'><tr><th>R-</th></tr><tr><td>1</td><td>6/1/21</td><td>19-1155</td><td><a href='/opinions/20pdf/19-1155_1a7d.pdf' title='Holding'>Garland v. Dai</a></td><td>G</td></tr><tr><td><a href='/x.pdf'>short</a></td></tr></table>"),
    "fr-conseil-constitutionnel": ("https://www.conseil-constitutionnel.fr/les-decisions", "<div>Décision n° 2020-800 QPC du 11 mai 2020 <a href='/decision/2020/2020800QPC.htm'>Loi</a></div><div><a href='/decision'>list</a><a href='https://qpc360.conseil-constitutionnel.fr/2021-02-03/decision-x'>QPC360</a></div>"),
    "es-tribunal-constitucional": ("https://hj.tribunalconstitucional.es/es/List", "<p><a href='/es/Resolucion/Show/26778'>SENTENCIA 148/2021, de 14 de julio</a> de 14 de julio de 2021</p><a href='/es/Resolucion/Show/0'>none</a>"),
}
WANT = {
    "de-bverfg": {("1 BvR 2656/18", "1 BvR 2656/18", "2021-03-24"), ("PSPP", "2 BvR 859/15", "2020-05-05")},
    "us-scotus": {("Garland v. Dai", "19-1155", "2021-06-01")},
    "fr-conseil-constitutionnel": {("Loi", "2020-800 QPC", "2020-05-11"), ("QPC360", None, "2021-02-03")},
    "es-tribunal-constitucional": {("SENTENCIA 148/2021, de 14 de julio", "148/2021", "2021-07-14")},
}


@pytest.mark.parametrize("key", sorted(courts.SOURCES))
def test_court_from_discovery_to_article(spark, key):
    s = courts.SOURCES[key]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(PAGES.values())], "page_id long, url string, html string")
    items = s.discover(pages)
    assert {(r.title, r.number, r.published and str(r.published)) for r in items.collect()} == WANT[key]
    text = "The text of this decision of the court is given here, with its reasons, in full. " * 8
    crawled = items.select(F.monotonically_increasing_id().alias("page_id"), "url", F.lit(f"<html><title>Page</title><div><p>{text}</p></div></html>").alias("html"))
    rows = s.normalize(s.fetch(items, crawled)).collect()
    assert {(r.case_number, str(r.published)[:10]) for r in rows} == {(n, d) for _, n, d in WANT[key]}
    assert all(r.text == text.strip() and r.source_key == key and r.language == s.language for r in rows)
    assert {r.case_key is not None for r in rows} <= {True} if key != "fr-conseil-constitutionnel" else True


def test_cases_are_read_once_and_cited_by_one_match(spark):
    from lexspark.plans import registry

    plan = registry.QUERIES["essay_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.lower().count("mapin") == 1


def test_citations_of_texts_are_those_of_columns(spark):
    said = ["369 U. S. 186 (1962)", " 12  n.w. 2d 30 ", "see 1 F.3d 2", "1 State 2 F. 2d 7 (2d Cir. 1990)", "12 Reports 9", "5 S. Ct. 77", "9 D. Mass. 8", "", "7 So.2d 1 and 8 U.S. 2", "١ U.S. 2"]
    want = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, c string").select("k", archives.citation(F.col("c")), archives.court(F.col("c"))).orderBy("k").collect()
    assert [(archives._written(t), archives._court_of(archives._written(t))) for t in said] == [tuple(r)[1:] for r in want]


def test_short_way_of_the_parser_is_the_long_one():
    from html.parser import HTMLParser

    from lexspark.sources import markup

    def seen(base):
        class P(base):
            def __init__(self):
                super().__init__()
                self.out = []

            def handle_starttag(self, tag, attrs):
                self.out.append(("<", tag, attrs))

            def handle_endtag(self, tag):
                self.out.append((">", tag))

            def handle_data(self, data):
                self.out.append(data)

        return P

    for page in ("<p>a<b>c</b></p>", "<script>var a='<td>x</td></p>';</script><td>y", "<title>a<b></title><tr><TD>x</td ></tr>", "<style>p</style></style><i", "<p/><br/></>x</ p></p", "<p>&amp<td>&lt;b&gt;", "<!-- <td> --><td a='>'>q</td>", "<textarea><p></textarea></p>"):
        got, want = seen(markup.Parser)(), seen(HTMLParser)()
        for p in (got, want):
            p.feed(page)
            p.close()
        assert got.out == want.out, page


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    for i in range(12):
        _tar(tmp_path / f"{i}.tar", [(f"{i}-{j}.xml", b"<x/>") for j in range(5)])
    read = records.members(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    assert read.count() == 60 and read.select("task").distinct().count() > 1


def test_xml_is_parsed_once(spark, tmp_path, monkeypatch):
    from lexspark.plans import registry

    spark.createDataFrame([(i, f"title {i}\nbody") for i in range(130)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    once, plans = records.once, []
    monkeypatch.setattr(records, "once", lambda rows: plans.append(once(rows)) or plans[0])
    assert registry.QUERIES["xml_records"](spark, str(tmp_path)).count() == 130
    assert "from_xml" not in plans[0]._jdf.queryExecution().optimizedPlan().toString()


def test_a_url_is_made_once(spark):
    from lexspark.plans import registry

    plan = registry.QUERIES["court_items"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(href") + plan.count("trim(said") == len(courts.SOURCES)


def test_short_ways_of_urls_and_attributes():
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    from lexspark.sources import markup

    bases = ("", "https://e.org", "https://e.org/a/b", "HTTP://E.org/x", "http://e.org:80?q", "https://u@e.org/x", "https://e.org/a;b?c", "ftp://e.org/", "//e.org/x", "https://[::1]/x")
    paths = ("/a", "/a/", "/a/b.html#c", "/a?b=c&d=e", "/a?", "/a#", "/a/../b", "/./a", "//x/y", "/", "/a//b", "/a.", "/a..b/c", "/a;p", "/a?b#c", "?q", "#f", "a/b", "https://x.org/y", "/é", "/a b", "/a\n")
    assert all(markup.joined(b, p) == urljoin(b, p) for b in bases for p in paths)

    def seen(base, page):
        class P(base):
            def handle_starttag(self, tag, attrs):
                out.append((tag, attrs))

        out = []
        p = P()
        p.feed(page)
        p.close()
        return out

    for page in ("<a href='/x' title=\"y z\">", "<a href=''>", "<a href='&amp;'>", "<a  href='x'>", "<a HREF='x'>", "<a href='x'/>", "<a href='x'title='y'>", "<a href='a>b'>", "<script src='x'><a href='y'>", "<a href='x' href='y'><td class='a b'>", "<a href=x>", "<a href>", "<a data-x='1'>", "<a href='x"):
        assert seen(markup.Parser, page) == seen(HTMLParser, page), page
