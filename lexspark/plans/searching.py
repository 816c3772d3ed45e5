"""Queries of the ranked search on the driver's tables, with their oracles.

Documents stand in for articles: a title is a text's first line, and source, case number and
date follow from language and id.  The search index is built once for a table's files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import cases, text
from lexspark.operators import search
from lexspark.plans.catalogue import _BM25, _RRF, TERMS, VECTOR, query

NOW = datetime(2026, 1, 1, 12)
TITLE = "The and attion to thanedble the, anea. Eriner thanea."
_INDEXES: dict[tuple, search.Index] = {}

_SOURCES = {"de": "de-bverfg", "fr": "fr-conseil-constitutionnel", "es": "es-tribunal-constitucional", "en": "us-scotus"}
_ARTICLES = """art AS (SELECT doc_id AS id, text, lang, source, split_part(text, chr(10), 1) AS title,
CASE lang WHEN 'de' THEN 'de-bverfg' WHEN 'fr' THEN 'fr-conseil-constitutionnel' WHEN 'es' THEN 'es-tribunal-constitucional' ELSE 'us-scotus' END AS source_key,
CASE lang WHEN 'de' THEN '1 BvR ' || (doc_id % 20) || '/18' WHEN 'fr' THEN '2020-' || (800 + doc_id % 9) || ' QPC' ELSE '' END AS case_number,
CASE lang WHEN 'de' THEN '1bvr' || (doc_id % 20) || '18' WHEN 'fr' THEN '2020' || (800 + doc_id % 9) || 'qpc' END AS case_key,
CASE WHEN doc_id % 13 <> 0 THEN DATE '2026-01-01' - CAST(doc_id % 400 AS INTEGER) END AS date FROM documents)"""


def articles(documents: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    number = F.when(F.col("lang") == "de", F.concat(F.lit("1 BvR "), i % 20, F.lit("/18"))).when(F.col("lang") == "fr", F.concat(F.lit("2020-"), 800 + i % 9, F.lit(" QPC"))).otherwise("")
    source = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in _SOURCES.items()))
    tag = lambda c: F.struct(F.lower(c).alias("slug"), F.initcap(c).alias("name"))
    got = documents.select(i.alias("id"), "text", "lang", "source", F.substring_index("text", "\n", 1).alias("title"), source.alias("source_key"), number.alias("case_number"), F.when(i % 13 != 0, F.date_sub(F.lit("2026-01-01").cast("date"), (i % 400).cast("int"))).alias("date"), F.array(tag(F.col("source")), tag(F.col("lang"))).alias("tags"))
    return got.withColumn("case_key", cases.case_key(F.col("source_key"), F.col("case_number")))


def index_of(documents: DataFrame) -> search.Index:
    """The index of a table's files, built when they are first asked for or have changed."""
    seen = F.xxhash64("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    state = documents.select(seen.alias("h")).agg(F.count("*"), F.min("h"), F.max("h"), F.sum(F.col("h") % 1000003)).first()
    key = (documents.sparkSession.sparkContext.applicationId, *state)
    if key not in _INDEXES:
        a = articles(documents)
        _INDEXES[key] = search.Index.build(a, "id", {"title": F.col("title"), "case_numbers": F.col("case_number"), "search_text": F.col("text"), "tags": F.concat_ws(" ", "source", "lang")})
    return _INDEXES[key]


def _bm25(documents, terms=TERMS):
    return index_of(documents).bm25(list(terms), {"search_text": 1.0}).withColumnRenamed("id", "doc_id")


@query("documents", sql=f"WITH {_BM25} SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def bm25_topk(documents):
    return search.ranked(_bm25(documents), "doc_id", 50)


@query(
    "documents",
    sql="""SELECT doc_id FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)
WHERE ((list_contains(t, 'the') AND list_contains(t, 'of')) OR contains(' ' || array_to_string(t, ' ') || ' ', ' de la ')) AND NOT list_contains(t, 'worthless')""",
)
def websearch_filter(documents):
    q = search.compile_query('the of or "de la" -worthless')
    return index_of(documents).matching(q).withColumnRenamed("id", "doc_id")


@query("documents", "embeddings", sql=f"WITH {_RRF} SELECT doc_id, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(semantic_rank, 0) AS semantic_rank, score FROM fused ORDER BY score DESC, doc_id LIMIT 20")
def hybrid_rrf(documents, embeddings):
    n = search.candidate_limit(0, 20)
    lexical = search.ranked(_bm25(documents), "doc_id", n)
    near = search.semantic(embeddings.withColumnRenamed("vec_id", "doc_id").join(documents.select("doc_id"), "doc_id", "left_semi"), "doc_id", "embedding", VECTOR)
    return search.rrf(lexical, search.ranked(near, "doc_id", n), "doc_id").orderBy(F.desc("score"), "doc_id").limit(20).fillna(0, ["lexical_rank", "semantic_rank"])


@query(
    "documents",
    sql=f"""WITH {_BM25}, top AS (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 250), w AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS INTEGER) AS group_rank FROM top)
SELECT doc_id, lang, group_rank, round(CASE WHEN group_rank > 2 THEN score * 0.92::DOUBLE ELSE score END, 6) AS score FROM w""",
)
def diversity_rerank(documents):
    top = _bm25(documents).orderBy(F.desc("score"), "doc_id").limit(250)
    return search.diversity(top.join(documents.select("doc_id", "lang"), "doc_id"), "doc_id", "lang").withColumn("score", F.round("score", 6))


# -- ranked pages


def _fields_sql(terms: list[str], name: str = "ft") -> str:
    """Documents that hold all terms, and the score of all fields with their weights."""
    fields = {"title": "title", "case_numbers": "case_number", "search_text": "text", "tags": "source || ' ' || lang"}
    toks = ", ".join(f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+') AS t_{f}" for f, c in fields.items())
    tf = lambda t: " + ".join(f"{w} * len(list_filter(t_{f}, lambda x: x = '{t}'))" for f, w in search.WEIGHTS.items())
    tfs = ", ".join(f"({tf(t)})::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(terms)))
    all_ = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{name}_t AS (SELECT id, {toks} FROM art), {name}_b AS (SELECT id, {" + ".join(f"len(t_{f})" for f in fields)} AS dl, {tfs} FROM {name}_t),
{name}_s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {dfs} FROM {name}_b), {name} AS (SELECT id, round({score}, 6) AS score FROM {name}_b, {name}_s WHERE {all_})"""


_TITLE_TERMS = ["the", "and", "attion", "to", "thanedble", "anea", "eriner", "thanea"]
_FOLD = f"lower(trim(regexp_replace(title, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) = '{TITLE.lower()}'"
_LEX = f"lx AS (SELECT art.id, date, {_FOLD} AS exact, score FROM art JOIN ft USING (id))"
_WHOLE = "exact DESC, score DESC, date DESC NULLS LAST, id"


@query("documents", sql=f"WITH {_ARTICLES}, {_fields_sql(_TITLE_TERMS)}, {_LEX} SELECT id, exact, score, CAST(row_number() OVER (ORDER BY {_WHOLE}) AS INTEGER) AS rank FROM lx QUALIFY rank <= 21")
def fulltext_page(documents):
    """Exact titles first, though longer texts may score higher; one row more than the page."""
    page = search.search_page(articles(documents), index_of(documents), None, TITLE, "fulltext", weights=search.WEIGHTS)
    return page.entries.select("id", "exact", "score", "rank")


@query("documents", "embeddings", sql=f"""WITH {_ARTICLES}, {_fields_sql(_TITLE_TERMS)}, {_LEX}, cs AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], [{", ".join(map(str, VECTOR))}]::DOUBLE[]), 6) AS score FROM embeddings WHERE vec_id IN (SELECT id FROM art)),
a AS (SELECT id, row_number() OVER (ORDER BY {_WHOLE}) AS r FROM lx QUALIFY r <= 100), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM cs QUALIFY r <= 100),
f AS (SELECT id, round(coalesce(1::DOUBLE / (60 + a.r), 0) + coalesce(1::DOUBLE / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b USING (id)), w AS (SELECT f.id, f.score, date, {_FOLD} AS exact FROM f JOIN art USING (id))
SELECT id, score, CAST(row_number() OVER (ORDER BY {_WHOLE}) AS INTEGER) AS rank FROM w QUALIFY rank <= 21""")
def hybrid_page(documents, embeddings):
    page = search.search_page(articles(documents), index_of(documents), embeddings.withColumnRenamed("vec_id", "id"), TITLE, "hybrid", VECTOR, weights=search.WEIGHTS)
    return page.entries.select("id", "score", "rank")


def _summary_sql(name: str, mode: str, where: str, order: str, limit: int, offset: int, total: bool, source: str = "art") -> str:
    """One request's summary: ids joined, mode, total, whether more follow, whether the total is exact."""
    n = f"(SELECT count(*) FROM {source} WHERE {where})"
    seen = f"least({limit + 1}, greatest({n} - {offset}, 0))"
    ids = f"(SELECT coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY r), '') FROM (SELECT id, row_number() OVER (ORDER BY {order}) AS r FROM {source} WHERE {where}) WHERE r > {offset} AND r <= {offset + limit})"
    return f"SELECT '{name}' AS request, {ids} AS ids, '{mode}' AS mode, CAST({n if total else seen} AS BIGINT) AS total, {seen} > {limit} AS has_more, {str(total).lower()} AS total_is_exact"


_DATE = "date DESC NULLS LAST, id"
_REQUESTS = [
    ("case", dict(query="What of 1  BvR 7/2018?"), "exact-case", "source_key = 'de-bverfg' AND case_key = '1bvr718'", _DATE),
    ("case of another source", dict(query="1 BvR 7/18", filters={"source_key": "us-scotus"}), "exact-case", "false", _DATE),
    ("case under a name", dict(query="der Klimabeschluss"), "exact-case", "case_key = '1bvr265618'", _DATE),
    ("case with a filter", dict(query="2020-803 QPC", filters={"lang": "fr", "source": "src3"}), "exact-case", "case_key = '2020803qpc' AND source = 'src3'", _DATE),
    ("latest", dict(query=" ", limit=5), "latest", "true", _DATE),
    ("latest of a week", dict(query="", period="week"), "latest", "date >= DATE '2025-12-25'", _DATE),
    ("latest of a tag", dict(query="", tag="src2", limit=3, offset=4), "latest", "source = 'src2'", _DATE),
    ("latest of a named tag", dict(query="", tag="Fr", limit=3), "latest", "lang = 'fr'", _DATE),
    ("latest of no tag", dict(query="", tag="none"), "latest", "false", _DATE),
    ("fulltext", dict(query=TITLE, mode="fulltext", limit=4, offset=2), "fulltext", "true", _WHOLE),
]


@query("documents", sql=f"WITH {_ARTICLES}, {_fields_sql(_TITLE_TERMS)}, {_LEX} " + " UNION ALL ".join(_summary_sql(name, mode, where, order, ask.get("limit", 20), ask.get("offset", 0), True, "lx" if mode == "fulltext" else "art") for name, ask, mode, where, order in _REQUESTS))
def page_summaries(documents):
    """Ids, retrieval mode, exact total and whether more follow, for requests of every kind."""
    a, out = articles(documents), None
    for name, ask, *_ in _REQUESTS:
        page = search.search_page(a, index_of(documents) if ask.get("mode") else None, None, now=NOW, weights=search.WEIGHTS, **ask)
        row = page.summary("exact").select(F.lit(name).alias("request"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "mode", "total", "has_more", "total_is_exact")
        out = row if out is None else out.unionByName(row)
    return out


@query("documents", sql=f"WITH {_ARTICLES} {_summary_sql('bound', 'latest', 'true', _DATE, 7, 10, False)}")
def page_without_count(documents):
    """Without a count the total is what was seen."""
    page = search.search_page(articles(documents), None, None, "", limit=7, offset=10, now=NOW)
    return page.summary().select(F.lit("bound").alias("request"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "mode", "total", "has_more", "total_is_exact")


@query(
    "documents",
    sql=f"""WITH {_ARTICLES}, p AS (SELECT id, [i - 1 for i in range(1, len(t) + 1) if t[i] = 'the'] AS a, [i - 1 for i in range(1, len(t) + 1) if t[i] = 'of'] AS b FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM art)),
e AS (SELECT id, a, b, unnest(list_sort(list_distinct(list_concat(a, b)))) AS e FROM p WHERE len(a) > 0 AND len(b) > 0),
c AS (SELECT id, e, least(coalesce(list_max(list_filter(a, lambda x: x <= e)), -1), coalesce(list_max(list_filter(b, lambda x: x <= e)), -1)) AS s FROM e),
m AS (SELECT id, e, s, lag(s) OVER (PARTITION BY id ORDER BY e) AS before FROM c)
SELECT id, round(r / (r + 1), 6) AS score FROM (SELECT id, sum(0.4::DOUBLE / (e - s + 1)) AS r FROM m WHERE s >= 0 AND (before IS NULL OR before < s) GROUP BY id)""",
)
def cover_density(documents):
    """Documents by how close together two words stand."""
    return index_of(documents).cover_density(search.compile_query("the of"), {"search_text": 0.4})


@query("documents", sql=f"WITH {_ARTICLES} SELECT id, lower(trim(regexp_replace(title, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS title, {_FOLD} AS exact FROM art WHERE {_FOLD} OR starts_with(lower(title), 'the ')")
def nfkc_title_match(documents):
    """Whole titles, folded, that are the query or begin alike."""
    folded = F.lower(text.collapse(text.nfkc(F.col("title"))))
    got = articles(documents).select("id", folded.alias("title"), search.exact_title(F.col("title"), " the AND attion to thanedble the,  anea. Eriner thanea. ").alias("exact"))
    return got.where(F.col("exact") | F.col("title").startswith("the "))


@query("documents", sql=f"WITH {_ARTICLES} SELECT id, source = 'src4' AS by_name, lang = 'fr' AS encoded, case_number = '1 BvR 3/18' AS by_line FROM art")
def tag_filters(documents):
    """Tags by slug or name, tags of an encoded column, and a line of a text of lines."""
    lines = F.concat_ws("\n", F.lit("x"), "case_number", F.concat(F.col("case_number"), F.lit("9")))
    return articles(documents).select("id", search.has_tag(F.col("tags"), "Src4").alias("by_name"), search.has_encoded_tag(search.encode_tags(F.col("tags")), "fr").alias("encoded"), search.has_line(lines, "1 BvR 3/18").alias("by_line"))


@query(
    "documents",
    sql=f"""WITH {_ARTICLES}, r AS (SELECT id, floor(length(text) / 1000) AS score, coalesce(date, DATE '0001-01-01') AS date FROM art), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, date DESC, id) AS n FROM r)
SELECT id, CAST(n AS INTEGER) AS n FROM o WHERE n <= 40""",
)
def catalogue_pages(documents):
    """Four pages of ten behind each other's cursors."""
    ranked = articles(documents).select("id", F.floor(F.char_length("text") / 1000).cast("double").alias("score"), F.coalesce("date", F.lit("0001-01-01").cast("date")).alias("date"))
    mark, cursor, out = search.request_fingerprint("text", "v2", source="a"), None, None
    for k in range(4):
        page, cursor = search.catalogue_page(ranked, cursor, mark, 10)
        rows = page.withColumn("k", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("n", F.row_number().over(Window.orderBy("k", F.desc("score"), F.desc("date"), "id"))).select("id", "n")


_ALIASES = [(1, "the of"), (1, "de la"), (2, "que de"), (3, "unknown words that no text has")]


@query(
    "documents",
    sql=f"""WITH {_ARTICLES}, {_fields_sql(["the", "of"], "f0")}, {_fields_sql(["de", "la"], "f1")}, {_fields_sql(["que", "de"], "f2")},
o AS (SELECT id, row_number() OVER (ORDER BY score DESC, date DESC NULLS LAST, id) AS rank FROM f0 JOIN art USING (id) QUALIFY rank <= 50),
h AS (SELECT id, a, row_number() OVER (PARTITION BY a ORDER BY score DESC, date DESC NULLS LAST, id) AS rank FROM (SELECT *, 0 AS a FROM f0 UNION ALL SELECT *, 1 FROM f1 UNION ALL SELECT *, 2 FROM f2) JOIN art USING (id) QUALIFY rank <= 50),
s AS (SELECT id, 2::DOUBLE / (60 + rank) AS s FROM o UNION ALL SELECT id, max(1::DOUBLE / (60 + rank)) FROM h GROUP BY id),
f AS (SELECT id, lang, coalesce(date, DATE '0001-01-01') AS date, sum(s) AS score FROM s JOIN art USING (id) GROUP BY ALL ORDER BY score DESC, date DESC, id LIMIT 250),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, date DESC, id) AS INTEGER) AS group_rank FROM f)
SELECT id, lang, group_rank, round(CASE WHEN group_rank > 2 THEN score * 0.92::DOUBLE ELSE score END, 9) AS score FROM w""",
)
def multilingual_rrf(documents):
    """A query and the aliases of the concepts that it names, fused and spread over languages."""
    a, index = articles(documents), index_of(documents)
    thesaurus = documents.sparkSession.createDataFrame(_ALIASES, "concept_id long, alias string")
    named = search.alias_terms(thesaurus, "The of, or: que de").collect()  # at most twelve
    hits = search.alias_hits(index, [r.alias for r in named], a, weights=search.WEIGHTS)
    original = search.alias_hits(index, ["the of"], a, weights=search.WEIGHTS)
    return search.catalogue_rrf(original, hits, a, "lang").select("id", "lang", "group_rank", "score")


_BARE = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


@query(
    "documents",
    sql=f"""WITH {_ARTICLES}, d AS (SELECT id, {_BARE.format("title")} AS t, {_BARE.format("text")} AS b, {_BARE.format("case_number")} AS c FROM art)
SELECT id, score FROM (SELECT id, CAST((c <> '' AND contains('1bvr718theof', c))::INT * 1000 + (t = '1bvr718theof')::INT * 500 + contains(t, '1bvr718theof')::INT * 180 + (contains(t, 'bvr') AND contains(t, '18') AND contains(t, 'the') AND contains(t, 'of'))::INT * 120
+ {" + ".join(f"contains(t, '{w}')::INT * 24 + contains(b, '{w}')::INT * 6" for w in ("bvr", "18", "the", "of"))} AS INTEGER) AS score FROM d) WHERE score > 6""",
)
def legal_score(documents):
    """The case number is looked for in the query, and all terms in the title."""
    score = search.legal_score([F.col("title")], F.col("case_number"), F.col("text"), "판례 1 BvR 7/18 the of")
    scored = articles(documents).select("id", score.cast("int").alias("score"))
    return scored.select("id", F.explode(F.filter(F.array("score"), lambda s: s > 6)).alias("score"))  # a filter would score all again


@query(
    "nation",
    sql="""WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN '1bvr' || n_nationkey || '15' END AS de, '2020' || (800 + n_nationkey) || 'qpc' AS fr FROM nation)
SELECT k AS n_nationkey, concat_ws(',', CASE WHEN de IS NOT NULL THEN 'de-bverfg:' || de END, CASE WHEN k = 4 THEN 'de-bverfg:1bvr265618' END, 'fr-conseil-constitutionnel:' || fr, CASE WHEN de IS NOT NULL THEN 'es-tribunal-constitucional:' || k || '2015' END, 'us-scotus:' || (20 + k) || (k * 3 + 10)) AS refs, coalesce(de, 'none') AS key FROM n""",
)
def exact_case_refs(nation):
    """Case numbers of four courts in one text; zeros before numbers and long years fall away."""
    k = F.col("n_nationkey")
    german = F.when(k % 2 == 0, F.concat(F.lit(" and 1  BvR 00"), k, F.lit(" / 2015, again 1 BVR "), k, F.lit("/15"))).otherwise("")
    said = F.concat(F.lit("See 2020-"), 800 + k, F.lit(" qpc"), german, F.lit("; No. 0"), 20 + k, F.lit("-000"), 3 * k + 10, F.when(k == 4, " (Klimabeschluss)").otherwise(""))
    refs = F.array_join(F.transform(cases.references(said), lambda x: F.concat_ws(":", x["source"], x["key"])), ",")
    return nation.select("n_nationkey", refs.alias("refs"), F.coalesce(cases.case_key(F.lit("de-bverfg"), said), F.lit("none")).alias("key"))

