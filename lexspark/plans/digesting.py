"""Queries of digests, fingerprints and projections of whole tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text
from lexspark.operators import digests, thesaurus, vectors
from lexspark.plans.catalogue import VECTOR, query

LEVELS = 6


def _tree_sql(name: str, table: str, order: str, fields: str) -> str:
    """CTEs of a table's tree."""
    return _levels_sql(name, f"SELECT row_number() OVER (ORDER BY {order}, h) AS o, 1 AS n, h, row_number() OVER (PARTITION BY {order} ORDER BY h DESC) = 1 AS e FROM (SELECT *, sha256('row/v1' || chr(10) || '{table}' || chr(10) || CAST(to_json({{{fields}}}) AS VARCHAR)) AS h FROM {table})")


def _levels_sql(name: str, rows: str) -> str:
    """CTEs of the tree over rows (o, n, h); as many levels as any table of the tests has, the last one passed on."""
    out = [f"{name}0 AS ({rows})"]
    for k in range(1, LEVELS + 1):
        node = f"sha256('node/v1' || chr(10) || '{k}' || chr(10) || string_agg(h, '' ORDER BY o))"
        out.append(
            f"{name}{k} AS (SELECT max(o) AS o, sum(n) AS n, true AS e, {node if k == 1 else f'CASE WHEN max(c) = 1 THEN min(h) ELSE {node} END'} AS h FROM (SELECT *, count(*) OVER () AS c, "
            f"coalesce(sum(CASE WHEN e AND h LIKE '%00' THEN 1 ELSE 0 END) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {name}{k - 1}) GROUP BY g)"
        )
    return ", ".join(out)


_TABLES = {
    "orders": ("o_orderkey", "'o_custkey': o_custkey, 'o_orderdate': strftime(o_orderdate, '%Y-%m-%d'), 'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'o_totalprice': CAST(round(o_totalprice * 100) AS BIGINT)"),
    "lineitem": ("l_orderkey, l_linenumber", "'l_comment': CASE WHEN l_returnflag = 'R' THEN l_linestatus END, 'l_linenumber': l_linenumber, 'l_orderkey': l_orderkey, 'l_partkey': l_partkey"),
    "nation": ("n_nationkey", "'n_name': n_name, 'n_nationkey': n_nationkey"),
}


@query(
    "orders",
    "lineitem",
    "nation",
    sql=f"""WITH {", ".join(_tree_sql(t[0], t, order, fields) for t, (order, fields) in _TABLES.items())},
t AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, CAST(n AS BIGINT) AS n, sha256('table/v1' || chr(10) || '{t}' || chr(10) || n || chr(10) || h) AS h FROM {t[0]}{LEVELS}" for t in _TABLES)})
SELECT t AS "table", n AS n_rows, h AS hash FROM t UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), sha256('database/v1' || chr(10) || string_agg(t || ' ' || n || ' ' || h, chr(10) ORDER BY t)) FROM t""",
)
def table_digests(orders, lineitem, nation):
    """Digests of three tables and of all together; the same under any partitioning."""
    col = lambda *names: {n: F.col(n) for n in names}
    return digests.database(
        {
            "orders": (orders, ["o_orderkey"], col("o_custkey", "o_orderkey", "o_orderstatus") | {"o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"), "o_totalprice": F.round(F.col("o_totalprice") * 100).cast("long")}),
            "lineitem": (lineitem, ["l_orderkey", "l_linenumber"], col("l_linenumber", "l_orderkey", "l_partkey") | {"l_comment": F.when(F.col("l_returnflag") == "R", F.col("l_linestatus"))}),
            "nation": (nation, ["n_nationkey"], col("n_name", "n_nationkey")),
        }
    )


# -- vectors

_STALE = "CASE WHEN vec_id % 11 = 0 THEN 'content_hash' WHEN label % 5 = 0 THEN 'provider' WHEN vec_id % 23 = 0 THEN 'input_hash' END"
_PROJECTED = f"""v AS (SELECT doc_id, lang, source, sha256(text) AS content_hash, vec_id, vec_id % 17 = 0 AS twice, {_STALE} AS stale, embedding::DOUBLE[] AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm, CASE WHEN vec_id IS NULL THEN 'missing_artifact' WHEN twice THEN 'duplicate_artifact' WHEN stale IS NOT NULL THEN 'stale_artifact' END AS reason FROM v),
p AS (SELECT doc_id AS id, reason, CASE WHEN reason = 'stale_artifact' THEN stale END AS detail, CASE WHEN reason IS NULL THEN sha256(
 CAST(to_json({{'content_hash': content_hash, 'input_hash': sha256(CAST(vec_id AS VARCHAR)), 'lang': lang, 'model': 'm1', 'provider': 'p1', 'source': source, 'version_id': 'v' || doc_id}}) AS VARCHAR)
 || chr(10) || array_to_string(list_transform(e, lambda x: CAST(round(x / norm * 1048576) AS BIGINT)), ',')) END AS fingerprint FROM u)"""


def _projected(documents, embeddings):
    versions = documents.select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("version_id"), F.col("doc_id").alias("article_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "lang", "source")
    k = F.col("vec_id")
    made = embeddings.join(versions, k == F.col("article_id")).select(
        "version_id", "article_id", F.when(k % 11 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("label") % 5 == 0, "p0").otherwise("p1").alias("provider"), F.lit("m1").alias("model"),
        F.size("embedding").alias("dimensions"), F.when(k % 23 == 0, "").otherwise(F.sha2(k.cast("string").cast("binary"), 256)).alias("input_hash"), "embedding", F.explode(F.when(k % 17 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return vectors.projection(versions, made.drop("copy"), ["lang", "source"], "p1", "m1", 64)


@query("documents", "embeddings", sql=f"WITH {_PROJECTED} SELECT id, reason, detail, fingerprint FROM p")
def vector_projection(documents, embeddings):
    """What a vector service should hold: fingerprints, or why a document has none."""
    return _projected(documents, embeddings).select("id", "reason", "detail", "fingerprint")


@query(
    "documents",
    "embeddings",
    sql=f"""WITH {_PROJECTED}, c AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'old' ELSE coalesce(fingerprint, 'gone') END AS was FROM p WHERE id % 7 <> 0 UNION ALL SELECT -id, 'x' FROM p WHERE id % 50 = 1)
SELECT coalesce(p.id, c.id) AS id, CASE WHEN fingerprint IS NULL THEN 'removed' WHEN was IS NULL THEN 'added' WHEN was <> fingerprint THEN 'changed' ELSE 'unchanged' END AS change,
CASE WHEN fingerprint IS NULL THEN coalesce(reason || coalesce(':' || detail, ''), 'unpublished') END AS reason FROM p FULL JOIN c ON p.id = c.id WHERE fingerprint IS NOT NULL OR was IS NOT NULL""",
)
def vector_plan(documents, embeddings):
    """What has to be added, changed and removed at a service that is behind, and why it goes."""
    now = _projected(documents, embeddings)
    k = F.col("id")
    current = now.where(k % 7 != 0).select("id", F.when(k % 13 == 0, "old").otherwise(F.coalesce("fingerprint", F.lit("gone"))).alias("fingerprint"))
    return vectors.plan(current.unionByName(now.where(k % 50 == 1).select((-k).alias("id"), F.lit("x").alias("fingerprint"))), now)


@query(
    "documents",
    "embeddings",
    sql=f"""WITH {_PROJECTED}, {_levels_sql("t", "SELECT row_number() OVER (ORDER BY id) AS o, 1 AS n, sha256(id || chr(10) || fingerprint) AS h, true AS e FROM p WHERE reason IS NULL")}
SELECT CAST(n AS BIGINT) AS records, sha256('table/v1' || chr(10) || 'vectors' || chr(10) || n || chr(10) || h) AS hash, (SELECT count(*) FROM p WHERE reason = 'missing_artifact') AS missing, (SELECT count(*) FROM p WHERE reason = 'stale_artifact') AS stale, (SELECT count(*) FROM p WHERE reason = 'duplicate_artifact') AS duplicate FROM t{LEVELS}""",
)
def vector_manifest(documents, embeddings):
    return vectors.manifest(_projected(documents, embeddings))


@query(
    "embeddings",
    sql=f"""WITH s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], [{", ".join(map(str, VECTOR))}]::DOUBLE[]), 6) AS score FROM embeddings WHERE label % 3 <> 1)
SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 25""",
)
def vector_index_topk(embeddings):
    """The nearest of a filtered set by the inverted-file index: those that a full scan gives."""
    return vectors.VectorIndex(embeddings, "vec_id", "embedding").search(VECTOR, 25, F.col("label") % 3 != 1)[0]


# -- thesaurus

_KEY = "translate(regexp_replace(lower(trim({0}, ' ')), '\\s+', '', 'g'), '._-/#,;:()[]{{}}''\"', '')"


@query(
    "documents",
    "benchmark",
    sql=f"""WITH q AS (SELECT doc_id AS query_id, {_KEY.format("text")} AS t FROM documents), w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
a AS (SELECT item_id AS concept_id, 'c' || item_id AS stable_key, w[2 * i + 1] || ' ' || w[2 * i + 2] AS raw, {_KEY.format("w[2 * i + 1] || ' ' || w[2 * i + 2]")} AS normalized, 5 - i AS kind_rank, CASE WHEN i % 2 = 0 THEN 'de' ELSE 'en' END AS language FROM w, range(0, 5) AS t(i) WHERE len(w) >= 2 * i + 2),
h AS (SELECT query_id, t, concept_id, stable_key, max(CASE WHEN normalized = t THEN 2 ELSE 1 END) AS strength FROM q JOIN a ON normalized = t OR (length(normalized) >= 3 AND contains(t, normalized)) GROUP BY ALL),
c AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, stable_key, concept_id) <= 5),
r AS (SELECT query_id, concept_id, raw, normalized, CAST(row_number() OVER (PARTITION BY query_id, concept_id ORDER BY kind_rank, language, normalized) AS INTEGER) AS alias_rank FROM c JOIN a USING (concept_id) WHERE normalized <> t QUALIFY alias_rank <= 8)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY concept_id, alias_rank) <= 12""",
)
def thesaurus_terms(documents, benchmark):
    """What else to search for with every document as a query, by a thesaurus of the benchmark's words."""
    words, i = F.split("text", " "), F.col("i")
    pair = lambda at: F.get("w", at)
    rows = benchmark.select("item_id", words.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).where(F.size("w") >= 2 * i + 2)
    kind = F.element_at(F.array(*map(F.lit, ("other", *reversed(thesaurus.KINDS)))), i + 1)
    raw = F.concat(pair(2 * i), F.lit(" "), pair(2 * i + 1))
    aliases = rows.select(F.col("item_id").alias("concept_id"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("stable_key"), raw.alias("raw"), text.alias_key(raw).alias("normalized"), kind.alias("kind"), F.when(i % 2 == 0, "de").otherwise("en").alias("language"))
    return thesaurus.alias_terms(documents.select(F.col("doc_id").alias("query_id"), text.alias_key(F.col("text")).alias("normalized")), aliases)
