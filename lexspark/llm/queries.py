"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import _text as T
from lexspark.llm import bpe, centroids, chat_format, conversation_repair, decontaminate, license_scan, lm_score, near_dedup, quality_rules, signature_trees, substring_dedup, token_counts, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SEPARATOR = 50256


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(~T.held_out(F.col("doc_id"), 5))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", T.held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"), TOKENIZER)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), k=2, percent=80)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = T.materialize(quality_rules.measures(docs).drop("text"), "measures")
    return quality_rules.judge(measured).select("doc_id", *quality_rules.MADE, "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_read(spark, sf_dir, "documents"), TOKENIZER, SEPARATOR)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_read(spark, sf_dir, "documents"), T.held_out(F.col("doc_id"), 10))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    back = chat_format.parse_chats(chat_format.format_chats(turns.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.transform("hits", lambda h: h["item"]).alias("item_ids"), F.transform("hits", lambda h: h["score"]).alias("scores"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("factors").cast("long").alias("n_factors"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_blocks", F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))).alias("licenses"), F.size("licenses").cast("long").alias("n_found"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    summary, repaired = conversation_repair.repair(conversation_repair.damaged(turns))
    found = summary.join(conversation_repair.digests(repaired).withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    ids = turns.select(F.col("conv_id").alias("id")).distinct()  # conversations that the damage has left no row of, too
    got = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in conversation_repair.COUNTS]
    return got.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings")).select("vec_id", *centroids.MADE)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_trees.similar_sets(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_near_dedup, op4_quality, op5_token_counts, op6_lm_score, op7_chat_format, op8_decontaminate, op9_substring_dedup, op10_license_scan, op11_conversation_repair, op12_centroid_clusters, op13_jaccard_join)}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_BUCKET = "(CASE WHEN {0} < 16 THEN {0} ELSE (length(bin({0})) - 5) * 16 + CAST(floor({0} / pow(2.0, length(bin({0})) - 5)) AS BIGINT) END)"


def _quality_sql() -> str:
    strip = "coalesce(text, '')"
    for c in quality_rules.SYMBOLS:
        strip = f"replace({strip}, '{c}', '')"
    rate = {
        "symbols": "CAST(floor(n_symbols * 1000 / greatest(word_chars, 1)) AS BIGINT)",
        "repeats": "CAST(floor(n_repeat_words * 1000 / greatest(n_words, 1)) AS BIGINT)",
        "lines": "CAST(floor(n_dup_lines * 1000 / greatest(n_words, 1)) AS BIGINT)",
        "length": "CAST(floor(word_chars * 1000 / greatest(n_words, 1)) AS BIGINT)",
    }
    long = " UNION ALL ".join(f"SELECT l, s, '{m}' AS m, b_{m} AS b FROM bucketed WHERE NOT base_failed" for m in rate)
    fails = " OR ".join(f"coalesce(b_{m} > t_{m}, false)" for m in rate)
    r = quality_rules
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, chr(0)) AS l, coalesce(source, chr(0)) AS s, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
                  length(coalesce(text, '')) - length({strip}) AS n_symbols FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(0, 3) AS t(k) GROUP BY doc_id),
base AS (SELECT doc_id, l, s, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
flagged AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
rated AS (SELECT *, {", ".join(f"{v} AS r_{m}" for m, v in rate.items())} FROM flagged),
bucketed AS (SELECT *, {", ".join(f"{_BUCKET.format(f'r_{m}')} AS b_{m}" for m in rate)} FROM rated),
sketch AS (SELECT l, s, m, b, count(*) AS n FROM ({long}) GROUP BY l, s, m, b),
levels AS (SELECT 0 AS v, l, s, m, b, n FROM sketch UNION ALL SELECT 1, l, '', m, b, sum(n) FROM sketch GROUP BY l, m, b UNION ALL SELECT 2, '', '', m, b, sum(n) FROM sketch GROUP BY m, b),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY v, l, s, m) AS total, coalesce(sum(n) OVER (PARTITION BY v, l, s, m ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under,
           coalesce(sum(n) OVER (PARTITION BY v, l, s, m ORDER BY b RANGE BETWEEN {r.VALLEY} PRECEDING AND 1 PRECEDING), 0) AS near FROM levels),
starts AS (SELECT *, total - under AS above FROM ranked WHERE 100 * (total - under) BETWEEN {r.LEAST_PERCENT} * total AND {r.MOST_PERCENT} * total AND {r.CONTRAST} * (near + 1) <= total - under),
top AS (SELECT * FROM starts QUALIFY row_number() OVER (PARTITION BY v, l, s, m ORDER BY {r.CONTRAST} * near - above, b) = 1),
bottom AS (SELECT v, l, s, m, max(x.b) AS a FROM ranked AS x JOIN top USING (v, l, s, m) WHERE x.b < top.b AND {r.CONTRAST} * (top.under - x.under) > top.above GROUP BY ALL),
t AS (SELECT v, l, s, m, max(total) AS total, max(CAST(floor((a + top.b) / 2) AS BIGINT)) AS t FROM (SELECT DISTINCT v, l, s, m, total FROM ranked) LEFT JOIN top USING (v, l, s, m, total) LEFT JOIN bottom USING (v, l, s, m) GROUP BY ALL),
pick AS (SELECT a.l, a.s, a.m, coalesce(CASE WHEN a.total >= {r.MIN_GROUP} THEN a.t END, CASE WHEN b.total >= {r.MIN_GROUP} THEN b.t END, c.t) AS t
         FROM t AS a JOIN t AS b ON b.v = 1 AND b.l = a.l AND b.m = a.m JOIN t AS c ON c.v = 2 AND c.m = a.m WHERE a.v = 0),
cut AS (SELECT l, s, {", ".join(f"min(t) FILTER (m = '{m}') AS t_{m}" for m in rate)} FROM pick GROUP BY l, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fails}) AS kept
FROM bucketed LEFT JOIN cut USING (l, s)"""


_CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(replace(replace(role, '\\', '\\0'), '<', '\\1')) AS lr, length(replace(replace(text, '\\', '\\0'), '<', '\\1')) AS lt,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(lt + CASE WHEN opens THEN lr + 23 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

_SUBSTRING_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range(0, 13) AS t(k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
place AS (SELECT doc_id, i, m, min(CASE WHEN doc_id = m THEN i END) OVER (PARTITION BY g) AS p FROM (SELECT doc_id, i, g, min(doc_id) OVER (PARTITION BY g) AS m FROM win)),
runs AS (SELECT doc_id, i, m, p, lag(i) OVER w AS pi, lag(m) OVER w AS pm, lag(p) OVER w AS pp FROM place WHERE m < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, count(*) AS n FROM runs WHERE pi IS NULL OR i - pi > 1 OR m <> pm OR p - pp <> 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256, coalesce(f.n, 0) AS n_factors
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN f USING (doc_id)"""

def _repair_sql() -> str:
    add = lambda x, cost, letter, line="''": f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {x}.o || {line}}} END"
    least = lambda *xs: f"list_min(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))"
    said = lambda role: f"chr(10) || '{role}:'"
    own, user, assistant = "(chr(10) || role || ':' || text)", "(chr(10) || 'user:' || text)", "(chr(10) || 'assistant:' || text)"
    drop = lambda x: add(x, 2, "D")
    keep = lambda x, i: f"CASE WHEN NOT must AND i = '{i}' THEN {add(x, 'more', 'K', own)} END"
    change = lambda x, line: f"CASE WHEN NOT must THEN {add(x, '1 + more', 'R', line)} END"
    to_user = [f(x) for x in ("t0", "t1", "t3") for f in (lambda x: keep(x, "u"), lambda x: change(x, user))]
    closed = f"""SELECT *, {least("s3", add("t2", 5, "I", said("assistant")))} AS t3 FROM (SELECT *, s0 AS t0, s1 AS t1, {least("s2", add("s0", 5, "I", said("user")), add("s1", 5, "I", said("user")), add("s3", 5, "I", said("user")))} AS t2 FROM walk)"""
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR))"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"""WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {bits}), 4294967295) % 20 AS f FROM said),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
         FROM crc, range(0, 2) AS t(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
num AS (SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS p FROM hurt JOIN ids ON hurt.conv_id IS NOT DISTINCT FROM ids.conv_id),
mark AS (SELECT *, substr(role, 1, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY p) > 1 AS seen, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unended,
                lag(role) OVER (PARTITION BY g ORDER BY p) AS before FROM num),
fault AS (SELECT *, blank OR seen AS must, CASE WHEN NOT blank AND NOT seen AND unended THEN 5 ELSE 0 END AS more FROM mark),
walk AS (SELECT g, CAST(0 AS BIGINT) AS p, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM ids
       UNION ALL
       SELECT g, p, {drop("t0")}, {least(drop("t1"), keep("t0", "s"))}, {least(drop("t2"), *to_user)}, {least(drop("t3"), keep("t2", "a"), change("t2", assistant))}
       FROM (SELECT c.g, fault.p, t0, t1, t2, t3, role, text, i, must, more FROM ({closed}) AS c JOIN fault ON fault.g = c.g AND fault.p = c.p + 1)),
done AS (SELECT g, {least("t0", "t3")} AS x FROM ({closed}) QUALIFY row_number() OVER (PARTITION BY g ORDER BY p DESC) = 1),
n AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (more > 0) AS truncated,
             count(*) FILTER (before IS NOT NULL AND substr(before, 1, 1) || i NOT IN ('su', 'ua', 'au')) AS illegal FROM fault GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, x.c AS cost, x.a AS audit, sha256(substr(x.o, 2)) AS repaired_sha256
FROM ids JOIN done USING (g) LEFT JOIN n USING (g)"""


def _centroid_sql() -> str:
    near = "CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [
        """kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY k < 16)",
    ]
    for i in range(centroids.ROUNDS + 1):
        parts.append(f"a{i} AS (SELECT r, min({{'d': {near}, 'k': k}}) AS m FROM kept, c{i} GROUP BY r)")
        if i < centroids.ROUNDS:
            parts.append(f"s{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT m.k AS k, i, sum(x[i]) AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, 65) AS t(i) GROUP BY 1, 2) GROUP BY k)")
            parts.append(f"c{i + 1} AS (SELECT o.k, coalesce(s.c, o.c) AS c FROM c{i} AS o LEFT JOIN s{i} AS s ON s.k = o.k)")
    end = f"a{centroids.ROUNDS}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {end} JOIN kept USING (r) JOIN c{centroids.ROUNDS} AS f ON f.k = m.k"""


ORACLES = {"op4_quality": _quality_sql(), "op7_chat_format": _CHAT_SQL, "op9_substring_dedup": _SUBSTRING_SQL, "op11_conversation_repair": _repair_sql(), "op12_centroid_clusters": _centroid_sql()}
