"""Columns of the caller's with names that operators use, nulls, repeated rows and empty tables."""


import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import _text as T
from lexspark.llm import bpe, chat_format, decontaminate, license_scan, lm_score, near_dedup, quality_rules, queries, substring_dedup, token_counts, toxicity

OWN = {"y": "mine", "_id": "mine", "kept": "mine", "score": "mine", "Hits": "mine", "a.b": "mine", "`q`": "mine", "factors": "mine", "n_words": "mine", "contaminated": "mine", "licenses": "mine", "_x": "mine", "id": "mine", "digest": "mine", "c0": "mine", "file": "mine", "held": "mine"}
TEXTS = ["plain words of a text that stands here", None, "", "plain words of a text that stands here", "Released under the MIT License.", "\t\n ", "long " * 4000]
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    base = [(i % 6, t, "en" if i % 2 else None, None if i == 3 else "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, 5), (2, "a repeated id", "en", "s", 13), (2, "a repeated id", "en", "s", 13)]
    return spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in OWN.items()})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (1, None), (4, 0), (None, 1)], "doc_id long, toxic int").withColumn("y", F.lit(1)).withColumn("a.b", F.lit(1))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "an item that is found in no text at all"), (None, "x"), (2, None), (3, " ")], "item_id long, text string").withColumn("digest", F.lit("mine"))


def _operators(labels, bench):
    return {
        "toxicity": (lambda d: toxicity.score(d, toxicity.fit(d, labels)), {"score", "predicted"}),
        "bpe": (lambda d: bpe.encode(d, queries.TOKENIZER), None),
        "near_dedup": (lambda d: near_dedup.near_duplicates(d), None),
        "quality": (lambda d: quality_rules.judge(quality_rules.measures(d)), {*quality_rules.MADE, "kept"}),
        "token_counts": (lambda d: token_counts.counts(d, queries.TOKENIZER, queries.SEPARATOR), None),
        "lm_score": (lambda d: lm_score.score(d, T.held_out(F.col("doc_id"), 10)), None),
        "decontaminate": (lambda d: decontaminate.find(d, bench), set(decontaminate.RESULTS)),
        "substring_dedup": (lambda d: substring_dedup.dedup(d, keep_text=True), set(substring_dedup.RESULTS)),
        "license_scan": (lambda d: license_scan.scan(d), set(license_scan.RESULTS)),
    }


@pytest.mark.parametrize("name", list(_operators(None, None)))
def test_operator(spark, tmp_path, rows, labels, bench, name):
    apply, made = _operators(labels, bench)[name]
    for k, df in enumerate((rows, rows.limit(0))):
        out = apply(df)
        out.write.parquet(f"{tmp_path}/{k}")  # fails on columns whose names are one but for case
        got = spark.read.parquet(f"{tmp_path}/{k}")
        n = df.count() - (name == "near_dedup" and k == 0)  # rows without a doc_id are left out there
        assert got.count() == n
        if made is None:
            continue
        lower = {x.lower() for x in made}
        kept = [c for c in df.columns if c.lower() not in lower]
        assert sorted(got.columns) == sorted([*kept, *made])
        for c in kept:
            if c in OWN:
                assert {r[0] for r in got.select(T.column(c)).collect()} == ({"mine"} if k == 0 else set())


def test_chat(spark):
    df = spark.createDataFrame([(1, 0, "user", "<b"), (1, 0, "user", "Ab"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").withColumns({k: F.lit(v) for k, v in (OWN | {"at": "mine", "start": "mine"}).items()})
    got = chat_format.parse_chats(chat_format.format_chats(df)).first()
    assert [(t.role, t.text) for t in got.turns] == [("user", "<b"), ("user", "Ab"), ("assistant", "")]  # sorted as texts, not as escaped
    assert chat_format.parse_chats(chat_format.format_chats(df.limit(0))).collect() == []


def test_long_conversation(spark):
    df = spark.range(6000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<t"), F.col("id").cast("string")).alias("text"))
    got = chat_format.parse_chats(chat_format.format_chats(df)).first()
    assert len(got.turns) == 6000 and got.learned == "".join(f"<t{i}" for i in range(6000) if i % 3)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, tmp_path, rows, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    for k, df in enumerate((rows, rows.limit(0))):
        run(spark, df, DIR).write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        if stage == corpus_pipeline.STAGES[-1][0]:
            assert got.count() == df.count()
            continue
        assert got.columns == df.columns
        if k == 0:
            assert {r[0] for c in OWN for r in got.select(T.column(c)).collect()} == {"mine"}
            by = sorted(map(str, ((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got.collect())))
            want = sorted(map(str, ((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect() if not (stage == "near_dedup" and r.doc_id == 3))))
            assert by == want


def test_toxic_documents_go(spark, tmp_path):
    """Labelled texts of which a fifth hold insults: those go, held out or not, and no other."""
    import random

    rnd = random.Random(7)
    rows = []
    for i in range(400):
        w = rnd.choices([f"w{k}" for k in range(200)], k=40)
        if i % 5 == 0:
            w += rnd.sample(["idiot", "scum", "moron"], 2)
        rows.append((i, " ".join(rnd.sample(w, len(w))), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    df.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df.drop("toxic").withColumn("score", F.lit(7.0)).withColumn("y", F.lit(None).cast("int"))
    got = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i in range(400) if i % 5} and {r.score for r in got} == {7.0}


def test_shared_folder_is_not_made_up_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError):
        T.shared_dir(type("S", (), {"sparkContext": Context()})())
