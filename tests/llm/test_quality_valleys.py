"""Cutoffs of the quality rules: where a group's own texts show a valley, and nowhere else."""

import random

from pyspark.sql import functions as F

from lexspark.llm import quality_rules as Q


def _docs(spark, groups):
    """groups: (lang, texts, symbols in a thousand characters)"""
    rnd, rows = random.Random(2), []
    for lang, n, symbols in groups:
        for _ in range(n):
            words = [f"{rnd.choice('abcdefghij')}{rnd.randrange(10**8):08}" for _ in range(60)]  # 540 characters, no window twice
            k = round(symbols(rnd) * 540 / 1000)
            rows.append((len(rows), " ".join(words[:-1]) + " " + words[-1][: 9 - min(k, 9)] + "#" * k, lang, "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def _kept(df):
    got = Q.judge(Q.measures(df))
    assert got.where("base_failed").count() == 0
    return got


def test_cutoff_follows_the_group(spark):
    plain, noisy = lambda r: r.choice((0, 0, 4, 6)), lambda r: r.choice((60, 70, 80, 90))
    df = _docs(spark, [("xx", 1150, plain), ("xx", 100, lambda r: 75), ("yy", 1150, noisy), ("yy", 100, lambda r: 700)])
    rows = _kept(df).withColumn("junk", (F.col("doc_id") >= 2400) | F.col("doc_id").between(1150, 1249)).groupBy("lang", "junk").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    # 75 in a thousand is junk in one language and ordinary in the other
    assert {(r.lang, r.junk): r.kept for r in rows} == {("xx", False): 1.0, ("xx", True): 0.0, ("yy", False): 1.0, ("yy", True): 0.0}


def test_no_valley_rejects_nothing(spark):
    df = _docs(spark, [("xx", 1500, lambda r: min(600, r.expovariate(1 / 60)))])
    assert _kept(df).where("not kept").count() == 0


def test_small_groups_take_their_language_and_all(spark):
    some = lambda lang: [(lang, 400, lambda r: 0), (lang, 40, lambda r: 300)]
    df = _docs(spark, [g for lang in ("aa", "bb", "cc") for g in some(lang)])  # 1,320 in all: no language has enough
    assert _kept(df).where("not kept").count() == 120
    few = _docs(spark, [("aa", 40, lambda r: 0), ("aa", 2, lambda r: 300)])  # two texts show no valley
    assert _kept(few).where("not kept").count() == 0
