"""Substring dedup must not depend on how documents fall into partitions and batches."""

import random

import duckdb
import pandas as pd
import pytest

from lexspark.llm import queries, substring_dedup


def _texts():
    rnd = random.Random(8)
    p, q, r = (" ".join(f"{c}{i}" for i in range(20)) for c in "pqr")
    texts = [p, "x y z " + q, p + " " + q, p + " " + q, r, p + " " + q + " " + r, p, q + " " + p]
    texts += [" ".join(rnd.choices((p, q, r, "some other words"), k=rnd.randint(1, 5))) for _ in range(40)]
    return pd.DataFrame({"doc_id": range(len(texts)), "text": texts})


@pytest.mark.parametrize("partitions", [1, 3])
def test_source_is_the_first_place_of_all_batches(spark, monkeypatch, tmp_path, partitions):
    monkeypatch.setattr(substring_dedup, "TASK_WORDS", 60)
    rows = _texts()
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(partitions, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.register("documents", rows)
    want = con.sql(f"select doc_id, n_words, n_removed, kept_sha256, n_factors from ({queries.ORACLES['op9_substring_dedup']}) order by 1").fetchall()
    got = queries.op9_substring_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want and want[3][4] == 3


def test_factors_are_runs_of_their_source(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "TASK_WORDS", 60)
    w = [f"w{i}" for i in range(14)]
    apart = pd.DataFrame({"doc_id": [100, 101], "text": [" ".join([*w[:13], "x", *w[1:]]), " ".join(w)]})
    rows = pd.concat([_texts(), apart])
    words = {d: t.split() for d, t in zip(rows.doc_id, rows.text)}
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    factors = {r.doc_id: r.factors for r in got}
    for d, found in factors.items():
        for f in found:
            n = f.end - f.start
            assert n >= 13 and f.source < d and words[d][f.start : f.end] == words[f.source][f.source_start : f.source_start + n]
    # words 1-13 and 2-14 stand apart in document 100, so its copy on end in 101 is two factors
    assert [(f.start, f.end, f.source, f.source_start) for f in factors[101]] == [(0, 13, 100, 0), (1, 14, 100, 14)]
