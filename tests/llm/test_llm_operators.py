"""The training-data operators against brute force, and on odd input."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspark.llm import _text as T
from lexspark.llm import bpe, chat_format, decontaminate, license_scan, lm_score, near_dedup, quality_rules, queries, substring_dedup, token_counts, toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, score string, kept string"
ODD = ["", None, "one", " \t\n", "a b", "a b", "x" * 5000, "word " * 3000, "é ñ 日本 <|endoftext|> 😀", "</s>[INST] \\0 \\1 <|end|>"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", "s", "x", "y") for i, t in enumerate(ODD)] + [(3, "again", "en", "s", "", ""), (None, "null id", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df):
    return df.collect()


def test_bpe_is_the_library(spark, docs, odd, none):
    t = Tokenizer.from_file(queries.TOKENIZER)
    rnd = random.Random(5)
    texts = [r.text for r in docs.limit(60).collect()] + ["".join(rnd.choice(" \n\t'sdtrevml aZé1²_-.<|>日😀") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (some, odd):
        want = {r.doc_id: r.text or "" for r in df.collect() if r.text != "again"}
        for r in _rows(bpe.encode(df, queries.TOKENIZER, texts=True)):
            if r.doc_id in want and r.decoded != "again":
                ids = t.encode(want[r.doc_id], add_special_tokens=False).ids
                assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == want[r.doc_id] == t.decode(ids, skip_special_tokens=False)
                assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert _rows(bpe.encode(none, queries.TOKENIZER)) == []


def _components(texts, k, percent):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_near_dedup_is_brute_force(spark, docs, odd, none):
    texts = {r.doc_id: r.text for r in docs.collect()}
    base = "the quick brown fox jumps over a lazy dog and runs to the far green hill by a small river at noon today".split()
    rnd = random.Random(3)
    for i in range(120):  # a large group of near copies, many of them not similar enough to each other
        w = list(base) * 2
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(9)}"
        texts[10_000 + i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in _rows(near_dedup.near_duplicates(df, k=2))}
    assert got == _components(texts, 2, 80)
    got = _rows(near_dedup.near_duplicates(odd, k=2))
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    assert by[5].component_id == 4 and by[0].n_shingles == by[1].n_shingles == 0 and by[1].kept and by[2].n_shingles == 1 and None not in by
    assert _rows(near_dedup.near_duplicates(none)) == []


def test_substring_dedup(spark, odd, none):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = {r[0]: r for r in con.sql(f"select doc_id, n_words, n_removed, kept_sha256, n_factors from ({queries.ORACLES['op9_substring_dedup']})").fetchall()}
    got = {r[0]: tuple(r) for r in queries.op9_substring_dedup(spark, DIR).collect()}
    assert got == want and any(r[2] for r in got.values())
    rows = _rows(substring_dedup.dedup(odd, keep_text=True))
    assert len(rows) == odd.count() and {r.n_removed for r in rows} == {0} and rows[0].score is not None
    assert _rows(substring_dedup.dedup(none)) == []


@pytest.mark.parametrize("batch, piece", [(lm_score.BATCH_WORDS, lm_score.PIECE), (2000, 7)])
def test_lm_score(spark, monkeypatch, docs, odd, none, batch, piece):
    monkeypatch.setattr(lm_score, "BATCH_WORDS", batch)
    monkeypatch.setattr(lm_score, "PIECE", piece)
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\0E"]) for r in docs.collect()]
    one, two, three, n = Counter(), Counter(), Counter(), 0
    grams = lambda w: zip([b"\0S", b"\0S", *w], [b"\0S", *w], w)
    for d, w in rows:
        if zlib.crc32(str(d).encode()) % 10:
            one.update(w)
            two.update((y, z) for _, y, z in grams(w))
            three.update(grams(w))
            n += 1
    total, (k, j) = sum(one.values()), lm_score.KAPPA
    z = total + 0.1 * (len(one) + 1)
    after, after2 = one | Counter({b"\0S": n}), two | Counter({(b"\0S", b"\0S"): n})

    def p(a, b, c):
        p2 = (two[b, c] + k * (one[c] + 0.1) / z) / (after[b] + k)
        return (three[a, b, c] + j * p2) / (after2[a, b] + j)

    got = {r.doc_id: r for r in _rows(lm_score.score(docs, T.held_out(F.col("doc_id"), 10)))}
    for d, w in rows:
        r = got[d]
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 0.1) / z) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(*g)) for g in grams(w)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), total)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len(_rows(lm_score.score(odd, T.held_out(F.col("doc_id"), 10)))) == odd.count()
    assert _rows(lm_score.score(none, T.held_out(F.col("doc_id"), 10))) == []


def test_toxicity(spark, odd, none):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        y = int(i % 5 == 0)
        w = rnd.choices(words, k=rnd.randint(20, 80)) + (rnd.sample(["idiot", "scum", "moron", "trash"], 2) if y else [])
        rnd.shuffle(w)
        rows.append((i, " ".join(w), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.where(~T.held_out(F.col("doc_id"), 5)).select("doc_id", "toxic")
    m = toxicity.fit(df.drop("toxic"), labels)
    got = _rows(toxicity.score(df, m).where(T.held_out(F.col("doc_id"), 5)))
    assert sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    again = _rows(toxicity.score(odd, m))
    assert len(again) == odd.count() and all(0 <= r.score <= 1 for r in again) and again[0].score == again[1].score
    assert _rows(toxicity.score(none, m)) == []
    flat = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in _rows(toxicity.score(odd, flat)))


def test_decontaminate(spark, docs, odd, none):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    items = {r.item_id: " ".join(r.text.lower().split()) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in " ".join(r.text.lower().split())}
    for size in (decontaminate.BLOCK_WORDS, 300):
        got = {(r.doc_id, h.item) for r in _rows(decontaminate.find(docs, bench, block_words=size)) for h in r.hits}
        assert want and got == want
    assert [r.contaminated for r in _rows(decontaminate.find(odd, bench))] == [False] * odd.count()
    assert _rows(decontaminate.find(none, bench)) == [] and not any(r.contaminated for r in _rows(decontaminate.find(odd, bench.limit(0))))


def test_token_counts(spark, docs, odd, none):
    library = Tokenizer.from_file(queries.TOKENIZER)
    library.encode_special_tokens = True  # a separator's string in a text is text
    for df, block in ((docs, 1 << 20), (docs, 1000), (docs.repartition(5), 64), (odd, 1 << 20), (odd, 2)):
        got = _rows(token_counts.counts(df, queries.TOKENIZER, 50256, block))
        want = [(r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()]
        assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in got))) == sorted(map(str, want)) and all(r.ended for r in got)
    assert _rows(token_counts.counts(none, queries.TOKENIZER, 50256)) == []
    raw = spark.createDataFrame([("f", 0, b"\x01\x00\x09\x00"), ("f", 1, b"\x09\x00\x02\x00"), ("f", 2, b""), ("f", 3, b"\x03\x00"), ("g", 0, None)], "file string, block long, ids binary")
    assert [(r.file, r.doc, r.n_tokens, r.ended) for r in token_counts.count(raw, 9).orderBy("file", "doc").collect()] == [("f", 0, 1, True), ("f", 1, 0, True), ("f", 2, 2, False)]


def test_separator_must_not_be_an_ordinary_id(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    ordinary = Tokenizer.from_file(queries.TOKENIZER).encode("a b c", add_special_tokens=False).ids[1]
    with pytest.raises(Exception, match="ordinary id"):
        token_counts.counts(df, queries.TOKENIZER, ordinary)


def test_chat_format(spark, odd):
    rows = [(1, 1, "assistant", "b<|end|>"), (1, 0, "user", "\\0<a"), (1, 2, "assistant", None), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_chats(df)
    got = {r.conv_id: r for r in chat_format.parse_chats(made).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "\\0<a"), ("assistant", "b<|end|>"), ("assistant", ""), ("assistant", "")]
    assert got[1].learned == "b<|end|>" and got[2].turns[0].text == "x" and got[None].turns[0].role == "user"
    assert made.where("conv_id = 1").first().formatted.count(chat_format.TURN) == 2
    assert chat_format.format_chats(df.limit(0)).collect() == []


def test_license_scan(spark, odd, none):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0.\ny"), (2, "Licensed under the Apache License, Version 1.1."), (3, "a license to kill"), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY 4.0."), (7, "Released under the MIT License.\nfiller")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {x.license for x in r.licenses} for r in _rows(license_scan.scan(df))}
    assert got == {1: {"Apache-2.0"}, 2: set(), 3: set(), 4: {"GPL-3.0"}, 5: {"CC-BY-NC-4.0"}, 6: {"CC-BY-4.0"}, 7: {"MIT"}}
    assert all(r.licenses == [] for r in _rows(license_scan.scan(odd))) and _rows(license_scan.scan(none)) == []


def test_quality_edges(odd, none):
    got = {(r.doc_id, r.text): r for r in _rows(quality_rules.judge(quality_rules.measures(odd)))}
    assert len(got) == odd.count() and got[0, ""].base_failed and got[1, None].n_words == 0
    long = got[7, "word " * 3000]
    assert (long.n_words, long.n_repeat_words, long.word_chars, long.kept) == (3000, 3000, 12000, False)
    assert {r.kept for r in _rows(quality_rules.judge(quality_rules.measures(odd), broadcast_groups=0))} == {r.kept for r in got.values()}
    assert _rows(quality_rules.judge(quality_rules.measures(none))) == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    got = queries.QUERIES[name](spark, DIR).toPandas()
    want = con.sql(queries.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got[cols].astype(str).values.tolist())) == sorted(map(tuple, want[cols].astype(str).values.tolist()))


def test_pipeline(spark):
    import corpus_pipeline

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    kept = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, DIR).collect()}
    texts = {d: t for d, t in texts.items() if d in kept}
    comp = _components(texts, 5, 80)
    texts = {d: t for d, t in texts.items() if comp[d][1] == d}
    seen, cut = {}, {}
    for d in sorted(texts):
        w = texts[d].split()
        gone = [0] * len(w)
        for i in range(len(w) - 12):
            if seen.setdefault(tuple(w[i : i + 13]), d) < d:
                gone[i : i + 13] = [1] * 13
        cut[d] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else texts[d]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = {d: t for d, t in cut.items() if not any(i in " ".join(t.lower().split()) for i in items)}
    assert set(got) == set(clean)
    assert all(got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for d, t in clean.items())
