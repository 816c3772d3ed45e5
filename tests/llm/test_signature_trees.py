"""The Jaccard join against all pairs, and its parts against what they promise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import _text as T
from lexspark.llm import signature_trees as trees

DIR = "/root/testdata/sf0.001"


def _sets(texts, k):
    out = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        out.setdefault(d, []).append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def _plain(texts, k=4, percent=85):
    """doc_id -> (sizes of its texts, smallest doc_id reachable)."""
    sets = _sets(texts, k)
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    n = len(x & y)
                    if n and 100 * n >= percent * (len(x) + len(y) - n):
                        p, q = root(a), root(b)
                        up[max(p, q)] = min(p, q)
    return {d: (sorted(map(len, sets[d])), root(d)) for d in ids}


def _got(df):
    out = {}
    for r in df.collect():
        sizes, c = out.setdefault(r.doc_id, ([], r.component_id))
        sizes.append(r.n_shingles)
        assert c == r.component_id
    return {d: (sorted(s), c) for d, (s, c) in out.items()}


def _near(rnd, n, words, edits, start=0, name="w"):
    """Copies of one text, each with a few words changed."""
    base = [f"{name}{rnd.randrange(500)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(40)}"
        out.append((start + i, " ".join(w)))
    return out


@pytest.mark.parametrize("docs, shingles, cell", [(trees.CHUNK_DOCS, trees.CHUNK_SHINGLES, trees.CELL), (8, 2_000, 3)])
def test_is_all_pairs(spark, monkeypatch, docs, shingles, cell):
    monkeypatch.setattr(trees, "CHUNK_DOCS", docs)
    monkeypatch.setattr(trees, "CHUNK_SHINGLES", shingles)
    monkeypatch.setattr(trees, "CELL", cell)
    rnd = random.Random(6)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    texts += _near(rnd, 90, 150, 6, 10_000) + _near(rnd, 40, 30, 2, 11_000, "v") + _near(rnd, 30, 9, 1, 12_000, "u") + _near(rnd, 4, 3000, 60, 13_000, "t")
    frame = " ".join(f"f{i}" for i in range(300))  # pages of one frame with words of their own: alike, but not enough
    texts += [(14_000 + i, frame + " " + " ".join(f"own{i}x{j}" for j in range(rnd.choice((20, 60))))) for i in range(40)]
    parts = [" ".join(f"p{k}x{j}" for j in range(25)) for k in range(10)]  # pages put together from shared paragraphs
    texts += [(15_000 + i, " ".join(rnd.sample(parts, 8))) for i in range(60)]
    texts += [(16_000 + i, "a short one" if i % 2 else "A Short  one") for i in range(9)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert _got(trees.similar_sets(df)) == _plain(texts)


def test_odd_tables(spark):
    texts = [(0, ""), (1, None), (2, "one"), (3, " \t\n"), (4, "a b c d e"), (5, "a b c d e"), (6, "word " * 30_000), (7, "word " * 9), (8, "x" * 5000), (8, "A B c d E"), (8, "another text of this document is here"), (9, "another text of this document is here"), (9, "another text of this document is here")]
    schema = "doc_id long, text string, component_id string, id string, `a.b` string"
    df = spark.createDataFrame([(*t, "x", "y", "z") for t in [*texts, (None, "a b c d e")]], schema)
    assert _got(trees.similar_sets(df)) == _plain(texts)
    assert _got(trees.similar_sets(df.limit(0))) == {}
    assert _got(trees.similar_sets(df, k=2, percent=50)) == _plain(texts, 2, 50)


@pytest.mark.parametrize("percent", [50, 80, 85, 95, 100])
def test_similar_sets_share_a_key(percent):
    rng = np.random.default_rng(9)
    for n in [1, 2, 3, 4, 5, 7, 8, 11, 13, 20, 33, 47, 80, 150, 400, 2000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            most = n * 100 // percent - n
            drop = rng.integers(0, n * (100 - percent) // 100 + 1)
            b = np.unique(np.append(a[rng.permutation(n)[: n - drop]], rng.integers(0, 2**63, rng.integers(0, most + 1), dtype=np.uint64)))
            shared = len(np.intersect1d(a, b))
            if shared and 100 * shared >= percent * (len(a) + len(b) - shared) and len(b) and (len(a) != len(b) or (a != b).any()):
                keys, at, cut, need = trees.part_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                own = [[set(keys[at[i] : at[i] + cut[i]].tolist()), set(keys[at[i] + cut[i] : at[i + 1]].tolist())] for i in (0, 1)]
                met = [(len(x & y), need[0][i], need[1][j]) for i, x in enumerate(own[0]) for j, y in enumerate(own[1])]
                assert any(n >= max(1, p, q) for n, p, q in met)


def test_traversal_loses_no_pair():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, int(rng.integers(5, 60)), replace=False)) for _ in range(90)]
    sets += [np.sort(np.append(s[1:], rng.integers(0, 2**63, 1, dtype=np.uint64))) for s in sets[:40]]
    component = np.arange(len(sets)) // 3
    x, order = trees._grown(sets, component, 256)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if component[i] != component[j] and trees._similar(sets[i], sets[j], 85)}
    got = {(max(order[i], order[j]), min(order[i], order[j])) for p, q, _ in trees.traverse(x, x, 85) for i, j in zip(p, q)}
    assert want and want <= got and len(got) < len(sets) ** 2 / 8
    y, other = trees._grown(sets[:17], component[:17], 256)
    got = {(order[i], other[j]) for p, q, _ in trees.traverse(x, y, 85) for i, j in zip(p, q)}
    assert {(i, j) for i in range(len(sets)) for j in range(17) if (i, j) in want or (j, i) in want} <= got


def test_hot_shingles_are_cut(spark, monkeypatch):
    monkeypatch.setattr(trees, "CELL", 5)
    scratch = T.Scratch(spark)
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 20, dtype=np.uint64)
    rows = [(i, i, 22, np.sort(np.append(common, rng.integers(0, 2**63, 2, dtype=np.uint64))).tobytes()) for i in range(60)]
    sets = scratch.save(spark.createDataFrame([(i, s, n, bytearray(b)) for i, s, n, b in rows], "id long, sid long, n long, shingles binary"), "sets")
    rest = sets.select(F.lit(1).cast("long").alias("block"), "id", F.col("id").alias("c"))
    got = {tuple(r) for r in trees._rarest(rest, sets, scratch, 80).collect()}
    scratch.close()
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60)}  # 20 of 24 are shared by all
