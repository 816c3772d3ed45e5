"""BM25 retrieval and overlap of every passage and item, against a plain version of the rule."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from lexspark.llm import _text as T
from lexspark.llm import decontaminate as D


def _brute(docs, items):
    words = {k: t.lower().split() for k, t in items.items()}
    n, mean, longest = len(items), sum(map(len, words.values())) / len(items), max(map(len, words.values()))
    df = Counter(w for t in words.values() for w in set(t))
    step, out = max(longest, 8), {}
    for d, text in docs.items():
        w = (text or "").lower().split()
        for at in range(0, len(w) // step * step + 1, step):
            passage = w[at : at + 2 * step]
            have, runs = set(passage), {tuple(passage[i : i + 2]) for i in range(len(passage) - 1)}
            for k, t in words.items():
                tf = Counter(t)
                impact = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * (D.K1 + 1) / (c + D.K1 * (1 - D.B + D.B * len(t) / mean)) for x, c in tf.items()}
                score = sum(v for x, v in impact.items() if x in have) / sum(impact.values())
                if score < D.THRESHOLD - 1e-9:
                    continue
                answer = min(len(t), max(5, len(t) // 4))
                shares = []
                for p in (t[: len(t) - answer], t[len(t) - answer :]):
                    g = [p[0] in have] if len(p) == 1 else [any(0 <= j < len(p) - 1 and tuple(p[j : j + 2]) in runs for j in (i - 1, i)) for i in range(len(p))]
                    if g:
                        shares.append(sum(g) / len(g))
                if min(shares) >= D.OVERLAP:
                    out[d, k] = max(out.get((d, k), (0, 0)), (round(score, 6), round(min(shares), 6)))
    return out


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 60])
def test_every_passage_and_item(spark, block_words):
    rnd = random.Random(4)
    vocabulary = [f"t{i}" for i in range(300)]
    items = {k: " ".join(rnd.choices(vocabulary, k=rnd.randint(3, 40))) for k in range(60)}
    docs = {}
    for d in range(150):
        w = rnd.choices(vocabulary, k=rnd.randint(0, 200))
        if d % 2:
            copy = items[rnd.randrange(60)].split()
            for _ in range(rnd.randint(0, len(copy) // 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            at = rnd.randint(0, len(w))
            w[at:at] = copy
        docs[d] = " ".join(w)
    docs[150], docs[151] = None, docs[1]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = D.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench, block_words=block_words).collect()
    want = _brute(docs, items)
    found = {(r.doc_id, h.item): (h.score, h.overlap) for r in got for h in r.hits}
    assert len(got) == 152 and set(found) == set(want) and 20 < len(want)
    for key, (score, overlap) in want.items():
        assert found[key] == (pytest.approx(score, abs=2e-6), pytest.approx(overlap, abs=2e-6))
    assert all(r.contaminated == bool(r.hits) for r in got)


def test_one_changed_word_in_a_short_answer(spark):
    item = "what is the tall tower in the old town called by sailors the white lamp house"
    bench = spark.createDataFrame([(1, item), (2, "another question about rivers and a long answer that names none")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "filler " * 20 + item.replace("white", "bright") + " filler" * 20)], "doc_id long, text string")
    assert D.find(docs, bench).first().contaminated


@pytest.mark.parametrize("place", range(15))
def test_one_changed_word_at_any_place_of_any_answer(spark, place):
    words = [f"w{i}" for i in range(80)]
    items, docs = [], []
    for n in range(5, 16):  # an answer is the last quarter, at least 5 words
        length = 4 * n if n > 5 else 21
        item = [f"n{n}{x}" for x in words[:length]]
        assert len(D.parts(T.scan(pa.array([" ".join(item)]))[0])[1]) == n
        items.append((n, " ".join(item)))
        item[length - n + place % n] = "changed"
        docs.append((n, "filler " * 30 + " ".join(item) + " filler" * 30))
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all([h.item for h in r.hits] == [r.doc_id] for r in got)


def test_clean_texts_of_the_same_words(spark):
    rnd = random.Random(9)
    items = [(i, " ".join(rnd.choices([f"t{j}" for j in range(60)], k=24))) for i in range(20)]
    shuffled = []
    for i, t in items:
        w = t.split()
        rnd.shuffle(w)
        shuffled.append((i, " ".join(w)))
    docs = spark.createDataFrame(shuffled, "doc_id long, text string")
    assert not any(r.contaminated for r in D.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
