"""Terms that matter only together are learned at default settings; scores are sums over pairs."""

import math
import random

import numpy as np

from lexspark.llm import toxicity


def _scored(m, sets):
    return m.score(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))


def _texts(rnd, n, label):
    """Sets of 20 of 400 ordinary terms, and of terms 1 and 2 each half the time; label(has 1, has 2)."""
    sets, y = [], []
    for _ in range(n):
        one, two = rnd.random() < 0.5, rnd.random() < 0.5
        sets.append(np.array(sorted({*([1] * one), *([2] * two), *rnd.sample(range(10, 410), 20)}), np.uint64))
        y.append(float(label(one, two)))
    return sets, np.array(y)


def test_only_the_pair_tells():
    rnd = random.Random(2)
    sets, y = _texts(rnd, 3000, lambda a, b: a != b)  # neither term alone is associated with the label
    m = toxicity.train(sets, y)
    assert {1, 2} <= set(m.terms.tolist())
    held, z = _texts(rnd, 500, lambda a, b: a != b)
    assert ((_scored(m, held) >= 0.5) == (z > 0)).mean() > 0.95


def test_toxic_only_where_both_meet():
    rnd = random.Random(3)
    sets, y = _texts(rnd, 3000, lambda a, b: a and b)
    m = toxicity.train(sets, y)
    s = _scored(m, [np.array(x, np.uint64) for x in ([1, 2], [1], [2], [10])])
    assert s[0] > 0.5 > max(s[1:])


def test_noise_gives_no_terms():
    rnd = random.Random(4)
    sets, y = _texts(rnd, 3000, lambda a, b: rnd.random() < 0.3)
    assert len(toxicity.train(sets, y).terms) <= 2


def test_tiles_find_the_same_pairs(monkeypatch):
    rnd = random.Random(5)
    sets, y = _texts(rnd, 2000, lambda a, b: a != b)
    whole = toxicity.train(sets, y).terms.tolist()
    monkeypatch.setattr(toxicity, "TILE", 7)
    assert toxicity.train(sets, y).terms.tolist() == whole


def test_score_is_the_sum_over_all_pairs():
    rnd = np.random.default_rng(6)
    m = toxicity.Machine(np.arange(50, dtype=np.uint64), -0.3, rnd.normal(size=50), rnd.normal(size=(50, 4)) * 0.3)
    sets = [np.array(sorted(rnd.choice(60, k, replace=False)), np.uint64) for k in (0, 1, 5, 20)]
    for s, got in zip(sets, _scored(m, sets)):
        t = [int(x) for x in s if x < 50]
        z = m.bias + sum(m.w[i] for i in t) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(t) for j in t[k + 1 :])
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
