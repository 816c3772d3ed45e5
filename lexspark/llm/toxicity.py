"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters and digits, A-Z lower-cased, hashed to
62 bits); its score is logistic(bias + sum of weights + sum of pairwise products of
factors), so that two terms together can weigh more than each alone.

The machine is fitted on the driver on a bounded sample of labelled rows (at most
``MAX_POSITIVE`` toxic and ``MAX_NEGATIVE`` other ones, taken by a hash of doc_id; the bound
is a parameter and does not grow with the corpus).  Its terms are those in at least
``MIN_TEXTS`` different sampled texts that are associated with the label by themselves
(chi-square of at least ``MIN_CHI2``), or in a pair: each of the two is associated with the
label among the texts that hold the other (``MIN_PAIR_CHI2``, higher as there are far more
pairs), as an insult with a group mention is, neither of which says much alone.  A chi-square
is at most the number of texts, so terms in fewer than ``MIN_PAIR_CHI2`` texts can't be in such
a pair and all others are tested.  So the broadcast model is bounded too, and rare terms of
long clean texts add no noise.  All documents are scored in one narrow pass.

Empty and null texts have no terms and score logistic(bias).  Labels of null are ignored;
without any label, or with one class only, the score is the share of toxic labels (0 if
none).  Repeated rows score alike; a doc_id with several texts is learned by the smallest.
Very long texts are scored whole.  Extra columns are kept, unless named (in any case) like a
result, and are ignored by the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import _text as T

MAX_POSITIVE, MAX_NEGATIVE, MIN_TEXTS, MIN_CHI2, MIN_PAIR_CHI2 = 2000, 4000, 4, 15.0, 45.0
TILE = 512
FACTORS, EPOCHS, RATE, L2 = 4, 25, 0.1, 2e-4


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each text on end, and where each text's start."""
    h, first = T.scan(column, sep=T.NONTERM)
    h = h >> np.uint64(2)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(first)))


def _features(batches):
    for batch in batches:
        for part in T.slices(batch):
            h, first = _terms(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["y", "terms"])


class Machine:
    """terms (sorted), bias, weights w and factors v."""

    def __init__(self, terms, bias, w, v):
        self.terms, self.bias, self.w, self.v = terms, bias, w, v

    def score(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        z = np.full(n, self.bias)
        if len(self.terms) and len(h):
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            hit = self.terms[at] == h
            at, row = at[hit], np.repeat(np.arange(n), np.diff(first))[hit]
            z += np.bincount(row, self.w[at], n)
            for f in range(self.v.shape[1]):
                x = self.v[at, f]
                z += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Machine:
    """Fit on at most max_positive + max_negative labelled rows of docs."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((1, max_positive), (0, max_negative))]
    some = picked[0].union(picked[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # some has a proven bound, so it is broadcast; only sampled texts reach Python
    rows = texts.join(F.broadcast(some), "id")
    got = rows.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text").mapInArrow(_features, "y int, terms binary").toArrow()
    sets = [np.frombuffer(x or b"", np.uint64) for x in got.column("terms").to_pylist()]
    y = np.array(got.column("y").to_pylist(), float)
    return train(sets, y)


def _chi2(a, n, pos, total):
    """Chi-square of a fourfold table: n of total texts hold a term, a of those n and pos of all are toxic."""
    spread = pos * (total - pos) * n * (total - n)
    return np.divide(total * (a * total - n * pos) ** 2, spread, out=np.zeros(np.broadcast(a, spread).shape), where=spread > 0)


def _in_pairs(of: np.ndarray, row: np.ndarray, y: np.ndarray, count: int, least: float) -> np.ndarray:
    """Which of the terms 0 to count stand in a pair whose terms are each associated with the label
    among the texts that hold the other.  Pairs are counted by products of tiles of the text-term
    table, so memory is two tiles' whatever the number of terms."""
    out = np.zeros(count, bool)
    n = np.bincount(of, minlength=count).astype(float)
    a = np.bincount(of, y[row], count)
    order = np.argsort(of, kind="stable")
    of, row = of[order], row[order]

    def tile(k):
        lo, hi = np.searchsorted(of, [k, k + TILE])
        x = np.zeros((len(y), min(TILE, count - k)), np.float32)
        x[row[lo:hi], of[lo:hi] - k] = 1
        return x

    for i in range(0, count, TILE):
        left = tile(i)
        toxic = left[y > 0]
        for j in range(i, count, TILE):
            right = left if i == j else tile(j)
            both, bad = (left.T @ right).astype(float), (toxic.T @ right[y > 0]).astype(float)
            ni, nj, ai, aj = n[i : i + TILE, None], n[None, j : j + TILE], a[i : i + TILE, None], a[None, j : j + TILE]
            ok = (_chi2(bad, both, ai, ni) >= least) & (_chi2(bad, both, aj, nj) >= least)
            out[i : i + TILE] |= ok.any(1)
            out[j : j + TILE] |= ok.any(0)
    return out


def train(sets: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Machine:
    none = np.zeros(0, np.uint64)
    order = sorted(range(len(y)), key=lambda i: (len(sets[i]), sets[i].tobytes(), y[i]))  # the same whatever order rows come in
    order = [i for k, i in enumerate(order) if k == 0 or y[i] != y[order[k - 1]] or sets[i].tobytes() != sets[order[k - 1]].tobytes()]  # copies count once
    sets, y = [sets[i] for i in order], y[order]
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Machine(none, float(np.log((p + 1e-6) / (1 - p + 1e-6))), np.zeros(0), np.zeros((0, FACTORS)))
    terms, of, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(y)), [len(s) for s in sets])
    keep = (n >= MIN_TEXTS) & (_chi2(np.bincount(of, y[row], len(terms)), n.astype(float), y.sum(), float(len(y))) >= MIN_CHI2)
    often = np.flatnonzero(n >= max(MIN_TEXTS, MIN_PAIR_CHI2))
    place = np.full(len(terms), -1)
    place[often] = np.arange(len(often))
    some = place[of] >= 0
    keep[often[_in_pairs(place[of][some], row[some], y, len(often), MIN_PAIR_CHI2)]] = True
    terms = terms[keep]
    idx = []
    for s in sets:
        at = np.minimum(np.searchsorted(terms, s), max(len(terms) - 1, 0))
        idx.append(at[terms[at] == s] if len(terms) else at[:0])
    rng = np.random.default_rng(seed)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    w, v = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS))
    gw, gv, gb = np.full(len(terms), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            rows = shuffled[at : at + 32]
            cat = np.concatenate([idx[i] for i in rows])
            own = np.repeat(np.arange(len(rows)), [len(idx[i]) for i in rows])
            x = v[cat]
            s = np.zeros((len(rows), FACTORS))
            np.add.at(s, own, x)
            sq = np.bincount(own, (x * x).sum(1), len(rows))
            z = bias + np.bincount(own, w[cat], len(rows)) + 0.5 * ((s * s).sum(1) - sq)
            e = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[rows]
            d = e.sum() / len(rows)
            gb += d * d
            bias -= RATE * d / np.sqrt(gb)
            u, inv = np.unique(cat, return_inverse=True)
            dw = np.bincount(inv, e[own], len(u)) / len(rows) + L2 * w[u]
            dv = np.zeros((len(u), FACTORS))
            np.add.at(dv, inv, e[own][:, None] * (s[own] - x))
            dv = dv / len(rows) + L2 * v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= RATE * dv / np.sqrt(gv[u])
    return Machine(terms, bias, w, v)


def score(docs: DataFrame, machine: Machine, prefix: str = "") -> DataFrame:
    """The columns of docs, score and predicted, named with ``prefix``."""
    results = [prefix + x for x in ("score", "predicted")]
    T.lean(docs.sparkSession)
    base = docs.select(*T.columns(docs, results))
    text_at = [c.lower() for c in base.columns].index("text")
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = model.value
        for batch in batches:
            for part in T.slices(batch):
                s = m.score(*_terms(part.column(text_at)))
                yield [*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return T.mapped(base, run, f"`{results[0]}` double, `{results[1]}` int")
