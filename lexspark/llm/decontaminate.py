"""Benchmark decontamination: a BM25 index of test items queried by every training passage.

Spark counts in how many items each term stands, the items' mean length and the longest one,
over all items, so that no score depends on how items are cut into blocks.  A block has about
``BLOCK_WORDS`` words of items; its inverted index (terms, postings of BM25 impacts divided by
the item's own full score, and the largest impact in each run of ``RUN`` items, both as sparse
lists) is built and broadcast, searched, and dropped before the next block's, so one block is
in memory at a time whatever the benchmark's size.

A text is cut into overlapping passages of twice the longest item, so an item that is copied
whole lies within one passage.  Every passage is a query of its distinct terms: the block-max
bounds of its terms are summed, runs whose bound stays under the threshold are skipped as in
WAND, and the rest are scored in full.  All items at or over the threshold are retrieved, with
no cap, and each is confirmed by how much of the item's question and of its answer (its last
quarter, at least 5 words) the passage repeats: the share of the part's words that stand beside
the same word, before or behind, as in the passage. (One rule for all lengths: a changed word costs itself and
at the part's ends its one neighbour, so no single change takes an answer under ``OVERLAP``; a part of
one word is looked for by itself.)

Hits belong to texts, not rows: they come back by the text's digest, by a broadcast join if
few enough, else by a shuffled one whose hot texts AQE splits.  Null and empty texts hold
nothing; items without words or id are ignored; rows of null doc_ids are kept.  Items that
repeat an id and text count once; texts that share an id are items each.  Repeated rows have
the same hits.  Very long texts are many passages.  Extra columns of docs are kept, unless
named (in any case) like a result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import _text as T

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.6
RUN = 8
BLOCK_WORDS = 200_000
BROADCAST_HITS = 200_000
HIT = "struct<item:long,score:double,overlap:double>"
RESULTS = ("contaminated", "hits")


def idf(n: int, df):
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


class Index:
    """Inverted index of one block of items: their ids and texts, the terms of the block (sorted) with
    the number of items of the whole benchmark that hold each, and the benchmark's size and mean length."""

    def __init__(self, ids, texts, terms: np.ndarray, df: np.ndarray, items: int, mean: float, longest: int):
        h, first = T.scan(pa.array(texts, pa.string()))
        size = np.diff(first)
        self.ids, self.longest, self.terms = np.array(ids, np.int64), longest, terms
        n = len(size)
        row = np.repeat(np.arange(n), size)
        pairs, tf = np.unique(np.searchsorted(terms, h) * max(n, 1) + row, return_counts=True)
        term, self.item = pairs // max(n, 1), pairs % max(n, 1)
        length = size / max(mean, 1e-9)
        impact = idf(items, df)[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.item]))
        self.impact = impact / np.bincount(self.item, impact, n)[self.item]
        self.first = np.searchsorted(term, np.arange(len(terms) + 1))
        # the largest impact of each term in each run of items, where there is one
        at = np.flatnonzero(np.diff(term * (n // RUN + 1) + self.item // RUN, prepend=-1))
        self.run, self.bound = self.item[at] // RUN, np.maximum.reduceat(self.impact, at) if len(at) else self.impact
        self.run_first = np.searchsorted(term[at], np.arange(len(terms) + 1))
        self.runs = n // RUN + 1
        self.best = np.maximum.reduceat(self.impact, self.first[:-1]) if len(terms) else self.impact
        self.parts = [parts(h[a:b]) for a, b in zip(first[:-1], first[1:])]

    def search(self, h: np.ndarray, first: np.ndarray, threshold: float, overlap: float):
        """(text row, item, BM25 share, overlap) of confirmed items, the best passage of each."""
        if not len(self.terms) or not len(h):
            return []
        step = max(self.longest, 8)
        size = np.diff(first)
        row = np.repeat(np.arange(len(size)), size)
        t = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        place = np.arange(len(h)) - first[row]
        ok = self.terms[t] == h
        t, chunk, at = t[ok], place[ok] // step, row[ok]
        # a passage is two chunks in a row: each word is in the passages of its chunk and the one before
        base = np.concatenate([[0], np.cumsum(size // step + 1)])
        p = base[at] + chunk
        key = np.unique(np.concatenate([p, (p - 1)[chunk > 0]]) * len(self.terms) + np.concatenate([t, t[chunk > 0]]))
        passage, term = key // len(self.terms), key % len(self.terms)
        at = np.flatnonzero(np.diff(passage, prepend=-1))
        if not len(at):
            return []
        live = np.add.reduceat(self.best[term], at) >= threshold - 1e-9
        end = np.append(at[1:], len(term))
        found: dict[tuple[int, int], tuple[float, float]] = {}
        for a, b in zip(at[live].tolist(), end[live].tolist()):
            own = term[a:b]
            blocks = _lists(self.run_first, own)
            runs = np.bincount(self.run[blocks], self.bound[blocks], self.runs) >= threshold - 1e-9
            if not runs.any():
                continue
            post = _lists(self.first, own)
            post = post[runs[self.item[post] // RUN]]
            score = np.bincount(self.item[post], self.impact[post], len(self.ids))
            hits = np.flatnonzero(score >= threshold - 1e-9)
            if not len(hits):
                continue
            r = int(np.searchsorted(base, passage[a], "right")) - 1
            start = first[r] + (passage[a] - base[r]) * step
            passage_words = h[start : min(start + 2 * step, first[r + 1])]
            pairs = _pairs(passage_words)
            for i in hits.tolist():
                share = min(covered(p, passage_words, pairs) for p in self.parts[i])
                if share >= overlap:
                    old = found.get((r, i), (0.0, 0.0))
                    found[r, i] = max(old, (float(score[i]), float(share)))
        return [(r, i, *v) for (r, i), v in found.items()]


def _lists(first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places first[w] to first[w+1] for w in which, on end."""
    size = first[which + 1] - first[which]
    upto = np.cumsum(size)
    return np.repeat(first[which] - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)


def _pairs(w: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return T.windows(w, np.array([0, len(w)]), 2)[0]


def parts(w: np.ndarray) -> list[np.ndarray]:
    """Question and answer of an item's words."""
    answer = min(len(w), max(5, len(w) // 4))
    return [p for p in (w[: len(w) - answer], w[len(w) - answer :]) if len(p)]


def covered(part: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> float:
    """Share of a part's words that lie in a pair of neighbours which is among ``pairs``."""
    if len(part) == 1:
        return float(np.isin(part, words)[0])
    hit = np.isin(_pairs(part), pairs)
    return float((np.append(hit, False) | np.append(False, hit)).mean())


def _terms(batches):
    """A row for each item and distinct term; the item's number of words goes with the first."""
    for batch in batches:
        h, first = T.scan(batch.column(1))
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pairs = np.unique(np.stack([row.astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
        of = pairs[0].astype(np.int64)
        head = np.diff(of, prepend=-1) != 0
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(pairs[1].view(np.int64)), pa.array(np.where(head, np.diff(first)[of], 0))], names=["block", "term", "words"])


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, block_words: int = BLOCK_WORDS, prefix: str = "") -> DataFrame:
    """The columns of docs, contaminated and hits (array<struct<item,score,overlap>>), named with ``prefix``."""
    spark = docs.sparkSession
    T.lean(spark)
    flag, hits = (prefix + x for x in RESULTS)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").distinct()
    total = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(total[1] / 6 / block_words))
    items = T.materialize(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")), "items")
    terms = T.materialize(items.select("block", "text").mapInArrow(_terms, "block int, term long, words long"), "terms")
    size = terms.agg(F.sum("words"), F.max("words")).first()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    known = T.materialize(terms.select("block", "term").distinct().join(df, "term"), "frequencies")
    digest = F.md5(F.col("text").cast("string").cast("binary"))
    queries = docs.select(digest.alias("digest"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = None
    for k in range(blocks if total[0] else 0):
        own = items.where(F.col("block") == k).orderBy("id", "text").collect()
        rows = known.where(F.col("block") == k).select("term", "df").toArrow()
        term = rows.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term)
        index = Index([x.id for x in own], [x.text for x in own], term[order], rows.column("df").to_numpy()[order], total[0], size[0] / total[0], size[1])
        sent = spark.sparkContext.broadcast(index)
        got = T.materialize(_search(queries, sent, threshold, overlap).distinct(), "hits")
        sent.unpersist()
        found = got if found is None else found.unionByName(got)
    base = docs.select(*T.columns(docs, (flag, hits)))
    none = F.array().cast(f"array<{HIT}>")
    if found is None:
        return base.withColumns({hits: none, flag: F.lit(False)})
    x = T.unused(base)
    per = found.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("item", "score", "overlap"))).alias(f"{x}hits")).withColumnRenamed("digest", f"{x}digest")
    if found.count() <= BROADCAST_HITS:
        per = F.broadcast(per)
    joined = base.join(per, digest == F.col(f"{x}digest"), "left")
    return joined.select(*T.columns(base), F.coalesce(f"{x}hits", none).alias(hits), F.col(f"{x}hits").isNotNull().alias(flag))


def _search(texts: DataFrame, index, threshold: float, overlap: float) -> DataFrame:
    def run(batches):
        ix = index.value
        for batch in batches:
            for part in T.slices(batch):
                found = ix.search(*T.scan(part.column(1)), threshold, overlap)
                r, i, s, o = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r, pa.int64())), pa.array(ix.ids[list(i)], pa.int64()), pa.array([round(x, 6) for x in s], pa.float64()), pa.array([round(x, 6) for x in o], pa.float64())], names=["digest", "item", "score", "overlap"])

    return texts.mapInArrow(run, "digest string, item long, score double, overlap double")
