"""Language-model scores from a weighted backoff automaton of order 3.

A state is a context of two words, of one word, or the empty one (the root); the start of a
text counts as a word before the first.  A state h has an arc for every word w seen after h in
the training texts, of weight log10((c(h,w) + K p(w|h')) / (c(h) + K)), where h' is h without
its first word, and a failure arc to h', of weight log10(K / (c(h) + K)); the root has arcs of
weight log10 p(w), p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), for every word.  So the arcs that
leave a state, failures followed, sum to 1 (hierarchical Dirichlet smoothing).  A text is
traversed once, left to right: while the state has no arc for the next word, its failure arc
is taken and weighed; then the arc is.

The automaton grows with the corpus, so no task holds all of it.  Texts are written in
batches of about ``BATCH_WORDS`` words, which fixes them whatever executors are lost.  Each batch
names its distinct n-grams, once each, to the reference block of their hash; a block adds up
the training counts of all batches and answers each batch with the counts of its own n-grams.
A batch builds the part of the automaton that its texts can reach and traverses them.  A
frequent word is named once by a batch, so no block is hot, and memory in a task is that of
one batch or of one block, whose number grows with the corpus.

n-grams are told apart by hashes with GUARD_BITS bits more than the corpus's number of tokens
needs (64 at most), so another n-gram has the same one with a chance of 2**-24 at most.  Null texts count as empty and have one token, the
end.  A null doc_id is held out.  Repeated rows are scored (and, if in training, counted) each.
A text longer than a batch is a batch of its own.  Empty tables give empty results; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import _text as T

BATCH_WORDS = 600_000
TASK_TOKENS = 8_000_000  # to a shuffle partition, of BLOCKS reference blocks
BLOCKS = 2
GUARD_BITS = 24
PIECE = 256
KAPPA = (50.0, 20.0)  # of contexts of one word and of two
END, START = np.uint64(0x45_4E_44_5F_54_4F_4B), np.uint64(0x53_54_41_52_54_5F_54)


def _batched(batches):
    """Packed texts in rows of about BATCH_WORDS words: batch, ids, held, texts, tokens of training texts."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["batch", "ids", "held", "texts", "tokens", "train_tokens", "train_texts"]
    ids, held, texts, size, seq = [], [], [], 0, TaskContext.get().partitionId() << 24

    def row():
        out = np.array(held, bool)
        n = np.array(counts, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((seq, ids, held, _pack(texts), int(n.sum()), int(n[~out].sum()), int((~out).sum())), kinds)], names=names)

    counts: list[int] = []
    for batch in batches:
        for part in T.slices(batch):
            _, _, first = T.spans(*T.utf8(part.column(2)))
            many = (np.diff(first) + 1).tolist()
            for i, h, t, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), many):
                if size and size + n > BATCH_WORDS:
                    yield row()
                    ids, held, texts, counts, size, seq = [], [], [], [], 0, seq + 1
                ids.append(i)
                held.append(h)
                texts.append(t or "")
                counts.append(n)
                size += n
    if size:
        yield row()


def _pack(texts: list[str]) -> bytes:
    raw = [t.encode() for t in texts]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw))


def _unpack(data: bytes) -> pa.Array:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n, 8))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw).slice(8 * n + 8))


class Tokens:
    """The tokens of a batch as hashes (each text's words, then the end), the two words before each,
    and the hashes of the 2- and 3-grams that end there, all of so many bits."""

    def __init__(self, texts: pa.Array, bits: int):
        # words are hashed a slice of texts at a time: that takes many times the slice's memory
        parts = [T.scan(x.column(0)) for x in T.slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        h = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.size = np.concatenate([np.diff(x) for _, x in parts]) + 1 if parts else np.zeros(0, np.int64)
        end = np.cumsum(self.size)
        self.w = np.full(int(end[-1]) if len(end) else 0, END)
        inner = np.ones(len(self.w), bool)
        inner[end - 1] = False
        self.w[inner] = h
        self.start = end - self.size
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        before = np.concatenate([[START], self.w[:-1]]) if len(self.w) else self.w
        before[self.start] = START
        earlier = np.concatenate([[START], before[:-1]]) if len(self.w) else self.w
        earlier[self.start] = START
        two = T.mix(self.w * T._BASE + before)
        three = T.mix((two ^ np.uint64(3)) * T._BASE + earlier)
        self.w, self.two, self.three = (x >> np.uint64(64 - bits) for x in (T.mix(self.w), two, three))


def _block(h: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    top = h >> np.uint64(bits - 32)
    return (top * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if k == np.uint64 or not len(x) or x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _widen(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[x[0]]).astype(np.int64)


def _named(bits: int, blocks: int):
    """A batch's distinct n-grams of each order by block, with their counts in its training texts."""

    def run(batches):
        for got in batches:
            for line in range(got.num_rows):
                batch, held, texts = (got.column(k)[line] for k in range(3))
                t = Tokens(_unpack(texts.as_py()), bits)
                train = ~np.array(held.as_py(), bool)[t.row]
                rows = []
                for order, h in enumerate((t.w, t.two, t.three), 1):
                    u, at = np.unique(h, return_inverse=True)
                    c = np.bincount(at, train, len(u)).astype(np.int64)
                    edge = np.searchsorted(_block(u, bits, blocks), np.arange(blocks + 1))
                    rows += [(b, batch.as_py(), order, T.pack_sorted(u[i:j]), _narrow(c[i:j])) for b, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if j > i]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["block", "batch", "n", "grams", "counts"])

    return run


def _answered(batches):
    """Within blocks: the sum of all batches' counts for each batch's n-grams, in its order, and
    (batch -1) how many words have a count."""
    held: dict[tuple, list] = {}
    names = ["block", "batch", "n", "counts", "words"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    for got in batches:
        for b, batch, n, grams, counts in zip(*(c.to_pylist() for c in got.columns)):
            held.setdefault((b, n), []).append((batch, grams, counts))
    for b, n in list(held):
        lines = held.pop((b, n))
        grams = [T.unpack_sorted(g) for _, g, _ in lines]
        u, at = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(at, np.concatenate([_widen(c) for _, _, c in lines]), len(u)).astype(np.int64)
        edge = np.cumsum([0, *map(len, grams)])
        rows = [(b, batch, n, _narrow(total[at[i:j]]), None) for (batch, _, _), i, j in zip(lines, edge[:-1], edge[1:])]
        if n == 1:
            rows.append((b, -1, 1, None, int((total > 0).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class Automaton:
    """The states and arcs that a batch's texts can reach.

    Words are numbered from 0, the start of a text last.  State 0 is the root, 1 + w the
    context of word w, and those after that contexts of two words.  ``arcs`` are sorted keys
    state * words + word, ``weight`` and ``goto`` go with them; every word has an arc at the root.
    """

    def __init__(self, words: int, arcs, weight, goto, fail, failing):
        self.words, self.arcs, self.weight, self.goto, self.fail, self.failing = words, arcs, weight, goto, fail, failing

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and log10 weight of one word read in each of some states."""
        out, total, todo = np.zeros_like(state), np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            key = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            total[todo[hit]] += self.weight[at[hit]]
            out[todo[hit]] = self.goto[at[hit]]
            todo = todo[~hit]
            total[todo] += self.failing[state[todo]]  # no arc: the failure arc is taken
            state = state.copy()
            state[todo] = self.fail[state[todo]]
        return out, total

    def traverse(self, word: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
        """log10 weight of each of some runs of words, read left to right from given states; the
        runs advance together, so that a step is one vector operation."""
        order = np.argsort(start - end, kind="stable")  # the longest first
        start, length, state = start[order], (end - start)[order], state[order]
        total = np.zeros(len(start))
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, "left"))  # runs longer than k
            state[:live], got = self.step(state[:live], word[start[:live] + k])
            total[:live] += got
        out = np.empty_like(total)
        out[order] = total
        return out


def build(t: Tokens, counts: list[np.ndarray], texts: int, n: int, v: int, kappa=KAPPA):
    """The automaton of a batch from the training counts of its distinct n-grams of each order (in the
    order of their hashes), and its tokens as word numbers."""
    total = n + 0.1 * (v + 1)
    u1, first, word = np.unique(t.w, return_index=True, return_inverse=True)
    words = len(u1) + 1
    start = words - 1
    at = np.arange(len(t.w))
    before = np.concatenate([[start], word[:-1]])
    before[t.start] = start
    earlier = np.concatenate([[start], before[:-1]])
    earlier[t.start] = start
    c1 = counts[0].astype(float)
    ctx1 = np.append(c1, texts)  # how often a word, or the start, is a context
    p1 = (c1 + 0.1) / total
    _, f2, of2 = np.unique(t.two, return_index=True, return_inverse=True)
    c2 = counts[1].astype(float)
    p2 = (c2 + kappa[0] * p1[word[f2]]) / (ctx1[before[f2]] + kappa[0])
    _, f3 = np.unique(t.three, return_index=True)
    c3 = counts[2].astype(float)
    # contexts of two words: the 2-grams of the batch, and one of two starts
    pair_of = np.concatenate([of2, [-1]])
    last = np.where(before == start, len(c2), pair_of[np.maximum(at - 1, 0)])
    ctx2 = np.append(c2, texts)
    p3 = (c3 + kappa[1] * p2[of2[f3]]) / (ctx2[last[f3]] + kappa[1])
    pair_state = 1 + words + np.arange(len(c2) + 1)
    # states never seen in training fail at no cost: all their weight goes to the shorter context
    fail = np.concatenate([[0], np.zeros(words, np.int64), 1 + word[f2], [1 + start]])
    failing = np.concatenate([[0.0], np.log10(kappa[0] / (ctx1 + kappa[0])), np.log10(kappa[1] / (ctx2 + kappa[1]))])
    two, three = c2 > 0, c3 > 0
    arcs = np.concatenate([np.arange(len(u1)), (1 + before[f2][two]) * words + word[f2][two], pair_state[last[f3][three]] * words + word[f3][three]])
    weight = np.concatenate([np.log10(p1), np.log10(p2[two]), np.log10(p3[three])])
    # after a word, the state is the context of the two last words if training has it, else of the last
    goto = np.concatenate([1 + np.arange(len(u1)), pair_state[:-1][two], pair_state[of2[f3]][three]])
    order = np.argsort(arcs)
    machine = Automaton(words, arcs[order], weight[order], goto[order], fail, failing)
    return machine, word, before, pair_state[last], two, of2, p1, c1


def _scored(bits: int, n: int, v: int, texts: int, kappa):
    def run(batches):
        for got in batches:
            for line in range(got.num_rows):
                ids, held, texts_of, answers = (got.column(k)[line].as_py() for k in range(4))
                t = Tokens(_unpack(texts_of), bits)
                counts = [np.concatenate([_widen(a["counts"]) for a in sorted((a for a in answers if a["n"] == k), key=lambda a: a["block"])]) for k in (1, 2, 3)]
                machine, word, before, pair, seen, of2, p1, c1 = build(t, counts, texts, n, v, kappa)
                # long texts are read in pieces, each from the state that the two words before it lead to
                cut = np.concatenate([np.arange(s, s + z, PIECE) for s, z in zip(t.start.tolist(), t.size.tolist())])
                end = np.minimum(cut + PIECE, (t.start + t.size)[t.row[cut]])
                inside = (cut - t.start[t.row[cut]]) > 0
                known = ~inside | seen[of2[np.maximum(cut - 1, 0)]]
                got_sum = machine.traverse(word, cut, end, np.where(known, pair[cut], 1 + before[cut]))
                score = np.bincount(t.row[cut], got_sum, len(t.size))
                base = np.add.reduceat(np.log10(p1)[word], t.start)
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(t.size), pa.array(np.add.reduceat((c1 > 0).astype(np.int64)[word], t.start)), pa.array(np.full(k, n)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                pa.default_memory_pool().release_unused()

    return run


def score(docs: DataFrame, held, kappa=KAPPA) -> DataFrame:
    """Score every whole text, learning from the rows where the column ``held`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and
    score (log10 probability under the automaton)."""
    spark = docs.sparkSession
    T.lean(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    kinds = "batch long, ids array<long>, held array<boolean>, texts binary, tokens long, train_tokens long, train_texts long"
    batches = T.materialize(rows.mapInArrow(_batched, kinds), "lm-batches")
    size = batches.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train_tokens", "train_texts"))).first()
    # blocks and tasks follow the size of the corpus, so that a block's size does not
    parts = max(T.fold(spark), math.ceil(size.tokens / TASK_TOKENS))
    bits = min(64, max(40, int(size.tokens).bit_length() + GUARD_BITS))
    named = batches.select("batch", "held", "texts").mapInArrow(_named(bits, BLOCKS * parts), "block int, batch long, n int, grams binary, counts binary")
    answered = named.repartition(parts, "block").mapInArrow(_answered, "block int, batch long, n int, counts binary, words long")
    answered = T.materialize(answered, "lm-counts")
    v = int(answered.agg(F.sum("words")).first()[0] or 0)
    own = answered.where("batch >= 0").groupBy("batch").agg(F.collect_list(F.struct("block", "n", "counts")).alias("answers"))
    joined = batches.join(own, "batch").select("ids", "held", "texts", "answers")
    return joined.mapInArrow(_scored(bits, int(size.train_tokens), v, int(size.train_texts), kappa), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
