"""Substring dedup by relative Lempel-Ziv parsing against an index of the whole corpus.

Every document is parsed against every earlier document (smaller doc_id).  The reference
is cut into blocks by ranges of window fingerprints; a block's index holds, for each
13-word window that falls into it, the first place of the corpus where it starts: the smallest
document and the first word in it.  All blocks are asked for every window (one shuffle of
fingerprints, packed in sorted binary lists and already reduced to one row per batch and
window; the other documents of the batch that have the window wait for the answer to its
first).  The greedy parse of a document begins a factor at the first window that an earlier
document has, and extends it word by word while the source goes on: while the next window's
first place is the next word of the same document.  Where it does not, the factor ends and
the next window is looked up afresh, so windows across factor boundaries are checked and not
assumed.  A factor is thus a run of words of its source, at least 13 long; words in factors go.

Windows are told apart by 64-bit hashes.  Null texts have no words; a document of under 13
words keeps all.  Rows that repeat a doc_id are one document with several texts: a window
counts as a copy only if a smaller doc_id has it, and a place is counted within its row.  Rows
of a null doc_id are kept whole.  Very long texts are cut nowhere.  Empty tables give empty
results; extra columns are kept, unless named (in any case) like a result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import _text as T

WINDOW = 13
BLOCKS = 2  # reference blocks to a partition
TASK_WORDS = 1_000_000
TASK_BYTES = 64_000_000  # of text to a shuffle partition
NAMES = ["block", "batch", "fp", "owner", "source", "place"]
KINDS = "block int, batch long, fp binary, owner binary, source binary, place binary"
RESULTS = ("n_words", "n_removed", "kept_sha256", "factors")


def _rows(rows) -> pa.RecordBatch:
    """Lines of KINDS: block, batch and packed lists."""
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=NAMES)


def _fingerprints(n: int, blocks: int):
    """Packed lists of (window, first document of the batch, its place there) by reference block; what
    other documents of the batch have those windows is kept apart (block -1)."""

    def emit(batch, h, owner, place):
        order = np.lexsort((place, owner, h))
        h, owner, place = h[order], owner[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = owner != owner[at]
        late[1:] &= (owner[1:] != owner[:-1]) | new[1:]  # once for a document
        u, first, where = h[new], owner[new], place[new]
        rows = [(int(b), batch, T.pack_sorted(u[i:j]), T.pack_ids(first[i:j]), None, T.pack_places(where[i:j])) for b, i, j in _ranges(u, blocks)]
        if late.any():
            rows.append((-1, batch, T.pack_sorted(h[late]), T.pack_ids(owner[late]), T.pack_ids(owner[at][late]), T.pack_places(place[at][late])))
        yield _rows(rows)

    def run(batches):
        held, size, seq = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in T.slices(batch):
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                h, row = T.windows(*T.scan(part.column(1), lower=False), n)
                place = np.arange(len(row)) - np.searchsorted(row, row)
                held.append((h, ids[row], place))
                size += len(h)
                if size >= TASK_WORDS:
                    yield from emit(seq, *map(np.concatenate, zip(*held)))
                    held, size, seq = [], 0, seq + 1
        if size:
            yield from emit(seq, *map(np.concatenate, zip(*held)))

    return run


def _ranges(sorted_h: np.ndarray, blocks: int):
    edge = np.searchsorted(sorted_h, (np.arange(1, blocks, dtype=np.uint64) * np.uint64(2**64 // blocks)))
    edge = [0, *edge.tolist(), len(sorted_h)]
    return [(b, edge[b], edge[b + 1]) for b in range(blocks) if edge[b + 1] > edge[b]]


def _lookup(batches):
    """Within reference blocks: which of a batch's windows a smaller document of another batch
    has, and where first.  Lists that ask for nothing (block -1) pass through."""
    held: dict[int, list] = {}
    answers: dict[int, list] = {}
    for got in batches:
        for row in range(got.num_rows):
            b = got.column(0)[row].as_py()
            if b < 0:
                yield pa.RecordBatch.from_arrays([got.column(k).slice(row, 1) for k in range(len(NAMES))], names=NAMES)
            else:
                held.setdefault(b, []).append([got.column(k)[row].as_py() for k in (1, 2, 3, 5)])
    for b in list(held):
        lists = held.pop(b)
        h, owner, place = (np.concatenate([f(x[k]) for x in lists]) for k, f in ((1, T.unpack_sorted), (2, T.unpack_ids), (3, T.unpack_places)))
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] ^ np.uint64(1)))
        many = np.diff(np.append(at, len(h)))
        first, where = np.empty_like(owner), np.empty_like(place)
        first[order] = np.repeat(np.minimum.reduceat(owner[order], at), many)
        own = np.where(owner == first, place, np.iinfo(np.int64).max)
        where[order] = np.repeat(np.minimum.reduceat(own[order], at), many)
        late = owner != first
        edge = np.cumsum([0, *(len(T.unpack_ids(x[2])) for x in lists)])
        for (batch, *_), i, j in zip(lists, edge[:-1], edge[1:]):
            if late[i:j].any():
                answers.setdefault(batch, []).append([x[i:j][late[i:j]] for x in (h, owner, first, where)])
    for batch in list(answers):
        h, owner, source, place = map(np.concatenate, zip(*answers.pop(batch)))
        order = np.argsort(h)
        yield _rows([(0, batch, T.pack_sorted(h[order]), T.pack_ids(owner[order]), T.pack_ids(source[order]), T.pack_places(place[order]))])


def _unpacked(packed: list) -> list[np.ndarray]:
    return [f(x) for f, x in zip((T.unpack_sorted, T.unpack_ids, T.unpack_ids, T.unpack_places), packed)]


def _settle(buckets: int):
    """Within batches: the blocks' answers, and the same for the batch's other documents that have
    those windows.  Answers are packed by bucket of their document."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for got in batches:
            for b, batch, *packed in zip(*(c.to_pylist() for c in got.columns)):
                held.setdefault(batch, ([], []))[int(b < 0)].append(packed)
        answers = []
        for batch in list(held):
            asked, rest = ([_unpacked(p) for p in x] for x in held.pop(batch))
            answers += asked
            if asked and rest:  # a window is asked for once in a batch
                known, _, first, where = map(np.concatenate, zip(*asked))
                order = np.argsort(known)
                known, first, where = known[order], first[order], where[order]
                for k, (h, owner, source, place) in enumerate(rest):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                    rest[k] = h, owner, np.where(hit, first[at], source), np.where(hit, where[at], place)
            answers += rest
        if answers:
            h, owner, source, place = map(np.concatenate, zip(*answers))
            bucket = T.mix(owner.astype(np.uint64)) % np.uint64(buckets)
            order = np.lexsort((h, bucket))
            h, owner, source, place, bucket = (x[order] for x in (h, owner, source, place, bucket))
            edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edge)).tolist():
                i, j = edge[b], edge[b + 1]
                yield _rows([(b, 0, T.pack_sorted(h[i:j]), T.pack_ids(owner[i:j]), T.pack_ids(source[i:j]), T.pack_places(place[i:j]))])

    return run


def _by_document(batches):
    """Of the answers of one bucket: a row for each document."""
    held: dict[int, list] = {}
    for batch in batches:
        for b, _, *packed in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(b, []).append(packed)
    for b in list(held):
        h, owner, source, place = map(np.concatenate, zip(*map(_unpacked, held.pop(b))))
        order = np.lexsort((h, owner))
        h, owner, source, place = (x[order] for x in (h, owner, source, place))
        at = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1)) if len(owner) else np.zeros(0, np.int64)
        end = np.append(at[1:], len(h))
        yield pa.RecordBatch.from_arrays([pa.array(owner[at]), *(pa.array([x[i:j].tobytes() for i, j in zip(at, end)], pa.binary()) for x in (h, source, place.astype(np.uint32)))], names=["doc_id", "fp", "source", "place"])


def matches(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, fp, source, place: packed windows of each document that start in a smaller one, with
    the first document and word where they do."""
    T.lean(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = T.tasks(rows, TASK_BYTES)
    lists = rows.mapInArrow(_fingerprints(n, BLOCKS * parts), KINDS)
    # a block's lists meet in one task; lists that ask for nothing are only spread
    where = F.when(F.col("block") < 0, -F.col("batch") - 1).otherwise(F.col("block"))
    # one bucket of documents for each task that reads them: a row for each pair of tasks at most
    asked = lists.repartition(parts, where).mapInArrow(_lookup, KINDS)
    answers = asked.repartition(parts, "batch").mapInArrow(_settle(parts), KINDS)
    return answers.repartitionById(parts, "block").mapInArrow(_by_document, "doc_id long, fp binary, source binary, place binary")


def _factors(hit: np.ndarray, source: np.ndarray, place: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, source, start in the source) of one document: runs of matched
    windows on end whose first places are on end too; a run ends n-1 words after its last window."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(source[at]) != 0) | (np.diff(place[at]) != 1)
    s = at[new]
    e = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1]) + n
    return list(zip(s.tolist(), e.tolist(), source[s].tolist(), place[s].tolist()))


def dedup(docs: DataFrame, n: int = WINDOW, keep_text: bool = False, prefix: str = "") -> DataFrame:
    """Remove every word in a window of n words that also starts in a smaller document.

    Returns the columns of docs, n_words, n_removed, kept_sha256 and factors
    (array<struct<start,end,source,source_start>>), named with ``prefix``; with ``keep_text``,
    text is what was kept.
    """
    results = [prefix + x for x in RESULTS]
    base = docs.select(*T.columns(docs, results))
    x = T.unused(base)
    found = T.materialize(matches(docs, n), "matches").select(F.col("doc_id").alias(f"{x}doc"), F.struct("fp", "source", "place").alias(f"{x}found"))
    joined = base.join(found, F.col("doc_id").cast("long") == F.col(f"{x}doc"), "left").select(*T.columns(base), f"{x}found")
    text_at = [c.lower() for c in base.columns].index("text")

    def run(batches):
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "source", "source_start")]))
        for batch in batches:
            for part in T.slices(batch):
                flags = part.column(part.num_columns - 1).to_pylist()
                texts = part.column(text_at).cast(pa.string()).fill_null("").to_pylist()
                h, first = T.scan(part.column(text_at), lower=False) if any(flags) else (None, None)
                total, gone, sha, spans, out = [], [], [], [], []
                for row, (text, flag) in enumerate(zip(texts, flags)):
                    words = text.encode().split()
                    total.append(len(words))
                    factors = []
                    if flag and len(words) >= n:
                        w, _ = T.windows(h[first[row] : first[row + 1]], np.array([0, len(words)]), n)
                        fp, src, place = (np.frombuffer(flag[c], k) for c, k in (("fp", np.uint64), ("source", np.int64), ("place", np.uint32)))
                        at = np.minimum(np.searchsorted(fp, w), len(fp) - 1)
                        factors = _factors(fp[at] == w, src[at], place[at].astype(np.int64), n)
                        keep = np.ones(len(words) + 1, np.int64)
                        for s, e, *_ in factors:
                            keep[s:e] = 0
                        kept = b" ".join(compress(words, keep.tolist()))
                        gone.append(len(words) - int(keep[:-1].sum()))
                    else:
                        kept = b" ".join(words)
                        gone.append(0)
                    sha.append(hashlib.sha256(kept).hexdigest())
                    spans.append([{"start": s, "end": e, "source": d, "source_start": f} for s, e, d, f in factors])
                    if keep_text:
                        out.append(kept.decode() if gone[-1] else text)
                cols = [part.column(k) for k in range(part.num_columns - 1)]
                if keep_text:
                    cols[text_at] = pa.array([o if g or t is not None else None for o, g, t in zip(out, gone, cols[text_at].to_pylist())], cols[text_at].type)
                cols += [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, kind)]
                yield cols

    made = f"`{results[0]}` long, `{results[1]}` long, `{results[2]}` string, `{results[3]}` array<struct<start:long,end:long,source:long,source_start:long>>"
    return T.mapped(joined, run, made, inputs=1)
