"""N-gram Jaccard join with signature trees; exact but for hashing.

Documents are sets of shingles.  A tree over some of them has the documents as leaves and joins
``FANOUT`` nodes into one, level by level; a node holds the OR of its leaves' token bitmaps, the range of
their sizes, the most shingles that any leaf hides behind a bit it has set already, and their component
where they have only one.  Two nodes' leaves can share no more than the bits common to both bitmaps plus
those hidden ones, and no more than their sizes, so two trees are traversed from their roots at once, and a
pair of nodes goes when that overlap can't make any two of their leaves similar, or when all of
them are in one component.  Pairs of leaves that stay are confirmed on full sets, the most
promising first, and a pair that is already connected is passed over.

Which documents meet in a tree: sizes are cut into overlapping windows, so that similar sets share one.  Two
similar sets of a window differ in at most ``k`` shingles; dealt by hash into k + 1 + spare
parts, they are equal in spare + 1 at least, so similar documents share as many keys (window, part,
content).  (A part may be empty: only sets with more than ``spare`` empty parts use those as keys, others
share as many keys less.)  A document that shares fewer keys of a window than that with all others together
has no partner there, so passages that many documents share join none by themselves.  Documents
joined by keys that are left are a block; no link crosses a block.

1. A block is cut at random into chunks of at most about ``CHUNK_DOCS`` documents and ``CHUNK_SHINGLES`` shingles,
   and each chunk is joined by a tree of its own: most blocks are one chunk.
2. In a block of several chunks that isn't one component yet, the tree of one chunk is traversed with
   that of each other one, which joins large groups of near copies.
3. In a block that still has several components, similar documents share one of the rarest shingles in
   the block of each (prefix filter).  The holders of such a shingle that are outside the block's
   largest component are traversed as a tree with the tree of all its holders; more than
   ``CELL`` of either are cut by hash, so no shingle's holders are one task.  Pairs of leaves are confirmed by
   a join with the full sets.

Exact copies are one set throughout: its smallest doc_id stands for it.  Shingles are 64-bit
hashes; two of one value count as one.

Null and empty texts have no shingles and are linked with nothing; a text of fewer words than a
shingle is one shingle, the whole of it.  Documents of a null doc_id are left out.  Rows that repeat a doc_id are
separate texts of that document and share its component.  Ties go to the smallest doc_id.  Very
long texts are taken whole.  Empty tables give empty results; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm import _text as T
from lexspark.llm.near_dedup import _sets, components, links

SHINGLE, SIMILARITY = 4, 85
CHUNK_DOCS, CHUNK_SHINGLES = 256, 65_536
CELL = 512
FANOUT = 8
FEWEST_BITS, MOST_BITS, PREFIX_BITS = 256, 65_536, 1_024
WORDS_AT_ONCE = 1 << 20
LARGEST_SET = 2**40
SPARE = 10  # one more part for so many that may differ


# -- keys that similar sets share


@lru_cache
def windows(percent: int) -> tuple[np.ndarray, ...]:
    """Of each window of sizes: first size, last size, parts, and how many of them are spare.

    A pair belongs to the last window that begins at or below its smaller size."""
    first, last, parts, spare = [1], [], [], []
    while first[-1] < LARGEST_SET:
        first.append(max(first[-1] + 1, -(-first[-1] * 100 * 100 // (percent * percent))))
        smaller = first[-1] - 1
        larger = smaller * 100 // percent
        differ = (smaller + larger) * (100 - percent) // (100 + percent)  # of two similar sets
        more = 1 + -(-differ // SPARE) if differ else 0
        last.append(larger)
        parts.append(differ + 1 + more if differ else 0)  # sets that can't differ are copies and need no key
        spare.append(more)
    return tuple(np.array(x, np.int64) for x in (first[:-1], last, parts, spare))


def part_keys(w: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of sets that lie on end in w: the keys by set and window, where each set's begin, how many
    are of its first window, and how many each window's partners must share (a line for each window)."""
    low, high, parts, spare = windows(percent)
    size = np.diff(first)
    place, value = T.mix(w ^ T._BASE) >> np.uint64(20), T.mix(w * T._INV)
    row = np.repeat(np.arange(len(size)), size)
    whose, keys, need = [], [], []
    own = np.searchsorted(low, size, "right") - 1
    for back in (0, 1):
        window = own - back
        use = (size > 0) & (window >= 0)
        window = np.where(use, window, 0)
        use &= (high[window] >= size) & (parts[window] > 0)
        n = np.where(use, parts[window], 0)
        base = np.cumsum(n) - n
        at = base[row[use[row]]] + (place[use[row]] % n[row[use[row]]].astype(np.uint64)).astype(np.int64)
        total = int(n.sum())
        content = np.zeros(total, np.uint64)
        np.add.at(content, at, value[use[row]])
        empty = np.bincount(at, minlength=total) == 0
        doc = np.repeat(np.arange(len(size)), n)
        bare = np.bincount(doc[empty], minlength=len(size))
        skip = bare <= spare[window]
        stay = ~(empty & skip[doc])
        number = (np.arange(total) - base[doc]) + (window[doc] << 44)
        whose.append(doc[stay])
        keys.append(T.mix(content ^ T.mix(number.astype(np.uint64) + T._BASE))[stay])
        need.append(np.where(skip, spare[window] + 1 - bare, 1))
    cut = np.bincount(whose[0], minlength=len(size))
    whose, keys = np.concatenate(whose), np.concatenate(keys)
    order = np.argsort(whose, kind="stable")
    return keys[order], np.searchsorted(whose[order], np.arange(len(size) + 1)), cut, np.stack(need, axis=1)


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set), its keys, and what ``part_keys`` says of them."""

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, most=600_000):
                w, first = _sets(part.column(1), k)
                keys, at, cut, need = part_keys(w, first, percent)
                digests = [xxhash.xxh3_128_digest(w[a:b].data) if b > a else None for a, b in zip(first[:-1], first[1:])]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), pa.array(digests, pa.binary()), lists, *(pa.array(x, pa.int32()) for x in (cut, need[:, 0], need[:, 1]))], names=["doc_id", "n_shingles", "set_id", "keys", "cut", "need0", "need1"])

    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, keys array<long>, cut int, need0 int, need1 int")


def blocks(sigs: DataFrame, scratch: T.Scratch) -> DataFrame:
    """id, component: of the documents that share enough keys with others, the block of each."""
    keys = sigs.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    shared = lambda rows: rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "lo")
    twice = scratch.save(shared(keys).select("key"), "shared")
    rows = sigs.select(F.col("doc_id").alias("id"), "cut", "need0", "need1", F.posexplode("keys").alias("place", "key"))
    later = F.col("place") >= F.col("cut")
    rows = rows.select("id", "key", later.alias("later"), F.when(later, F.col("need1")).otherwise(F.col("need0")).alias("need"))
    rows = scratch.save(rows.join(twice, "key"), "shared-keys")
    enough = rows.groupBy("id", "later").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("id", "later")
    rows = scratch.save(rows.join(enough, ["id", "later"], "left_semi").select("id", "key"), "enough-keys")
    edges = scratch.save(rows.join(shared(rows), "key").select("lo", "id").distinct(), "block-edges")
    # a document with its first holder, and that one with the document's other ones, which most of a group have in common
    first = edges.groupBy("id").agg(F.min("lo").alias("a"))
    ends = edges.join(first, "id").select("a", F.explode(F.array("id", "lo")).alias("b")).where("a <> b").distinct()
    return components(scratch.save(ends, "block-ends"), scratch)


# -- trees


class Tree:
    """Levels of nodes from the leaves to one root: bitmaps, smallest and largest size, most hidden
    shingles, and the component of all leaves or -1."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, hidden: np.ndarray, component: np.ndarray):
        self.levels = [(bits, size, size, hidden, component)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, hidden, component = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            one = np.minimum.reduceat(component, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at), np.where(one == np.maximum.reduceat(component, at), one, -1)))


def _possible(x, y, p, q, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether leaves of nodes p of a level and q of another can be similar and unconnected; the most they can share."""
    xb, xl, xh, xs, xc = x
    yb, yl, yh, ys, yc = y
    common = np.bitwise_count(xb[p] & yb[q]).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(xh[p], xs[p] + common), np.minimum(yh[q], ys[q] + common))
    return ((100 + percent) * most >= percent * (xl[p] + yl[q])) & ~((xc[p] == yc[q]) & (xc[p] >= 0)), most


def traverse(x: Tree, y: Tree, percent: int):
    """Arrays of leaf pairs (i of x, j of y) that stay, and the most each can share. A tree with itself: i < j."""
    top = max(len(x.levels), len(y.levels)) - 1
    level = lambda t, n: t.levels[min(n, len(t.levels) - 1)]  # noqa: E731  above its root, a tree is its root
    at_once = max(64, WORDS_AT_ONCE // x.levels[0][0].shape[1])
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        n, p, q = todo.pop()
        if len(p) > at_once:
            todo += [(n, p[i : i + at_once], q[i : i + at_once]) for i in range(0, len(p), at_once)]
            continue
        if n == 0 and x is y:
            p, q = p[p < q], q[p < q]
        stay, most = _possible(level(x, n), level(y, n), p, q, percent)
        p, q = p[stay], q[stay]
        if n == 0:
            if len(p):
                yield p, q, most[stay]
            continue
        for t, which in ((x, 0), (y, 1)):
            nodes = (p, q)[which]
            if n < len(t.levels):
                child = nodes[:, None] * FANOUT + np.arange(FANOUT)
                real = child < len(level(t, n - 1)[1])
            else:
                child, real = nodes[:, None], np.ones((len(nodes), 1), bool)
            line = np.nonzero(real)[0]
            p, q = (child[real], q[line]) if which == 0 else (p[line], child[real])
        if x is y:
            p, q = p[p <= q], q[p <= q]
        todo.append((n - 1, p, q))


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    size = np.array([len(s) for s in sets], np.int64)
    at = np.repeat(np.arange(len(sets)), size) * width
    if len(at):
        at += (np.concatenate(sets) >> np.uint64(40)).astype(np.int64) & (width - 1)
    flat = np.zeros(len(sets) * width, bool)
    flat[at] = True
    return np.packbits(flat.reshape(-1, width), axis=1).view(np.uint64)


def _hidden(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def _grown(sets: list[np.ndarray], component: np.ndarray, width: int) -> tuple[Tree, np.ndarray]:
    """A tree over sets, and their order in it: like sizes, then like smallest hashes, are neighbours."""
    size = np.array([len(s) for s in sets], np.int64)
    least = np.array([T.mix(s).min() if len(s) else 0 for s in sets], np.uint64)
    order = np.lexsort((least, np.floor(np.log2(np.maximum(size, 1)) * 4)))
    bits = bitmaps([sets[i] for i in order], width)
    return Tree(bits, size[order], _hidden(bits, size[order]), component[order]), order


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def joined(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Components that links between sets of side 0 and those of side 1 (of side 0 with each other if there is no
    side 1) connect: (the smallest, another) of those that are one now. Components go by one of their ids."""
    width = min(MOST_BITS, max(FEWEST_BITS, 1 << int(8 * max(map(len, sets)) - 1).bit_length()))
    up = {c: c for c in component.tolist()}

    def root(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    trees = []
    for s in (0, 1) if side.any() else (0,):
        rows = np.flatnonzero(side == s)
        tree, order = _grown([sets[i] for i in rows], component[rows], width)
        trees.append((tree, rows[order]))
    (x, xr), (y, yr) = trees[0], trees[-1]
    for p, q, most in traverse(x, y, percent):
        for k in np.argsort(-most, kind="stable").tolist():
            i, j = int(xr[p[k]]), int(yr[q[k]])
            a, b = root(int(component[i])), root(int(component[j]))
            if a != b and _similar(sets[i], sets[j], percent):
                up[max(a, b)] = min(a, b)
    return [(root(c), c) for c in up if root(c) != c]


# -- jobs


def _groups(batches, keys: int):
    """Record batches of the rows of each group, from batches sorted by their first ``keys`` columns."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        lines = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]])
        starts = [0, *(np.flatnonzero((lines[:, 1:] != lines[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            now = tuple(lines[:, a].tolist())
            if held and now != name:
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            name = now
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*(sorted(x) for x in found)) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _joins(percent: int):
    """block, cell, side, c, shingles (sorted by block and cell) -> links of components."""

    def run(batches):
        found = []
        for g in _groups(batches, 2):
            if g.num_rows > 1:
                side, c = g.column(2).to_numpy(), g.column(3).to_numpy()
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in g.column(4)]
                if not side.any() or not side.all():
                    found += joined(sets, c, side, percent)
            if len(found) >= 10_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return run


def _candidates(percent: int):
    """block, h, left, right, side, id, c, n, bits (sorted by the first four) -> pairs that may be links."""

    def run(batches):
        found = []
        for g in _groups(batches, 4):
            side, ids, c, n = (g.column(i).to_numpy() for i in (4, 5, 6, 7))
            if side.any() and not side.all():
                bits = np.stack([np.frombuffer(s.as_buffer(), np.uint64) for s in g.column(8)])
                trees = []
                for s in (0, 1):
                    rows = np.flatnonzero(side == s)
                    rows = rows[np.argsort(n[rows], kind="stable")]
                    trees.append((Tree(bits[rows], n[rows], _hidden(bits[rows], n[rows]), c[rows]), rows))
                (x, xr), (y, yr) = trees
                for p, q, _ in traverse(x, y, percent):
                    found += [(a, b) for a, b in zip(ids[xr[p]].tolist(), ids[yr[q]].tolist()) if a != b]
            if len(found) >= 10_000:
                yield _pairs(list(set(found)))
                found = []
        yield _pairs(list(set(found)))

    return run


def _packed(k: int):
    def run(batches):
        seen = set()
        for batch in batches:
            for part in T.slices(batch):
                w, first = _sets(part.column(1), k)
                ids = part.column(0).to_pylist()
                sets = [w[a:b] for a, b in zip(first[:-1], first[1:])]
                sid = [xxhash.xxh3_64_intdigest(s.data) - 2**63 if len(s) else 0 for s in sets]
                new = []
                for i, own in enumerate(zip(ids, sid)):  # a row that repeats is one set
                    if len(sets[i]) and own not in seen:
                        seen.add(own)
                        new.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in new], pa.int64()), pa.array([sid[i] for i in new], pa.int64()), pa.array([len(sets[i]) for i in new], pa.int64()), pa.array([sets[i].tobytes() for i in new], pa.binary())], names=["id", "sid", "n", "shingles"])

    return run


def _marked(batches):
    """block, id, c, sid, n, shingles -> the same with the shingles as an array, and a bitmap of them."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            b = batch.slice(at, 64)
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in b.column(5)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            bits = pa.array([x.tobytes() for x in bitmaps(sets, PREFIX_BITS)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], lists, bits], names=["block", "id", "c", "sid", "n", "h", "bits"])


def _unsettled(placed: DataFrame, comp: DataFrame) -> DataFrame:
    """Documents of blocks with several components: block, id, parts, chunk, c."""
    now = placed.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    split = now.groupBy("block").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("block")
    return now.join(split, "block", "left_semi")


def _meet(cells: DataFrame, percent: int) -> DataFrame:
    cells = cells.repartition("block", "cell").sortWithinPartitions("block", "cell")
    return cells.select("block", "cell", "side", "c", "shingles").mapInArrow(_joins(percent), "a long, b long")


def _rarest(rest: DataFrame, sets: DataFrame, scratch: T.Scratch, percent: int) -> DataFrame:
    """Pairs of documents in different components of a block that share a rare shingle of both."""
    kinds = "block long, id long, c long, sid long, n long, h array<long>, bits binary"
    marked = scratch.save(rest.select("block", "id", "c").join(sets, "id").select("block", "id", "c", "sid", "n", "shingles").mapInArrow(_marked, kinds), "marked")
    narrow = marked.select("block", "id", "c", "sid", "n", F.explode("h").alias("h"))
    often = narrow.groupBy("block", "h").agg(F.count("*").alias("f")).where("f > 1")
    # a set's shingles from the rarest on; those that no other has come first and meet nothing
    own = Window.partitionBy("block", "id", "sid")
    ranked = narrow.join(often, ["block", "h"]).withColumn("rank", F.row_number().over(own.orderBy("f", "h")) + F.col("n") - F.count("*").over(own))
    # of two similar sets, each holds one of the first shingles of the other
    least = F.ceil(percent * F.col("n") / 100)
    first = ranked.where(F.col("rank") <= F.col("n") - least + 1).select("block", "id", "c", "sid", "n", "h")
    sizes = rest.groupBy("block", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("block").agg(F.max(F.struct("m", "c")).alias("m")).select("block", F.col("m.c").alias("main"))
    first = scratch.save(first.join(main, "block").withColumn("minor", F.col("c") != F.col("main")).drop("main"), "first")
    held = first.groupBy("block", "h").agg(F.count("*").alias("all"), F.count_if("minor").alias("minors"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("minors > 0 and lo < hi")
    held = held.select("block", "h", F.ceil(F.col("minors") / CELL).cast("int").alias("lefts"), F.ceil(F.col("all") / CELL).cast("int").alias("rights"))
    full = first.join(held, ["block", "h"]).join(marked.select("id", "sid", "bits"), ["id", "sid"])
    part = lambda n: F.pmod(F.xxhash64("sid", "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = full.where("minor").select("block", "h", part("lefts").alias("l"), every("rights").alias("r"), F.lit(0).alias("side"), "id", "c", "n", "bits")
    right = full.select("block", "h", every("lefts").alias("l"), part("rights").alias("r"), F.lit(1).alias("side"), "id", "c", "n", "bits")
    cell = ["block", "h", "l", "r"]
    cells = left.unionByName(right).repartition(*cell).sortWithinPartitions(*cell)
    return cells.mapInArrow(_candidates(percent), "a long, b long").distinct()


def similar_sets(docs: DataFrame, k: int = SHINGLE, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links of at least ``percent``
    per cent Jaccard similarity over k-word shingles), a row per row of docs."""
    spark = docs.sparkSession
    T.lean(spark)
    scratch = T.Scratch(spark)
    try:
        return T.materialize(_classes(docs, k, percent, scratch), "sets")
    finally:
        scratch.close()


def _classes(docs: DataFrame, k: int, percent: int, scratch: T.Scratch) -> DataFrame:
    sigs = scratch.save(signatures(docs, k, percent), "signatures")
    block = blocks(sigs, scratch).withColumnRenamed("component", "block")
    some = sigs.where("n_shingles > 0").select("doc_id", "n_shingles", "set_id")
    member = scratch.save(some.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n")), "members")
    placed = member.groupBy("id").agg(F.sum("n").alias("n")).join(block, "id")
    size = placed.groupBy("block").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
    parts = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    placed = placed.join(size.select("block", parts.alias("parts")), "block").select("block", "id", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("chunk"))
    placed = scratch.save(placed, "placed")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = scratch.save(texts.join(placed.select("id"), "id", "left_semi").select("id", "text").mapInArrow(_packed(k), "id long, sid long, n long, shingles binary"), "sets")

    chunks = placed.join(sets, "id").select("block", F.col("chunk").alias("cell"), F.lit(0).alias("side"), "id", F.col("id").alias("c"), "shingles")
    edges = scratch.save(_meet(chunks, percent), "chunk-links")

    several = placed.where("parts > 1")
    rest = scratch.save(_unsettled(several, components(edges, scratch)), "unsettled")
    first = F.explode(F.sequence(F.lit(1), F.col("parts") - 1))
    star = rest.where("chunk > 0").select("block", F.col("chunk").alias("cell"), F.lit(1).alias("side"), "id", "c").unionByName(rest.where("chunk = 0").select("block", first.alias("cell"), F.lit(0).alias("side"), "id", "c"))
    edges = edges.union(scratch.save(_meet(star.join(sets, "id"), percent), "star-links"))

    rest = scratch.save(_unsettled(several, components(edges, scratch)), "unsettled")
    pairs = scratch.save(_rarest(rest, sets, scratch, percent), "pairs")
    edges = edges.union(scratch.save(links(pairs, sets.select("id", "shingles"), percent), "rare-links"))

    copies = some.join(member.select("set_id", "id"), "set_id").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct()
    final = components(edges.union(copies), scratch)
    out = sigs.select("doc_id", "n_shingles").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
