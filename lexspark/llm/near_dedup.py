"""MinHash near-dedup with tensored banding.

Two small collections of HALF half-keys (of ROWS minhashes each) are computed per distinct
shingle set; a table key is a pair of half-keys, one of each collection, so HALF * HALF
tables need 2 * HALF * ROWS minhashes instead of HALF * HALF * 2 * ROWS.

Documents with one shingle set are one class; its smallest doc_id stands for it.  In each
table bucket the members are compared with one member, in each of ROUNDS rounds another;
linked ones form components, so large groups of near copies need no pairs of all members.
In the end the members of buckets that still hold several components are compared across
components, so no link is lost that changes one; not all with all, though, as pages that share
their frame and little else would be, but where they share one of their rarest shingles:
ordered by how many of those members have them, two sets of which enough is common share one
of the first few (prefix filter), and what a frame repeats comes last.  A pair is kept
only if its sizes and two sketches allow the similarity: an odd sketch (parities of hashed
shingles), which never rules out a similar pair, and one-bit minhashes.  Every link is
confirmed on full shingle sets.  A table spreads a group of near copies over as many keys as
there are tables, so no key holds over a hundredth of the rows.

Null and empty texts have no shingles and are linked with nothing.  Documents of a null
doc_id are left out.  Rows that repeat a doc_id are separate texts of that document and
share its component.  Ties go to the smallest doc_id.  Very long texts are taken whole.
Empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm import _text as T

ROWS = 3
HALF = 10
ROUNDS = 3
BITS = 256
#: Of BITS one-bit minhashes, a pair at similarity 0.8 differs in 25.6 on average (deviation 4.8); more than
#: this many differ with a chance under 1e-4, less than the chance that no table joins the pair.
MOST_DIFFERENT = 45
#: Bits of the odd sketch: two sets that differ in d shingles differ in at most d of them.
PARITIES = 512
SIMILARITY = 80


def _sets(part: pa.Array, k: int):
    """Sorted distinct shingle hashes of each text on end, and where each text's start."""
    h, first = T.scan(part)
    count = np.diff(first)
    w, row = T.windows(h, first, k)
    for r in np.flatnonzero((count > 0) & (count < k)).tolist():  # fewer words: the whole sequence is one shingle
        one, _ = T.windows(h[first[r] : first[r + 1]], np.array([0, count[r]]), int(count[r]))
        w, row = np.append(w, one ^ np.uint64(count[r])), np.append(row, r)
    order = np.lexsort((w, row))
    w, row = w[order], row[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
    w, row = w[new], row[new]
    return w, np.searchsorted(row, np.arange(len(count) + 1))


def _keys(w: np.ndarray, at: np.ndarray, rows: int, half: int) -> np.ndarray:
    """Of non-empty sets: a line of half * half table keys for each."""
    rng = np.random.default_rng(7)
    mins = np.stack([np.minimum.reduceat(T.mix(w * a), at) for a in rng.integers(1, 2**63, 2 * half * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
    part = np.zeros((2 * half, len(at)), np.uint64)
    for r in range(rows):
        part = T.mix(part * T._BASE + mins[r::rows])
    a, b = part[:half], part[half:]
    table = np.arange(half * half, dtype=np.uint64).reshape(half, half, 1)
    return T.mix(T.mix(a[:, None] * T._BASE + b[None]) + table).reshape(half * half, -1).T


def _bits(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BITS one-bit minhashes of non-empty sets, as BITS / 64 words a line."""
    rng = np.random.default_rng(8)
    out = np.zeros((BITS // 64, len(at)), np.uint64)
    for i, a in enumerate(rng.integers(1, 2**63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
        x = w * a  # w is mixed already; high bits of the product order the set, and a mixed bit of the smallest is kept
        x ^= x >> np.uint64(29)
        low = np.minimum.reduceat(x, at)
        out[i // 64] |= (T.mix(low) & np.uint64(1)) << np.uint64(i % 64)
    return out.T


def _parities(w: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Odd sketches of sets: PARITIES / 64 words a line."""
    at = np.repeat(np.arange(len(size)), size) * PARITIES + (w >> np.uint64(40)).astype(np.int64) % PARITIES
    odd = np.bincount(at, minlength=len(size) * PARITIES) & 1
    return np.packbits(odd.astype(bool).reshape(-1, PARITIES), axis=1).view(np.uint64)


def signatures(docs: DataFrame, k: int, rows: int = ROWS, half: int = HALF) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the shingle set), table keys and sketches."""
    lists = ("keys", "bits", "odd")
    schema = "doc_id long, n_shingles long, set_id binary, " + ", ".join(f"{c} array<long>" for c in lists)

    def run(batches):
        for batch in batches:
            for part in T.slices(batch, most=600_000):
                w, first = _sets(part.column(1), k)
                size = np.diff(first)
                some, at = np.flatnonzero(size), first[:-1][size > 0]
                made = [_keys(w, at, rows, half), _bits(w, at), _parities(w, size[some])] if len(some) else []
                made = [np.ascontiguousarray(x).view(np.int64) for x in made]
                line = np.cumsum(size > 0) - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size), pa.array([xxhash.xxh3_128_digest(w[a:b].data) if b > a else None for a, b in zip(first[:-1], first[1:])], pa.binary()), *(pa.array([x[line[i]] if size[i] else None for i in range(len(size))], pa.list_(pa.int64())) for x in made or [None] * len(lists))],
                    names=["doc_id", "n_shingles", "set_id", *lists],
                )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _shingles(k: int):
    def run(batches):
        for batch in batches:
            for part in T.slices(batch):
                w, first = _sets(part.column(1), k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                inter = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _star(rest: DataFrame, r: int) -> DataFrame:
    """Pairs of each bucket's members with one member, another one each round, where they are
    in different components: as many as members. key, id, c."""
    salt = F.lit(0 if r == 0 else int(np.random.default_rng(r).integers(1, 2**62)))
    pivot = rest.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(salt)).alias("x")).select("key", F.col("x").bitwiseXOR(salt).alias("pivot"))
    got = rest.join(pivot, "key").where("id <> pivot")
    if r:
        own = rest.select("key", F.col("id").alias("pivot"), F.col("c").alias("pc"))
        got = got.join(own, ["key", "pivot"]).where("c <> pc")
    return got.select(*_pair("pivot", "id")).distinct()


def _shingle_rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            h = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), batch.column(0)[i].as_py())), pa.array(h)], names=["id", "h"])


def _across(rest: DataFrame, member: DataFrame, shingles: DataFrame, scratch: T.Scratch, percent: int) -> DataFrame:
    """Pairs of unsettled members in different components that share one of their rarest shingles
    and may be similar.  For each shingle, members outside its largest component meet all others."""
    names = {"b": ("bits", BITS // 64), "o": ("odd", PARITIES // 64)}
    words = [F.get(c, i).alias(f"{k}{i}") for k, (c, n) in names.items() for i in range(n)]
    known = scratch.save(rest.select("id", "c").distinct().join(member.select("id", "n_shingles", *words), "id").withColumn("sets", F.count("*").over(Window.partitionBy("id"))), "unsettled")
    rows = scratch.save(shingles.join(known.select("id"), "id", "left_semi").mapInArrow(_shingle_rows, "id long, h long"), "rows")
    shared = rows.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    # a set's shingles from the rarest on; those that no other has come first and meet nothing
    own = Window.partitionBy("id")
    ranked = rows.join(shared, "h").join(known.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.max("c").alias("c"), F.max("sets").alias("sets")), "id")
    rank = F.row_number().over(own.orderBy("f", "h")) + F.col("n_shingles") - F.count("*").over(own)
    ranked = ranked.withColumn("rank", F.when(F.col("sets") == 1, rank).otherwise(0))  # several texts of one doc_id: all shingles are tried
    # of two similar sets, the larger's first shingles up to "probe" hold one of the smaller's up to "index"
    n = F.col("n_shingles")
    probe, index = n - F.ceil(percent * n / 100) + 1, n - F.ceil(2 * percent * n / (100 + percent)) + 1
    first = scratch.save(ranked.where(F.col("rank") <= probe).select("id", "h", "c", (F.col("rank") <= index).alias("indexed")), "first")
    size = first.groupBy("h", "c").agg(F.count("*").alias("n"))
    largest = size.groupBy("h").agg(F.max(F.struct("n", "c")).alias("m"), F.count("*").alias("several")).where("several > 1").select("h", F.col("m.c").alias("main"))
    flagged = first.join(largest, "h").withColumn("minor", F.col("c") != F.col("main")).drop("main")
    flagged = scratch.save(flagged.join(known.drop("c", "sets"), "id"), "flagged")
    x = flagged.where("minor").select(*(F.col(c).alias(f"x_{c}") for c in flagged.columns))
    y = flagged.select(*(F.col(c).alias(f"y_{c}") for c in flagged.columns))
    differ = {k: sum((F.bit_count(F.col(f"x_{k}{i}").bitwiseXOR(F.col(f"y_{k}{i}"))) for i in range(n)), F.lit(0)) for k, (_, n) in names.items()}
    small, large = F.least("x_n_shingles", "y_n_shingles"), F.greatest("x_n_shingles", "y_n_shingles")
    near = (100 * small >= percent * large) & ((100 + percent) * differ["o"] <= (100 - percent) * (small + large)) & (differ["b"] <= MOST_DIFFERENT)
    larger = (F.col("x_n_shingles") > F.col("y_n_shingles")) | ((F.col("x_n_shingles") == F.col("y_n_shingles")) & (F.col("x_id") > F.col("y_id")))
    once = (~F.col("y_minor") | (F.col("x_id") < F.col("y_id"))) & F.when(larger, F.col("y_indexed")).otherwise(F.col("x_indexed"))
    joined = x.join(y, (F.col("x_h") == F.col("y_h")) & (F.col("x_c") != F.col("y_c")) & near & once)
    return joined.select(*_pair("x_id", "y_id")).distinct()


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar. sets: id, shingles."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def components(edges: DataFrame, scratch: T.Scratch) -> DataFrame:
    """id, component: the smallest id reachable, for every id that has a link.

    Labels go to neighbours and then to the labels' own labels until nothing changes; each
    round is written to the shared folder, and only a count comes back to the driver."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = scratch.save(both, "links")
    label = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "label")
    while True:
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("component").alias("m"))
        step = label.join(near, label.id == near.a).select("id", F.least("component", "m").alias("l"), F.col("component").alias("old"))
        jump = label.select(F.col("id").alias("l"), F.col("component").alias("j"))
        new = step.join(jump, "l", "left").select("id", F.least("l", F.coalesce("j", "l")).alias("component"), "old")
        new = scratch.save(new, "label")
        label = new.select("id", "component")
        if new.where("component <> old").limit(1).count() == 0:
            return label


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of at least
    ``percent`` per cent Jaccard similarity over k-word shingles) and kept, a row per row of docs."""
    T.lean(docs.sparkSession)
    scratch = T.Scratch(docs.sparkSession)
    try:
        return T.materialize(_classes(docs, k, percent, scratch), "classes")
    finally:
        scratch.close()


def _classes(docs: DataFrame, k: int, percent: int, scratch: T.Scratch) -> DataFrame:
    sigs = scratch.save(signatures(docs, k), "signatures")
    some = sigs.where("n_shingles > 0")
    # the smallest document of each distinct set stands for it
    sets = some.groupBy("set_id").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("keys", "bits", "odd")), F.max("n_shingles").alias("n_shingles"))
    member = scratch.save(sets, "sets")
    rows = member.select("id", F.explode("keys").alias("key"))
    tables = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    full = scratch.save(rows.join(tables.select("key", "n"), "key"), "buckets")
    # the full shingle sets of all that share a bucket: a set's text is that of a row of its document
    named = full.select("id").distinct()
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    shingles = scratch.save(texts.join(named, "id", "left_semi").select("id", "text").mapInArrow(_shingles(k), "id long, shingles binary"), "shingles")
    edges, comp, tested = None, None, None
    for r in range(ROUNDS + 1):
        rest = full if comp is None else full.where("n > 2").join(comp, "id", "left")
        rest = rest.select("key", "id", F.col("id").alias("c") if comp is None else F.coalesce("component", "id").alias("c"))
        if comp is not None:
            split = rest.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
            rest = scratch.save(rest.join(split, "key", "left_semi"), "rest")
        pairs = _star(rest, r) if r < ROUNDS else _across(rest, member, shingles, scratch, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        found = scratch.save(links(pairs, shingles, percent), "edges")
        edges = found if edges is None else edges.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        if r < ROUNDS:
            comp = components(edges, scratch)
    # rows of one doc_id belong together, whatever their sets
    own = some.join(member.select("set_id", "id"), "set_id").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    final = components(edges.union(own.distinct()), scratch)
    out = sigs.select("doc_id", "n_shingles").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
