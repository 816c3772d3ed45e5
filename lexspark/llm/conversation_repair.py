"""Repair of conversation structure by a scan of min-plus matrices.

A repaired conversation has role initials ``(s?(ua)+)?``, which an automaton of four states reads:
start, after system, after user, after assistant.  A row may be kept (0), get the role user or
assistant (1) or be deleted (2, the only way for a blank or repeated row); an empty-text user or
assistant row may be inserted anywhere (5); a truncated row that stays costs 5 more.

Every row is a 4 x 4 matrix over elements (cost, audit): entry (i, j) is the cheapest way from
state i to state j with this row read and any rows inserted before it (the insert closure), the
audit being the letters of the edits.  Sums of costs and joined audits are the product, the
smallest element (cost, then audit in ASCII order) the sum, so matrices multiply in any grouping:
rows are multiplied in pairs, pairs of pairs and so on within a piece of a conversation, and pieces
in groups of ``FAN`` by as many shuffles as their number has digits to that base.  (Of two audits
between the same states at one cost neither begins the other, as any more inserted rows would
cost more; so the smaller stays the smaller whatever follows it.)  Letters within the module tell
inserted and changed roles apart (I, J; R, S), which keeps the order and makes audits readable
without the states.

Rows are dealt by ranges of (conversation, turn, role, text), so one long conversation lies in
many tasks.  A task cuts what it reads into pieces of at most ``PIECE_ROWS`` rows or
``PIECE_BYTES`` of text.  Conversations that lie within a task in one piece are repaired there and
then; the others, at most two a task and those that are long, go through the tree, and their
audits come back to their pieces in slices.  A repeated row is found over pieces by digests.
Only the audit of a conversation and a number for each of its pieces are ever one row.

Turns go in order, null turns first; rows of one turn by role and text.  A null role or text counts
as one space.  A null conv_id is a conversation of its own.  Repeated rows are duplicates.  Equal rows of
one turn go to one task.  Extra columns are ignored, whatever their names; empty tables give empty
results; conversations of deleted rows only are empty.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from lexspark.llm import _text as T

PIECE_ROWS, PIECE_BYTES = 2_000, 4_000_000
FAN = 32
PREFIX = 64
CHANGE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INSERTED = {"I": "user", "J": "assistant"}
CHANGED = {"R": "user", "S": "assistant"}
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\v\f\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

# Entries (from, to) of a matrix that can be finite, and for each the ways through a third state.
_ENTRIES = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_WAYS = [[(_ENTRIES.index((i, k)), _ENTRIES.index((k, j))) for k in range(4) if (i, k) in _ENTRIES and (k, j) in _ENTRIES] for i, j in _ENTRIES]
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def times(a: list, b: list) -> list:
    """The min-plus product of two matrices (lists by _ENTRIES; None is infinite)."""
    out = []
    for ways in _WAYS:
        best = None
        for x, y in ways:
            p, q = a[x], b[y]
            if p is not None and q is not None and (best is None or p[0] + q[0] <= best[0]):
                found = (p[0] + q[0], p[1] + q[1])
                best = found if best is None else min(best, found)
        out.append(best)
    return out


def _matrix(steps) -> list:
    """The matrix of single steps (from, to, cost, letter), the cheapest of each place."""
    out = [None] * len(_ENTRIES)
    for i, j, cost, letter in steps:
        at = _ENTRIES.index((i, j))
        out[at] = min(x for x in (out[at], (cost, letter)) if x is not None)
    return out


_USER, _ASSISTANT = _NEXT["u"].items(), _NEXT["a"].items()
_NOTHING = _matrix((i, i, 0, "") for i in range(4))
_ONE = [min((x for x in (a, b) if x is not None), default=None) for a, b in zip(_NOTHING, _matrix([*((i, j, INSERT, "I") for i, j in _USER), *((i, j, INSERT, "J") for i, j in _ASSISTANT)]))]
#: Any rows inserted: no more than two can be needed between two states.
CLOSURE = times(_ONE, _ONE)


def _row_matrix(initial: str, fault: str) -> list:
    steps = [(i, i, DELETE, "D") for i in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        steps += [(i, j, more, "K") for i, j in _NEXT.get(initial, {}).items()]
        steps += [(i, j, CHANGE + more, "R") for i, j in _USER] + [(i, j, CHANGE + more, "S") for i, j in _ASSISTANT]
    return times(CLOSURE, _matrix(steps))


_ROWS = {(initial, fault): _row_matrix(initial, fault) for initial in ("s", "u", "a", "") for fault in ("", "blank", "duplicate", "truncated")}


class Part(NamedTuple):
    """What rows on end amount to."""

    rows: int
    first: str
    last: str
    low: int | None
    high: int | None
    turns: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    matrix: list


_PART = "rows long, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
_FIELDS = [f.split()[0] for f in _PART.split(", ")]


def joined(a: Part, b: Part) -> Part:
    return Part(
        a.rows + b.rows, a.first, b.last, b.low if a.low is None else a.low, a.high if b.high is None else b.high,
        a.turns + b.turns - (a.high is not None and a.high == b.low), a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated,
        a.illegal + b.illegal + (a.last + b.first not in LEGAL), times(a.matrix, b.matrix),
    )


def tree(parts) -> Part:
    """Parts in order as one: neighbours are joined in pairs, pairs of pairs and so on."""
    stack = []
    for part in parts:
        level = 0
        while stack and stack[-1][0] == level:
            part, level = joined(stack.pop()[1], part), level + 1
        stack.append((level, part))
    part = stack.pop()[1]
    while stack:
        part = joined(stack.pop()[1], part)
    return part


def _fault(role: str, text: str, seen: bool) -> str:
    end = text.rstrip(SPACES)[-1:]
    return "blank" if not end else "duplicate" if seen else "truncated" if end not in ".!?" else ""


def parts(rows, earlier=frozenset()):
    """The Part of each row (turn, role, text) of a piece. earlier: digests of rows in pieces before it."""
    seen = set()
    for turn, role, text in rows:
        fault = _fault(role, text, (role, text) in seen or bool(earlier) and _digest(role, text) in earlier)
        seen.add((role, text))
        initial = role[:1]
        matrix = _ROWS[initial if initial in _NEXT else "", fault]
        yield Part(1, initial, initial, turn, turn, int(turn is not None), int(fault == "blank"), int(fault == "duplicate"), int(fault == "truncated"), 0, matrix)


def finish(part: Part) -> tuple[list[int], str]:
    """Counts as in COUNTS, and the letters of the cheapest repair."""
    ends = times(part.matrix, CLOSURE)
    cost, letters = min(x for x in (ends[_ENTRIES.index((0, 0))], ends[_ENTRIES.index((0, 3))]) if x is not None)
    gaps = part.high - part.low + 1 - part.turns if part.turns else 0
    return [gaps, part.blank, part.duplicate, part.truncated, part.illegal, cost], letters


def edited(rows, letters: str):
    """(turn, role, text, edit) of the rows that stay or are inserted."""
    rows = iter(rows)
    for e in letters:
        if e in INSERTED:
            yield None, INSERTED[e], "", "I"
            continue
        turn, role, text = next(rows)
        if e != "D":
            yield turn, CHANGED.get(e, role), text, "K" if e == "K" else "R"


def _digest(role: str, text: str) -> bytes:
    head = role.encode()
    return hashlib.sha256(b"%d:%s%s" % (len(head), head, text.encode())).digest()


_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_TURNS = ArrayType(StructType([StructField("turn", LongType()), *(StructField(c, StringType()) for c in ("role", "text", "edit"))]))


def _lists(groups) -> pa.Array:
    """Lists of (turn, role, text, edit)."""
    flat = [t for g in groups for t in g]
    at = np.cumsum([0, *map(len, groups)]).astype(np.int32)
    columns = list(zip(*flat)) if flat else [()] * 4
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TURN)], names=[f.name for f in _TURN]))


def _rows(turns) -> list:
    """(turn, role, text) of a list of structs."""
    return [(t["turn"], t["role"], t["text"]) for t in turns]


def _pieces(most_rows: int, most_bytes: int):
    """Sorted rows as pieces; conversations that lie whole within the task and one piece are repaired."""

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        made, size, schema = [], 0, None
        conv, rows, held, inner, cut, any_before = None, [], 0, False, False, False

        def batch():
            keys = pa.array([m[0] for m in made], schema)
            columns = [keys, pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made]), *(pa.array([m[3][k] if m[3] else None for m in made], pa.int64()) for k in range(len(COUNTS))), pa.array([m[4] for m in made], pa.string()), _lists([m[5] for m in made])]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "piece", "whole", *COUNTS, "letters", "turns"])

        def flush(whole):
            nonlocal rows, held, number, size
            if whole:
                counts, letters = finish(tree(parts(rows)))
                made.append((conv, base + number, True, counts, letters, list(edited(rows, letters))))
            else:
                made.append((conv, base + number, False, None, None, [(*r, None) for r in rows]))
            number, size, rows, held = number + 1, size + held, [], 0

        for b in batches:
            schema = b.column(0).type
            for key, turn, role, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                if rows and key != conv or cut and key != conv:
                    if rows:
                        flush(inner and not cut)
                    inner, cut = True, False
                elif held >= most_bytes or len(rows) >= most_rows:
                    cut = True
                    flush(False)
                conv = key
                rows.append((turn, role, text))
                held += len(text)
                if size >= most_bytes or len(made) >= 1_000:
                    yield batch()
                    made.clear()
                    size = 0
        if rows:
            flush(False)
        if made:
            yield batch()

    return run


def _with(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """The columns of left, and right's where the keys are equal, null as a value of its own."""
    right = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]
    return left.join(right, same, how).drop(*(f"right_{k}" for k in keys))


def _part_columns(found: list[Part]) -> list[pa.Array]:
    plain = [pa.array([p[k] for p in found], pa.string() if name in ("first", "last") else pa.int64()) for k, name in enumerate(_FIELDS[:-2])]
    costs = pa.array([[x and x[0] for x in p.matrix] for p in found], pa.list_(pa.int64()))
    return [*plain, costs, pa.array([[x and x[1] for x in p.matrix] for p in found], pa.list_(pa.string()))]


def _part(row: dict) -> Part:
    matrix = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])]
    return Part(*(row[f] for f in _FIELDS[:-2]), matrix)


def _measured(batches):
    """conv_id, piece, turns, earlier -> conv_id, piece and the piece's Part."""
    for batch in batches:
        found = [tree(parts(_rows(turns), frozenset(earlier or ()))) for turns, earlier in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_part_columns(found)], names=["conv_id", "piece", *_FIELDS])


def _folded(batches):
    """conv_id, number, parts in order -> conv_id, number and their Part."""
    for batch in batches:
        found = [tree(_part(r) for r in rows) for rows in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_part_columns(found)], names=["conv_id", "number", *_FIELDS])


def _finished(batches):
    for batch in batches:
        done = [finish(_part(r)) for r in batch.select(_FIELDS).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([d[0][k] for d in done], pa.int64()) for k in range(len(COUNTS))), pa.array([d[1] for d in done], pa.string())], names=["conv_id", *COUNTS, "letters"])


def _sliced(batches):
    """conv_id, letters, pieces (piece, rows) in order -> conv_id, piece and its letters."""
    for batch in batches:
        for i in range(batch.num_rows):
            letters, pieces = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
            read = np.flatnonzero(~np.isin(np.frombuffer(letters.encode(), np.uint8), [ord(x) for x in INSERTED])) + 1
            ends = np.cumsum([p["rows"] for p in pieces])
            at = [0, *read[ends[:-1] - 1].tolist(), len(letters)]  # a piece ends behind its last row's letter, the last one with all
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(pieces))), pa.array([p["piece"] for p in pieces], pa.int64()), pa.array([letters[a:b] for a, b in zip(at[:-1], at[1:])])], names=["conv_id", "piece", "letters"])


def _applied(batches):
    for batch in batches:
        groups = [list(edited(_rows(turns), letters)) for turns, letters in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(groups)], names=["conv_id", "piece", "turns"])


def repair(turns: DataFrame, most_rows: int = PIECE_ROWS, most_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two tables of the conversations in ``turns`` (conv_id, turn, role, text):

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row a conversation;
    conv_id, piece, whole, turns (turn, role, text, edit): the repaired rows, in pieces by their
    order; ``whole`` marks conversations in one piece."""
    spark = turns.sparkSession
    T.lean(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    key = [StructField("conv_id", rows.schema["conv_id"].dataType)]
    order = lambda *last: [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), *last]
    # the range's bounds come to the driver: the beginnings of texts are enough for them
    dealt = rows.repartitionByRange(T.fold(spark), *order(F.asc(F.substring("text", 1, PREFIX)))).sortWithinPartitions(*order(F.asc("text")))
    schema = StructType([*key, StructField("piece", LongType()), StructField("whole", BooleanType()), *(StructField(c, LongType()) for c in COUNTS), StructField("letters", StringType()), StructField("turns", _TURNS)])
    pieces = T.materialize(dealt.mapInArrow(_pieces(most_rows, most_bytes), schema), "conversation-pieces")
    split = pieces.where("not whole").select("conv_id", "piece", "turns")
    scratch = T.Scratch(spark)
    try:
        summary, back = _scan(split, key, scratch)
        summary, back = T.materialize(summary, "conversation-sums"), T.materialize(back, "conversation-rows")
    finally:
        scratch.close()
    summary = pieces.where("whole").select("conv_id", *COUNTS, "letters").unionByName(summary)
    repaired = pieces.where("whole").select("conv_id", "piece", "whole", "turns").unionByName(back.withColumn("whole", F.lit(False)))
    return summary.select("conv_id", *COUNTS, F.translate("letters", "JS", "IR").alias("audit")), repaired


def _scan(split: DataFrame, key: list, scratch: T.Scratch) -> tuple[DataFrame, DataFrame]:
    """The conversations in several pieces: conv_id, COUNTS, letters; and conv_id, piece, repaired turns."""
    kinds = lambda fields: StructType([*key, *StructType.fromDDL(fields).fields])
    said = split.select("conv_id", "piece", F.explode("turns").alias("t")).select("conv_id", "piece", F.encode("t.role", "utf-8").alias("r"), F.encode("t.text", "utf-8").alias("x"))
    said = said.select("conv_id", "piece", F.unhex(F.sha2(F.concat(F.octet_length("r").cast("string").cast("binary"), F.lit(":").cast("binary"), "r", "x"), 256)).alias("digest")).distinct()
    said = scratch.save(said, "digests")
    first = said.groupBy("conv_id", "digest").agg(F.min("piece").alias("first"), F.max("piece").alias("last")).where("first < last")
    again = _with(said, first, "conv_id", "digest").where("piece > first")
    earlier = again.groupBy("conv_id", "piece").agg(F.collect_list("digest").alias("earlier"))
    one = _with(split, earlier, "conv_id", "piece", how="left").select("conv_id", "piece", "turns", "earlier")
    measured = scratch.save(one.mapInArrow(_measured, kinds("piece long, " + _PART)), "parts")
    numbers = measured.select("conv_id", "piece").withColumn("number", F.row_number().over(Window.partitionBy("conv_id").orderBy("piece")).cast("long") - 1)
    level = scratch.save(_with(measured, numbers, "conv_id", "piece").select("conv_id", "number", *_FIELDS), "level")
    last = level.agg(F.max("number")).first()[0] or 0
    while last > 0:
        last //= FAN
        groups = level.groupBy("conv_id", F.expr(f"number div {FAN}").alias("number")).agg(F.sort_array(F.collect_list(F.struct("number", *_FIELDS))).alias("parts"))
        level = scratch.save(groups.mapInArrow(_folded, kinds("number long, " + _PART)), "level")
    done = scratch.save(level.select("conv_id", *_FIELDS).mapInArrow(_finished, kinds(", ".join(f"{c} long" for c in COUNTS) + ", letters string")), "sums")
    counts = measured.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "rows"))).alias("pieces"))
    slices = _with(done, counts, "conv_id").select("conv_id", "letters", "pieces").mapInArrow(_sliced, kinds("piece long, letters string"))
    slices = scratch.save(slices, "slices")
    back = _with(split, slices, "conv_id", "piece").select("conv_id", "piece", "turns", "letters")
    return done, back.mapInArrow(_applied, StructType([*key, StructField("piece", LongType()), StructField("turns", _TURNS)]))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the sha256 of its repaired ``role:text`` lines; conversations in several pieces are
    read on end, piece by piece, and never gathered."""
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = repaired.where("whole").select("conv_id", F.sha2(line.cast("binary"), 256).alias("repaired_sha256"))
    rest = repaired.where("not whole").select("conv_id", "piece", F.when(F.size("turns") > 0, line).alias("lines"))

    def run(batches):
        done, conv, sha, filled = [], None, None, False
        schema = None
        for batch in batches:
            schema = batch.column(0).type
            for i in range(batch.num_rows):
                key, lines = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if sha is None or key != conv:
                    if sha is not None:
                        done.append((conv, sha.hexdigest()))
                    conv, sha, filled = key, hashlib.sha256(), False
                if lines is not None:
                    sha.update(b"\n" * filled + lines.encode())
                    filled = True
        if sha is not None:
            done.append((conv, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], schema), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])

    schema = StructType([StructField("conv_id", rest.schema["conv_id"].dataType), StructField("repaired_sha256", StringType())])
    return whole.unionByName(rest.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, schema))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, damaged as crc32 of "conv_id:turn" modulo 20 says: 0 drops a row,
    1 empties its text, 2 takes [.!?] out, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(fault == 4, "user").otherwise(said("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")
