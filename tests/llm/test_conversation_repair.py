"""Conversation repair against all edits of small conversations and a plain forward search."""

import hashlib
import itertools
import random
import zlib

import pytest

from lexspark.llm import conversation_repair as repair
from lexspark.llm import queries

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SAY = {"u": "user", "a": "assistant"}


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _edits(rows, faults, i, state, inserts):
    """All (cost, audit, lines) from row i on, with at most so many rows inserted."""
    if i == len(rows) and state in (0, 3):
        yield 0, "", ()
    if inserts:
        for x in "ua":
            if (state, x) in NEXT:
                for c, a, t in _edits(rows, faults, i, NEXT[state, x], inserts - 1):
                    yield c + 5, "I" + a, (SAY[x] + ":", *t)
    if i < len(rows):
        _, role, text = rows[i]
        for c, a, t in _edits(rows, faults, i + 1, state, inserts):
            yield c + 2, "D" + a, t
        if faults[i] not in ("blank", "duplicate"):
            more = 5 * (faults[i] == "truncated")
            if (state, role[:1]) in NEXT:
                for c, a, t in _edits(rows, faults, i + 1, NEXT[state, role[:1]], inserts):
                    yield c + more, "K" + a, (f"{role}:{text}", *t)
            for x in "ua":
                if (state, x) in NEXT:
                    for c, a, t in _edits(rows, faults, i + 1, NEXT[state, x], inserts):
                        yield c + 1 + more, "R" + a, (f"{SAY[x]}:{text}", *t)


def _search(rows, faults):
    """The same by a forward search over states."""
    at = {0: (0, "", ())}

    def put(to, k, v):
        if k not in to or v < to[k]:
            to[k] = v

    def closed(at):
        at = dict(at)
        for _ in range(3):
            for k, (c, a, t) in list(at.items()):
                for x in "ua":
                    if (k, x) in NEXT:
                        put(at, NEXT[k, x], (c + 5, a + "I", (*t, SAY[x] + ":")))
        return at

    for (_, role, text), fault in zip(rows, faults):
        new, more = {}, 5 * (fault == "truncated")
        for k, (c, a, t) in closed(at).items():
            put(new, k, (c + 2, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            if (k, role[:1]) in NEXT:
                put(new, NEXT[k, role[:1]], (c + more, a + "K", (*t, f"{role}:{text}")))
            for x in "ua":
                if (k, x) in NEXT:
                    put(new, NEXT[k, x], (c + 1 + more, a + "R", (*t, f"{SAY[x]}:{text}")))
        at = new
    end = closed(at)
    return min(end[k] for k in (0, 3) if k in end)


def _plain(rows):
    """rows (turn, role, text) in order -> what a summary and a digest say."""
    faults = _faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    cost, audit, lines = _search(rows, faults)
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


ROLES, TEXTS = ["system", "user", "assistant", "tool", ""], ["a.", "b", " ", "c! ", "d?", "a", "e.", ""]


def test_matrices_are_all_edits():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4):
        for _ in range(60):
            rows = [(i, rnd.choice(ROLES), rnd.choice(TEXTS)) for i in range(n)]
            faults = _faults(rows)
            want = min(_edits(rows, faults, 0, 0, 3))
            assert _search(rows, faults) == want
            if n:
                counts, letters = repair.finish(repair.tree(repair.parts(rows)))
                assert (counts[-1], letters.translate(str.maketrans("JS", "IR"))) == want[:2]
                assert tuple(f"{r}:{t}" for _, r, t, _ in repair.edited(rows, letters)) == want[2]


def test_products_are_associative():
    rnd = random.Random(2)
    for _ in range(40):
        parts = [next(repair.parts([(0, rnd.choice(ROLES), rnd.choice(TEXTS))])) for _ in range(rnd.randint(1, 30))]
        whole = repair.tree(parts)
        left = parts[0]
        for p in parts[1:]:
            left = repair.joined(left, p)
        cut = rnd.randint(0, len(parts) - 1)
        split = repair.joined(repair.tree(parts[:cut]), repair.tree(parts[cut:])) if cut else whole
        assert whole == left == split


def _order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def _got(df):
    summary, repaired = df
    digests = {r.conv_id: r.repaired_sha256 for r in repair.digests(repaired).collect()}
    got = {r.conv_id: (*(r[c] for c in repair.COUNTS), r.audit, digests[r.conv_id]) for r in summary.collect()}
    assert set(got) == set(digests)
    return got


@pytest.mark.parametrize("most", [repair.PIECE_ROWS, 3, 1])
def test_repair_is_plain_search(spark, most):
    rnd = random.Random(3)
    convs = {c: [(rnd.choice([None, i, i, i + 2]), rnd.choice(ROLES[:3] * 4 + ROLES), rnd.choice(TEXTS) + rnd.choice(["", str(i), str(i) + "."])) for i in range(n)] for c, n in [(1, 90), (2, 1), (3, 0), (4, 7), (None, 5), (5, 6), (-1, 2), *((i, rnd.randint(1, 6)) for i in range(10, 40))]}
    convs[6] = [(None, "user", "x")] * 5
    convs[7] = [(0, "user", " ")] * 3
    convs[8] = [(0, "user", "hello. "), (1, "assistant", "y" * 30_000)]
    rows = [(c, *r, "mine", "mine") for c, own in convs.items() for r in own]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, piece string").repartition(3)
    assert _got(repair.repair(df, most_rows=most)) == {c: _plain(_order(own)) for c, own in convs.items() if own}


def test_pieces_by_bytes_and_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(repair, "FAN", 2)
    rows = [(i, "user" if i % 2 else "assistant", f"text {i % 50}.") for i in range(120)]
    df = spark.createDataFrame([("a", *r) for r in rows], "conv_id string, turn int, role string, text string")
    assert _got(repair.repair(df, most_bytes=40)) == {"a": _plain(rows)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert _got(repair.repair(df)) == {}


def test_query_with_nulls(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(c, rnd.choice([None, i]), rnd.choice([None, "system", "user", "assistant"]), rnd.choice([None, "x.", "y! z", "w?", " "])) for c in [None, *range(60)] for i in range(rnd.randint(1, 5))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        own = want.setdefault(c, [])
        if f:
            text = "" if f == 1 else text.translate(str.maketrans("", "", ".!?")) if f == 2 else text
            own += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    got = {r.conv_id: tuple(r[1:]) for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: _plain(_order(own)) for c, own in want.items()}
