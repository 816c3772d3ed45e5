"""Byte-pair encoding by a compiled tokenization automaton.

The merges of a byte-level BPE vocabulary are compiled, one after another, by the
merge gadget of a tokenization DFA over token arcs: merge ``(u, v) -> uv`` gives every
state that has an arc ``u`` an arc ``uv`` to the state behind ``v``, and the state behind
``u`` is replaced by a copy without arc ``v``.  All arcs with one label lead to one state,
so a state is named by its last token and the gadgets are kept as three arrays (parents,
time of creation) instead of 50,000 x 50,000 table cells; ``_allowed`` reads an arc off
them.  That machine over tokens, composed with the vocabulary's byte trie, gives a
deterministic automaton over bytes whose states and transitions are tabled when they are
first needed: encoding a pre-split word is one table step per byte and a walk back over
the final states' arc labels.  Decoding emits arc labels.

Null texts count as empty.  Empty texts have 0 tokens and the digests of no bytes.  Extra
columns are ignored, repeated rows are encoded once each, ids and decoded texts are not
kept by the digest query but ``encode`` returns them.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm import _text as T

MAX_STATES = 200_000
MAX_WORDS = 150_000
#: Arcs between tokens that are looked up often; the caches together stay under 250 MB a worker.
MAX_ARCS = 250_000
MAX_CACHED_BYTES = 24
SLICE = 750_000

# Fixed values of byte-level vocabularies: printable bytes stand for themselves, the
# others for the code points from 256 on, in order; contractions split before all else.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _byte_of_char() -> dict[str, int]:
    out = {chr(b): b for b in _PRINTABLE}
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled vocabulary. ``encode_word`` takes bytes of a pre-split word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_of_char()
        vocab = spec["model"]["vocab"]
        self.label: list[bytes] = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.label[i] = bytes(chars[c] for c in token)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for content, i in self.added.items():
            self.label[i] = content.encode()
        n = len(self.label)
        self.born, self.left, self.right = [0] * n, [-1] * n, [-1] * n
        self.merge: dict[tuple[int, int], int] = {}
        self.usable = [len(x) == 1 for x in self.label]
        self.memo: dict[tuple[int, int], bool] = {}
        for time, pair in enumerate(spec["model"]["merges"], 1):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[u], vocab[v], vocab[u + v]
            self._gadget(a, b, c, time)
        self.memo.clear()
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for i in vocab.values():
            if self.usable[i]:
                node = 0
                for byte in self.label[i]:
                    nxt = self.trie[node].get(byte)
                    if nxt is None:
                        nxt = self.trie[node][byte] = len(self.trie)
                        self.trie.append({})
                        self.token_at.append(-1)
                    node = nxt
                self.token_at[node] = i
        self.length = np.array([len(x) for x in self.label], np.int64)
        self.label_first = np.concatenate([[0], np.cumsum(self.length)])
        self.label_bytes = np.frombuffer(b"".join(self.label), np.uint8)
        self._reset()
        self.words: dict[bytes, tuple[int, ...]] = {}

    # -- the machine over tokens

    def _gadget(self, u: int, v: int, uv: int, time: int) -> None:
        self.usable[uv] = self.usable[u] and self.usable[v] and self._allowed(u, v)
        self.born[uv], self.left[uv], self.right[uv] = time, u, v
        self.merge[u, v] = time

    def _allowed(self, x: int, y: int, before: int = 1 << 60) -> bool:
        """Has the state behind x an arc y, of the gadgets applied before a time?"""
        born, left, right, merge = self.born, self.left, self.right, self.merge
        while True:
            if merge.get((x, y), 1 << 60) < before:
                return False
            a, b = born[x], born[y]
            if a == 0 and b == 0:
                return True
            if a > b:
                x, before = right[x], a
            elif b > a:
                if x == left[y] == right[y]:
                    return False
                y, before = left[y], b
            else:
                x, y, before = right[x], left[y], a

    def _arc(self, x: int, y: int) -> bool:
        got = self.memo.get((x, y))
        if got is None:
            if len(self.memo) >= MAX_ARCS:
                self.memo.clear()
            got = self.memo[x, y] = self._allowed(x, y)
        return got

    # -- the machine over bytes

    def _reset(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]
        self.active: list[tuple] = [()]
        self.number = {(-1, ()): 0}

    def _next(self, state: int, byte: int) -> int:
        last, found, keep = self.last[state], -1, []
        for node, token in (*self.active[state], (0, last)):
            child = self.trie[node].get(byte)
            if child is not None:
                t = self.token_at[child]
                if t >= 0 and found < 0 and (token < 0 or self._arc(token, t)):
                    found = t
                if self.trie[child]:
                    keep.append((child, token))
        key = (found, tuple(keep))
        new = self.number.get(key)
        if new is None:
            new = self.number[key] = len(self.last)
            self.last.append(found)
            self.active.append(key[1])
            self.step.append({})
        self.step[state][byte] = new
        return new

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        out = self.words.get(word)
        if out is not None:
            return out
        if len(self.last) > MAX_STATES:
            self._reset()
        state, path, step, last = 0, [], self.step, self.last
        for byte in word:
            nxt = step[state].get(byte)
            state = self._next(state, byte) if nxt is None else nxt
            path.append(last[state])
        at, ids, label = len(word), [], self.label
        while at:
            t = path[at - 1]
            ids.append(t)
            at -= len(label[t])
        out = tuple(reversed(ids))
        if len(word) <= MAX_CACHED_BYTES:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            self.words[word] = out
        return out

    def encode(self, texts: list[str], added: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's ids start (n+1 long)."""
        parts, special = [], []
        owner = []
        for row, text in enumerate(texts):
            pieces = self._split_added(text) if added and any(a in text for a in self.added) else [text]
            for p in pieces:
                special.append(p if isinstance(p, int) else -1)
                parts.append("" if isinstance(p, int) else p)
                owner.append(row)
        joined = "".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        off = np.concatenate([[0], np.cumsum(lengths)])
        ids, n_ids = np.zeros(0, np.int64), np.zeros(len(parts), np.int64)
        if joined:
            code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            cut = presplit(code, off)
            end = np.append(cut[1:], len(code))
            run = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(T.mix(code.astype(np.uint64) + np.uint64(1)) * T.powers(T._BASE, len(code)), out=run[1:])
            key = T.mix((run[end] - run[cut]) * T.powers(T._INV, len(code))[cut] + (end - cut).astype(np.uint64))
            _, some, which = np.unique(key, return_index=True, return_inverse=True)
            coded = [self.encode_word(joined[a:b].encode()) for a, b in zip(cut[some].tolist(), end[some].tolist())]
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter((i for c in coded for i in c), np.int64, int(size.sum()))
            ids = _gather(flat, np.concatenate([[0], np.cumsum(size)]), which)
            upto = np.concatenate([[0], np.cumsum(size[which])])
            n_ids = np.diff(upto[np.searchsorted(cut, off)])
        mark = np.array(special, np.int64)
        if len(mark) and (mark >= 0).any():
            places = np.concatenate([[0], np.cumsum(n_ids)])[:-1][mark >= 0]
            ids = np.insert(ids, places, mark[mark >= 0])
            n_ids = n_ids + (mark >= 0)
        counts = np.bincount(np.array(owner, np.int64), n_ids, len(texts)).astype(np.int64) if owner else np.zeros(len(texts), np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _split_added(self, text: str) -> list:
        out = []
        for p in regex.split("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")", text):
            if p:
                out.append(self.added.get(p, p))
        return out

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emit the arc labels of ids: their bytes, and where each id's bytes start."""
        return _gather(self.label_bytes, self.label_first, ids), np.concatenate([[0], np.cumsum(self.length[ids])])


def _gather(flat: np.ndarray, first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The lists flat[first[w]:first[w+1]] for w in which, on end."""
    size = np.diff(first)[which]
    upto = np.cumsum(size)
    if not len(upto) or not upto[-1]:
        return flat[:0]
    return flat[np.repeat(first[:-1][which] - (upto - size), size) + np.arange(upto[-1])]


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, by code point."""
    out = np.full(0x110000, 2, np.uint8)
    ranges = ((0, 0xD800), (0xE000, 0x110000))
    for kind, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
        for a, b in ranges:
            for m in regex.finditer(pattern, "".join(map(chr, range(a, b)))):
                out[a + m.start() : a + m.end()] = kind
    return out


def presplit(code: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where words start: runs of letters, numbers or others, each with one space before it,
    contractions apart, and white space up to the last character before a word."""
    n = len(code)
    kind = _classes()[code]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = edge[:n].copy()
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == 3
    # the last white space before a word: a plain space joins the word, another stands alone
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    at = np.flatnonzero(before)
    start[at] = True
    joins = at[code[at] == 0x20]
    start[joins + 1] = False
    quote = np.flatnonzero((code == 0x27) & start)
    for i in quote.tolist():
        if i + 1 < n and not edge[i + 1] and kind[i + 1] == 0:
            for c in CONTRACTIONS:
                k = len(c)
                if i + k <= n and not edge[i + 1 : i + k].any() and "".join(map(chr, code[i : i + k].tolist())) == c:
                    start[i + 1 : i + k] = False
                    if i + k < n and (kind[i + k] == 0 or edge[i + k]):
                        start[i + k] = True
                    break
    return np.flatnonzero(start)


def size(path: str) -> int:
    """One more than the largest id of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])])


@lru_cache(2)
def automaton(path: str) -> Automaton:
    return Automaton(path)


T.HELD.append(automaton)


def encode(docs: DataFrame, tokenizer: str, texts: bool = False, digests: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns doc_id, n_tokens and either the digests of ids and decoded text, or
    (``texts``) also the ids and the decoded text themselves.  No shuffle: one narrow pass.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")

    def run(batches):
        machine = automaton(tokenizer)
        for batch in batches:
            for part in T.slices(batch, most=SLICE, own=automaton):
                ids, first = machine.encode([x or "" for x in part.column(1).to_pylist()])
                raw, at = machine.decode_bytes(ids)
                packed, text_at = ids.astype("<u4"), at[first]
                blobs = [packed[a:b].data for a, b in zip(first[:-1], first[1:])]
                decoded = [raw[a:b].tobytes() for a, b in zip(text_at[:-1], text_at[1:])]
                # bytes that are not UTF-8 cannot arise from whole texts, but decode as the library does
                decoded = [d if _valid(d) else d.decode("utf-8", "replace").encode() for d in decoded]
                cols = [part.column(0), pa.array(np.diff(first)), pa.array([hashlib.sha256(x).hexdigest() for x in blobs]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                if texts:
                    cols += [pa.array([packed[a:b].astype(np.int32) for a, b in zip(first[:-1], first[1:])], pa.list_(pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in schema.split(", ")])

    T.lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True
