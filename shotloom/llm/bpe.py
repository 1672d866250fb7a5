"""Byte-level BPE over a published rank table, merged with segment trees.

A piece is a list of byte positions. The tree's leaves are the positions, each holding the rank of the pair that starts
there (or NONE); an inner node holds the minimum of its children, ties to the left. The root then names the leftmost pair of
least rank. A merge keeps the left position, unlinks the right one, and repairs three leaves (the merged position, its
live left neighbour and the unlinked one), each in a logarithmic number of steps.

Two forms of the same tree exist. ``merge_long`` walks one tree for one piece of any length. ``merge_batch`` holds the
trees of many short pieces as rows of one array and does each step for all of them at once; it serves the pieces of at
most SHORT bytes, which are nearly all. Short pieces, and short runs of them, are memorised
in tables whose bytes are bounded for each worker; long ones, whole texts among them, are not.

Defined results: a null or empty text has 0 tokens; its ids_sha256 and decoded_sha256 are those of the empty string.
Rows are independent, so repeated rows give equal results and an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shotloom.llm._words import map_texts, only

NONE = 1 << 30
SHORT = 32
BATCH = 1024
#: The greatest length of a memo's key and value together, and about what an entry takes besides.
MEMORISED, ENTRY = 1024, 200


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file's table: base64 of the token, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentBPE:
    """Encoder and decoder for one rank table; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 128 << 20) -> None:
        import regex

        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        bits = max(4, (len(self.pairs) * 4).bit_length())
        self._shift = np.uint64(64 - bits)
        keys = np.fromiter(self.pairs, np.uint64, len(self.pairs))
        values = np.fromiter(self.pairs.values(), np.int64, len(self.pairs))
        self._slot_key = np.full((1 << bits) + 64, -1, np.int64)
        self._slot_value = np.full((1 << bits) + 64, NONE, np.int64)
        at = self._slot(keys)
        left = np.arange(len(keys))
        self._probes = 0
        while len(left):  # linear probing, one displacement a round
            where = at[left] + self._probes
            free = self._slot_key[where] == -1
            _, first = np.unique(where, return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            self._slot_key[where[won]] = keys[left[won]].astype(np.int64)
            self._slot_value[where[won]] = values[left[won]]
            left = left[~won]
            self._probes += 1
        self.first = np.array([[self.pairs.get(int(a) << 32 | int(b), NONE) for b in self.byte_id] for a in self.byte_id], np.int32)
        self.cache: dict[str, str] = {}
        self.units: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {"": b""}
        self.memory, self.held = memory, 0  # bytes that the memos of pieces and units may hold, and about what they hold
        self.joined = re.compile(r"\s ").search
        self.text_of = {str(r): t for r, t in self.tokens.items()}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = self._slot(key.astype(np.uint64))
        out = np.full(len(key), NONE, np.int64)
        todo = np.arange(len(key))
        for k in range(self._probes):
            where = at[todo] + k
            found = self._slot_key[where]
            hit = found == key[todo]
            out[todo[hit]] = self._slot_value[where[hit]]
            todo = todo[~hit & (found != -1)]
            if not len(todo):
                break
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        size = 1 << max(0, (n - 1).bit_length())
        ids = [int(x) for x in self.byte_id[np.frombuffer(piece, np.uint8)]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = pairs.get(ids[i] << 32 | ids[i + 1], NONE)
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, rank: int) -> None:
            k = size + i
            tree[k] = rank
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] != NONE:
            rank, k = tree[1], 1
            while k < size:
                k = 2 * k if tree[2 * k] == rank else 2 * k + 1
            i = k - size
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, NONE)
            put(i, pairs.get(rank << 32 | ids[after[i]], NONE) if after[i] < n else NONE)
            if before[i] >= 0:
                put(before[i], pairs.get(ids[before[i]] << 32 | rank, NONE))
        return [x for x in ids if x >= 0]

    def merge_batch(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """The ids of pieces of 1 to ``size`` bytes; ``size`` is a power of two."""
        m = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, m)
        flat = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        at = np.arange(size)
        inside = at < length[:, None]
        ids = np.where(inside, self.byte_id[flat], -1)
        after = np.broadcast_to(at + 1, (m, size)).copy()
        before = np.broadcast_to(at - 1, (m, size)).copy()
        tree = np.full((m, 2 * size), NONE, np.int32)
        tree[:, size:-1] = np.where(inside[:, 1:], self.first[flat[:, :-1], flat[:, 1:]], NONE)
        k = size
        while k > 1:
            h = k >> 1
            tree[:, h:k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k = h

        flat_tree, flat_ids, flat_after, flat_before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        levels = size.bit_length() - 1

        def put(rows: np.ndarray, cols: np.ndarray, ranks: np.ndarray | int) -> None:
            base = rows * (2 * size)
            k = cols + size
            flat_tree[base + k] = ranks
            for _ in range(levels):
                own = base + (k & -2)
                k = k >> 1
                flat_tree[base + k] = np.minimum(flat_tree[own], flat_tree[own + 1])

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            base = rows * (2 * size)
            rank = flat_tree[base + 1]
            k = np.ones(len(rows), np.int64)
            for _ in range(levels):
                k = 2 * k
                k += flat_tree[base + k] != rank
            cell = rows * size
            i = k - size
            j = flat_after[cell + i]
            follow = flat_after[cell + j]
            flat_ids[cell + i] = rank
            flat_ids[cell + j] = -1
            flat_after[cell + i] = follow
            has = follow < length[rows]
            flat_before[cell[has] + follow[has]] = i[has]
            put(rows, j, NONE)
            left = flat_before[cell + i]
            back = left >= 0
            rank = rank.astype(np.int64)
            a = np.concatenate([rank[has], flat_ids[cell[back] + left[back]]])
            b = np.concatenate([flat_ids[cell[has] + follow[has]], rank[back]])
            found = self.pair_rank(a, b)
            new = np.full(len(rows), NONE, np.int64)
            new[has] = found[: has.sum()]
            put(rows, i, new)
            put(rows[back], left[back], found[has.sum() :])
            rows = rows[flat_tree[base + 1] != NONE]
        live = ids >= 0
        ends = np.cumsum(live.sum(1))
        out = ids[live].tolist()
        return [out[b:e] for b, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def keep(self, memo: dict, new: dict) -> None:
        """Add to a memo what is short; ``forget`` empties the memos when they hold too much."""
        short = {k: v for k, v in new.items() if len(k) + len(v) <= MEMORISED}
        memo.update(short)
        self.held += sum(map(len, short)) + sum(map(len, short.values())) + ENTRY * len(short)

    def forget(self) -> None:
        if self.held > self.memory:
            self.cache.clear()
            self.units.clear()
            self.held = 0

    def learn(self, pieces: Iterable[str]) -> dict[str, str]:
        """The pieces' decimal ids joined by commas; those that the memo lacks are encoded."""
        known = self.cache
        out = {p: known[p] for p in pieces if p in known}
        new = [p for p in pieces if p not in out]
        found: dict[str, str] = {}
        groups: dict[int, list[str]] = {}
        for p in new:
            raw = p.encode()
            whole = self.ranks.get(raw)
            if whole is not None:  # a piece that is itself in the table is one token, as in the published library
                found[p] = str(whole)
            elif len(raw) > SHORT:
                found[p] = ",".join(map(str, self.merge_long(raw)))
            else:
                groups.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append(p)
        for size, own in groups.items():
            for k in range(0, len(own), BATCH):
                part = own[k : k + BATCH]
                for p, ids in zip(part, self.merge_batch([p.encode() for p in part], size), strict=True):
                    found[p] = ",".join(map(str, ids))
        self.keep(known, found)
        return out | found

    def encode_units(self, texts: list[str]) -> list[list[str]]:
        """For each text its units' ids, each unit decimal and joined by commas.

        A unit is what stands between two spaces, with the space before it. Where every space follows a character that isn't
        white space, no match of the pattern crosses a unit's start, so units can be encoded apart and memorised if short; other
        texts are one unit, which isn't memorised.
        """
        cut = [[t] if self.joined(t) else [t[:k], *t[k + 1 :].split(" ")] if (k := t.find(" ")) >= 0 else [t] for t in texts]
        self.forget()
        known, heads, fresh, pieces = self.units, {}, {}, {}
        for parts in cut:
            heads[parts[0]] = self.split(parts[0])
            for u in set(parts[1:]).difference(known):
                fresh[u] = self.split(" " + u)
        for group in (heads, fresh):
            for found in group.values():
                pieces.update(dict.fromkeys(found))
        one = self.learn(pieces).__getitem__
        head = {u: ",".join(map(one, found)) for u, found in heads.items()}
        now = {u: ",".join(map(one, found)) for u, found in fresh.items()}
        self.keep(known, now)
        far = {u: ids for u, ids in now.items() if u not in known}  # too long for the memo
        if far:
            return [[head[parts[0]], *(far[u] if u in far else known[u] for u in parts[1:])] for parts in cut]
        return [[head[parts[0]], *map(known.__getitem__, parts[1:])] for parts in cut]

    def decode_units(self, units: list[str]) -> bytes:
        """The bytes of runs of ids, token by token: a memo of runs would take room from those of pieces and units, whose entries cost more to find again."""
        ids = ",".join(filter(None, units))
        return self.decoded[ids] if ids in self.decoded else b"".join(map(self.text_of.__getitem__, ids.split(",")))

    def encode(self, text: str) -> list[int]:
        return [int(x) for u in self.encode_units([text])[0] if u for x in u.split(",")]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


#: The codec of this worker process; its memo serves all tasks that the process runs.
_OWN: dict[tuple[str, str], SegmentBPE] = {}


def encode_decode(documents: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Encode each text, then decode its ids.

    The rank file (under 1 MB) is read on the driver and shipped with the task. Returns doc_id, n_tokens, ids_sha256,
    decoded_sha256, and the ids themselves with keep_ids.
    """
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(open(path, "rb").read())

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        codec = _OWN.get((path, pattern))
        if codec is None:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.value.splitlines() if line.strip())}
            _OWN.clear()
            codec = _OWN[path, pattern] = SegmentBPE(ranks, pattern)
        units = codec.encode_units([t.decode() for t in texts])
        ids = [",".join(filter(None, u)) for u in units]
        out = {
            "doc_id": part.column(0),
            "n_tokens": [x.count(",") + 1 if x else 0 for x in ids],
            "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(codec.decode_units(u)).hexdigest() for u in units],
        }
        if keep_ids:
            out["ids"] = [[int(y) for y in x.split(",")] if x else [] for x in ids]
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_texts(only(documents, id, text), work, schema, text)
