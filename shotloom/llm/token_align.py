"""Alignment of two tokenizers' tokens by the bytes they cover.

Each text is encoded by a byte-level BPE (A, which gets a space and the text) and a piece BPE (B, which adds that space itself), as ordinary text throughout. Both
cut the same bytes into ranges. The starts and ends of B's ranges are a static interval index: two bisections for each A token find the B tokens it
overlaps, the first whose end lies behind its start to the last whose start lies before its end. Where the last of them ends with the A token, nothing
spans that place, and it is a boundary between groups. The tokens of both sides that end there are linked.

How often the corpus links a pair of ids is counted over all documents. The HOT = 65,536 most frequent pairs, a fixed bound, are sent to every task; a document's other
pairs are joined with the counts, whose keys are then rare ones. So a pair that a third of all links have never meets in one task, and no count of pairs is assumed.

Texts are encoded in pieces of about CHUNK characters, cut only where a letter of ASCII is followed by a space and another such letter: the first tokenizer always
splits there, and no piece of the second goes on over a space. So a very long text needs no more memory than its tokens; without such places it is one piece.

Defined results: texts that are null or empty, and those whose tokens don't spell a space and the text byte by byte on both sides (unknown or normalised characters), have no
tokens: zeros and an empty ``groups_sha256``. Of pairs with equal counts all are best. Repeated rows count each time, and keep a row each; null ids are carried along. An empty
table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm._words import discard, map_texts, only, settle, shared_folder

HOT = 1 << 16
CHUNK = 1 << 16
#: Fixed value: the pattern by which the byte-level tokenizer splits texts, published with it.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: those that are printable as themselves, the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, with the bytes of each of their ids."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        byte_of = _byte_of()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, n in vocabulary.items():
            self.bytes_a[n] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.fast = _by_ranks(json.loads(self.a.to_str()), self.bytes_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(k) for k in range(len(self.b))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) else p.replace("\u2581", " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        texts = ([f"{n}{end}" for end in ",|;" for n in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        self.texts = [x for side in texts for x in side]  # of A and then of B: each id before a comma, a bar, a semicolon
        self.splits = not any("\u2581" in p.lstrip("\u2581") for p in pieces)  # no piece goes on over a space

    def chunks(self, text: str) -> list[str]:
        """The text in pieces, the space between two of them left out."""
        out, at = [], 0
        while self.splits and len(text) - at > CHUNK and (m := _CUT.search(text, at + CHUNK)):
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of both for each text."""
        cut = [self.chunks(t) for t in texts]
        flat = [x for c in cut for x in c]
        spaced = [" " + x for x in flat]
        a = [self.fast.encode_ordinary(x) for x in spaced] if self.fast else [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        b = self.b.encode(flat, num_threads=1)
        out, at = [], 0
        for c in cut:
            out.append((a[at], b[at]) if len(c) == 1 else tuple([n for ids in side[at : at + len(c)] for n in ids] for side in (a, b)))
            at += len(c)
        return out

    def spell(self, text: bytes, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both are the bytes of a space and the text."""
        whole = b" " + text
        return b"".join([self.bytes_a[n] for n in a]) == whole and b"".join([self.bytes_b[n] for n in b]) == whole

    def align(self, encoded: list[tuple[list[int], list[int]]]) -> list[tuple[str, np.ndarray]]:
        """For texts that both spell: the groups written as a1,a2|b1;a3|b2,b3 and the linked pairs.

        The texts' tokens are laid end to end, so that one index serves them all; ends of texts are ends of groups.
        """
        if not encoded:
            return []
        a, b = (np.concatenate([np.array(x[side], np.int64) for x in encoded]) for side in (0, 1))
        last_a, last_b = boundaries(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        linked = a[last_a] << 32 | b[last_b]
        # tokens in the order in which they are written, and what follows each: a comma, a bar behind the last A of a group, a semicolon behind its last B
        code_a, code_b = a.copy(), b + 3 * len(self.bytes_a)
        code_a[last_a] += len(self.bytes_a)
        code_b[last_b] += 2 * len(self.bytes_b)
        group_a, group_b = (np.searchsorted(last, np.arange(len(side))) for last, side in ((last_a, a), (last_b, b)))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        pieces = np.concatenate([code_a, code_b])[order].tolist()
        ends_a, ends_b = (np.cumsum([len(x[side]) for x in encoded]) for side in (0, 1))
        out, token, group = [], 0, 0
        for end, until in zip((ends_a + ends_b).tolist(), np.searchsorted(last_a, ends_a).tolist(), strict=True):
            out.append(("".join([self.texts[k] for k in pieces[token:end]])[:-1], linked[group:until]))
            token, group = end, until
        return out


def _by_ranks(form: dict, bytes_of: list[bytes]):
    """The same tokenizer as byte-level ranks, which encode faster; None where it isn't one of merges in the order of their results' ids."""
    import tiktoken

    model, split = form["model"], form["pre_tokenizer"] or {}
    if model["type"] != "BPE" or form["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or model.get("ignore_merges"):
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["id"] for t in form["added_tokens"]}
    if merged != sorted(set(merged)) or len(merged) + 256 != len(set(model["vocab"].values()) - special) or not all(t["special"] for t in form["added_tokens"]):
        return None
    ranks = {x: n for n, x in enumerate(bytes_of) if x and n not in special}
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def boundaries(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last tokens (of A, of B) of the groups; ends of tokens that follow each other from byte 0."""
    first, last = stab(end_a, end_b)
    whole = np.flatnonzero(end_b[last] == end_a)
    return whole, last[whole]


def stab(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first and last B token that it overlaps, by bisection of the B tokens' ends and starts."""
    start_a, start_b = (np.concatenate([[0], e[:-1]]) for e in (end_a, end_b))
    return np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left") - 1


@functools.lru_cache(maxsize=2)
def _loaded(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(documents: DataFrame, a: str, b: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A row a document, with the distinct pairs that it links (A id * 2 ** 32 + B id) and how often."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        both = _loaded(a, b)
        some = [k for k, t in enumerate(texts) if t]
        encoded = zip(some, both.encode([texts[k].decode(errors="replace") for k in some]), strict=True)
        spelt = {k: ids for k, ids in encoded if both.spell(texts[k], *ids)}
        found = dict(zip(spelt, both.align(list(spelt.values())), strict=True))
        out: dict = {k: [] for k in ("n_a", "n_b", "n_groups", "groups_sha256")}
        pairs, times = [], []
        for k in range(len(texts)):
            groups, linked = found.get(k, ("", np.zeros(0, np.int64)))
            row = (len(spelt[k][0]), len(spelt[k][1]), len(linked), hashlib.sha256(groups.encode()).hexdigest()) if k in spelt else (0, 0, 0, "")
            for name, x in zip(out, row, strict=True):
                out[name].append(x)
            own, n = np.unique(linked, return_counts=True)
            pairs.append(own)
            times.append(n.astype(np.int32))
        ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
        return {"row": part.column(0), "doc_id": part.column(1), "pairs": pa.ListArray.from_arrays(ends, np.concatenate(pairs)), "times": pa.ListArray.from_arrays(ends, np.concatenate(times))} | out

    numbered = only(documents, id, text).toDF("doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(numbered, work, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how often the corpus links a pair, and whether no pair of its B id is linked more often."""
    each = rows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = each.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return each.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows with n_best and count_sum, the sums over their links."""
    hot = sorted(counts.orderBy(F.desc("n"), "pair").limit(HOT).collect())  # a fixed bound
    keys, n, best = (np.array([r[k] for r in hot], t) for k, t in (("pair", np.int64), ("n", np.int64), ("best", bool)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            ends = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            flat, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(keys, flat)
            known = np.zeros(len(flat), bool)
            inside = at < len(keys)
            known[inside] = keys[at[inside]] == flat[inside]
            row = np.repeat(np.arange(len(pairs)), np.diff(ends))
            total, good = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            np.add.at(total, row[known], often[known] * n[at[known]])
            np.add.at(good, row[known], often[known] * best[at[known]])
            left = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=len(pairs)))]).astype(np.int32)
            cold = [pa.ListArray.from_arrays(pa.array(left), pa.array(x)) for x in (flat[~known], often[~known])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(total), *cold], names=["row", "good", "total", "pairs", "times"])

    part = rows.select("row", "pairs", "times").mapInArrow(look_up, "row long, good long, total long, pairs array<long>, times array<long>")
    cold = part.select("row", F.inline(F.arrays_zip("pairs", "times"))).join(counts, F.col("pairs") == F.col("pair"))
    cold = cold.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("good"), (F.col("times") * F.col("n")).alias("total"))
    sums = part.select("row", "good", "total").unionByName(cold).groupBy("row").agg(F.sum("good").alias("n_best"), F.sum("total").alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row")


def alignment(documents: DataFrame, a: str, b: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    folder = shared_folder(documents.sparkSession)
    rows = settle(aligned(documents, a, b, text, id), folder, "aligned")
    counts = settle(pair_counts(rows), folder, "counts", release=True)
    out = settle(scored(rows, counts), folder, "scored", release=True)
    discard(documents.sparkSession, folder, "aligned", "counts")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
