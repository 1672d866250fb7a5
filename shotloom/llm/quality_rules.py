"""Quality rules as a bitmask ledger.

``measure`` takes every measurement in one pass over the texts. ``ledger`` evaluates every rule once and stores the failures as
bits beside the measurements. ``apply_policy`` decides by one AND with a policy's mask, so a new policy version needs neither
texts nor rules; ``ablation`` counts, from the bits alone, what each rule of a policy removes by itself.

Defined results: a null or empty text has no words and measures 0 everywhere, so it fails ``short``. Repeated rows give equal
rows; an empty table gives an empty ledger and an ablation of zeros; further columns of the input are not carried.
Lines are equal when their bytes are; the first of equal lines is not counted as a duplicate.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm._words import U64, Words, map_texts, only, windows

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_bangs long"

#: Each rule: its bit, its name and when a document fails it, in integers so that every engine agrees.
RULES: tuple[tuple[str, str], ...] = (
    ("short", "n_words < 20"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("capitals", "100 * n_upper > 50 * n_letters"),
    ("bangs", "100 * n_bangs > 25 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
)

#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("short", "repeats"),
    "v1": ("short", "repeats", "symbols"),
    "v2": ("short", "repeats", "symbols", "capitals", "bangs", "dup_lines", "long_words"),
}


def mask(rules: tuple[str, ...]) -> int:
    bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return reduce(lambda a, b: a | bits[b], rules, 0)


def repeated(h: np.ndarray, size: int = WINDOW) -> int:
    """How many words lie in a window of ``size`` words that occurs twice or more."""
    w = windows(h, size)
    if len(w) < 2:
        return 0
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(w), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicates(text: bytes) -> tuple[int, int]:
    """Lines with a word; those among them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def _measure(part: pa.RecordBatch, texts: list[bytes]) -> dict:
    w = Words(texts)
    buf = w.buf
    bound = w.offset

    def count(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, bound[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)

    upper = (buf >= 65) & (buf <= 90)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    lines = [duplicates(t) for t in texts]
    return {
        "doc_id": part.column(0),
        "n_words": np.diff(w.first),
        "word_chars": count(~space & ((buf & 0xC0) != 0x80)),
        "n_symbols": count(_SYMBOL[buf]),
        "n_lines": [x[0] for x in lines],
        "n_dup_lines": [x[1] for x in lines],
        "n_repeat_words": [repeated(w.hash[a:b].astype(U64)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)],
        "n_upper": count(upper),
        "n_letters": count(upper | ((buf >= 97) & (buf <= 122))),
        "n_bangs": count(buf == 33),
    }


def measure(documents: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    return map_texts(only(documents, id, text), _measure, MEASURES, text)


def ledger(measured: DataFrame) -> DataFrame:
    """The measurements and ``failures``, a long with the bit of each failed rule."""
    bits = reduce(Column.bitwiseOR, (F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, test) in enumerate(RULES)))
    return measured.withColumn("failures", bits)


def apply_policy(ledgered: DataFrame, version: str, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """base_failed, and kept by the policy; a document that the base rejects is never kept."""
    base, own = mask(policies["base"]), mask(policies[version])
    return ledgered.withColumns({"base_failed": F.col("failures").bitwiseAND(F.lit(base)) != 0, "kept": F.col("failures").bitwiseAND(F.lit(base | own)) == 0})


def ablation(ledgered: DataFrame, version: str, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, and those that only it removes.

    The ledger is first counted by its masked bits, so what is shuffled is bounded by the number of bit patterns.
    """
    whole = mask(policies[version])
    counted = ledgered.groupBy(F.col("failures").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    aggregates = []
    for name in policies[version]:
        bit = mask((name,))
        aggregates.append(F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("n"))), F.lit(0)).alias(f"{name}_fails"))
        aggregates.append(F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), F.lit(0)).alias(f"{name}_alone"))
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"{n}_fails").alias("fails"), F.col(f"{n}_alone").alias("only_by_it")) for n in policies[version]))
    return counted.agg(*aggregates).select(F.inline(rows))
