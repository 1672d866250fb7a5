"""Near-duplicate detection with HyperMinHash sketches.

A document is the set of its distinct word shingles. Each element is hashed to one of BUCKETS = 252 buckets and to a number there; a bucket's register
describes the least number by its count of leading zeros (5 bits) and the 4 bits after its first one, so a document's sketch takes 9 bits a bucket,
whatever its length. Registers are stored in sixes with a free bit each, which makes a long.

1. Equal sets become one class, aggregated before the shuffle.
2. Banding: each six registers are a band, and its long is a signature unless all six are empty. Sets with a similarity of 0.85 have a band in common but for a
   chance of (1 - 0.85 ** 6) ** 42, about 2e-9. Sets with few elements differ in so few bands that they always share one in which both have elements.
3. A signature's classes have a centre, with which each of them is compared; components follow; then pairs that share a signature but no component yet
   meet. That part, and how it stays linear in large groups, is ``ngram_join.link``: no cap on candidates, and no texts of all pairs of a group.
4. Before texts move, two sketches decide whether a pair may link. Exactly: each register in which they differ stands for an element of one set alone, so
   no more may differ than the sets of a linked pair do. And by the estimate of the similarity, the share m / u of equal registers among
   those that either set fills, corrected for accidental equality: two different least numbers agree in a register with a probability of about
   0.17 * 4ab / (a + b) ** 2 / 2 ** 4 for sets of the sizes a and b. A pair is left out where an estimate that low has a chance under exp(-25) at the
   threshold (Chernoff's bound). Where a whole signature's classes meet, the parities of ``ngram_join.sketch`` come first, as they are short and exact; for
   sets of together up to SMALL elements they leave out more than an estimate of 252 registers may, so that follows for larger ones only.
5. The remaining pairs are confirmed on the full sets of their texts, so no link is false.

Defined results: case is folded for A-Z only. A null or empty text, or one without words, has 0 shingles, links with nothing and is kept. Repeated rows are equal
sets and share a component; rows with one doc_id are all kept or none. A null id takes part through its text, its component is the least id linked with it, and it
is kept only where there is none. An empty table gives an empty one. Texts of any length are taken whole; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm import ngram_join
from shotloom.llm._words import U64, mix

BUCKETS = 252
MANTISSA = 4
#: Registers of a band, which are one long, and the bits of each there.
BAND, LANE = 6, 10
#: The natural logarithm of the chance with which the estimate may leave out a pair at the threshold.
LOSS = -25.0
#: The share of accidental equality of registers, before the correction for sizes.
ACCIDENT = 0.169919487159739


#: Elements of two sets up to which 512 parities tell differences well.
SMALL = 2048


def registers(s: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes: 0 for an empty bucket, else leading zeros of the least value there, inverted so that a lower value has a
    greater register, and the bits after its first one."""
    out = np.zeros(BUCKETS, np.int64)
    if not len(s):
        return out
    v = mix(s + U64(0x51ED270B7A4F3C15))
    at, low = ((v >> U64(48)) * U64(BUCKETS) >> U64(16)).astype(np.int64), mix(v) >> U64(7)
    least = np.full(BUCKETS, U64((1 << 64) - 1))
    np.minimum.at(least, at, low)
    filled = np.flatnonzero(np.bincount(at, minlength=BUCKETS))
    x = np.maximum(least[filled], U64(1 << 26))  # values below have 30 leading zeros of 57 bits and more
    length = np.zeros(len(x), np.int64)  # of the binary form
    rest = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        more = rest >> U64(step) > 0
        length[more] += step
        rest[more] >>= U64(step)
    mantissa = (x >> (length - MANTISSA).astype(U64)).astype(np.int64) & ((1 << MANTISSA) - 1)
    out[filled] = (57 - length) << MANTISSA | mantissa  # length counts the bits after the first one
    return out


def packed(r: np.ndarray) -> np.ndarray:
    """Registers in sixes, in longs."""
    return (r.reshape(-1, BAND) << (np.arange(BAND) * LANE)).sum(1)


def _differing(x: Column) -> Column:
    """How many registers of a long aren't 0; the free bits take up the carries."""
    ones = sum((1 << (LANE - 1)) - 1 << (LANE * k) for k in range(BAND))
    free = sum(1 << (LANE * k + LANE - 1) for k in range(BAND))
    return F.bit_count((x + F.lit(ones)).bitwiseAND(F.lit(free)))


def counts(a: str | Column, b: str | Column) -> Column:
    """Of two packed sketches: 1,024 times the number of registers that either fills, and the number of those that differ."""
    both = F.zip_with(a, b, lambda x, y: 1024 * _differing(x.bitwiseOR(y)) + _differing(x.bitwiseXOR(y)))
    return F.aggregate(both, F.lit(0), lambda total, x: total + x)


def similarity(found: Column, size_a: str, size_b: str) -> tuple[Column, Column, Column]:
    """From the counts: registers that differ, registers that either fills, and the corrected estimate of the Jaccard similarity."""
    apart, filled = found % 1024, F.shiftright(found, 10)
    m, n = F.col(size_a).cast("double"), F.col(size_b).cast("double")
    accident = 4 * m * n / ((m + n) * (m + n)) * (ACCIDENT / (1 << MANTISSA))
    share = (filled - apart) / F.greatest(filled, F.lit(1))
    return apart, filled, F.greatest((share - accident) / (1 - accident), F.lit(0.0))


def _registers(bits: str) -> Column:
    return F.slice(bits, ngram_join.SKETCH + 1, BUCKETS // BAND)


class HyperMinHash:
    """The scheme of signatures and sketches for ``ngram_join.link``."""

    small = SMALL

    def __init__(self, percent: int = 85) -> None:
        self.percent = percent

    @staticmethod
    def sketch(s: np.ndarray) -> np.ndarray:
        """The parities and the registers."""
        return np.concatenate([ngram_join.sketch(s), packed(registers(s))])

    def signed(self, classes: DataFrame, width: int, passes: int = 1, turn: int = 0) -> DataFrame:
        """(sign, node): each band of each class; a band without elements has none."""
        bands = classes.select("node", F.posexplode(_registers("bits")).alias("band", "value")).where("value <> 0")
        rows = bands.select(F.xxhash64("band", "value").alias("sign"), "node")
        return rows.where(F.pmod(F.shiftrightunsigned("sign", 40), F.lit(passes)) == turn) if passes > 1 else rows

    def close(self) -> Column:
        """Whether sets of the sizes an and bn with the sketches abits and bbits may link."""
        p = self.percent / 100

        def may(found: Column) -> Column:
            apart, filled, share = similarity(found, "an", "bn")
            x = F.least(F.greatest(share, F.lit(1e-9)), F.lit(1 - 1e-9))
            unlikely = (share < p) & (-filled * (x * F.log(x / p) + (1 - x) * F.log((1 - x) / (1 - p))) < LOSS)
            return (apart * (100 + self.percent) <= (F.col("an") + F.col("bn")) * (100 - self.percent)) & ~unlikely

        sizes = 100 * F.least("an", "bn") >= self.percent * F.greatest("an", "bn")
        return sizes & F.exists(F.array(counts(_registers("abits"), _registers("bbits"))), may)  # an array of one, so that the counts are worked out once


    def short(self) -> Column:
        return F.slice("bits", 1, ngram_join.SKETCH)

    def near(self) -> Column:
        return ngram_join.few_differ(self.percent)


def near_duplicates(documents: DataFrame, width: int = 3, percent: int = 85, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_shingles, component_id and whether the document is its component's representative."""
    found = ngram_join.link(documents, width, percent, HyperMinHash(percent), text=text, id=id, **options)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
