"""N-gram Jaccard self-join with PartEnum signatures.

A document is the set of its distinct word shingles. Two sets link when 100 * |a & b| >= percent * |a | b|.

Sizes are cut into bands such that linked sets lie in one band or in neighbouring ones; instance i serves bands i - 1 and i, so a
set takes part in two instances. In an instance, linked sets differ in at most k elements (k follows from the band's upper
size). The shingle domain is hashed into groups of n2 = 3 parts; in at least one group at most ``level`` elements, hence at most
``level`` = 1 parts, differ. A set therefore emits, for each group, one signature for each subset of n2 - level parts: the hash of its
elements there. Linked sets share at least one signature. Spare groups let sets leave out the subsets whose parts are all empty.

Steps, each bounded in memory and written to the shared folder:
1. equal sets become one class, aggregated before the shuffle. A class has its size, a sketch of 512 bits and its text, compressed;
2. signatures are made from the classes and written, in one or more ``passes`` over parts of the hash domain. ``rounds`` slices of a pass are shuffled
   one after the other, so that only a slice's shuffle is on disk at a time, and kept where two classes share them. Counts of 65,536 buckets
   over all signatures of a pass find those that a frequent signature dominates; they are counted by partial aggregates and a join that the engine may split, the others by a window;
3. each signature's classes have a centre: that of them which shares the most over all its signatures, so a family of near copies
   has few centres. Every class is compared with its centres. A sketch holds, for each of its bits, the parity of the number of elements
   hashed to it; two sketches thus differ in no more bits than their sets in elements, and pairs whose sketches differ
   in more than linked sets may are left out before any text moves. The rest is compared exactly, and components are formed;
4. last, pairs that share a signature without either being its centre, where components still differ. Sketches are compared directly where the
   signature has up to ``few_members`` sets (at most half as many comparisons a row, which cost less than what follows), and above that
   only where two sets share one of the rarest elements in which they differ from their centre (see ``_prefixes``). Both are exact, as
   they only leave out what cannot link. Sketches with a bit or two an element leave out nearly all that is left and can't link; texts of what remains are compared.

A centre's text is sent once for each ``RUN`` of its members, next to which they are sorted, and pairs are compared in slices that move a quarter of
all texts each (``SHARE``), so what lies on disk doesn't follow the number of pairs. No cap is set on partners or candidates.

Defined results: case is folded for A-Z only. A null or empty text, or one without words, has 0 shingles and links with nothing: its
component is its own doc_id. Repeated rows are equal sets. Each row gets the component of its text. A null id takes part through its text,
and its component is the least id linked with it, null if there is none. An empty table gives an empty one. Texts of any length are
taken whole; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shotloom.llm._words import U64, Words, as_long, chunks, digest, discard, fresh, map_texts, mix, only, settle, shared_folder, windows
from shotloom.llm.components import connected

BUCKETS = 1 << 16
#: Longs of a sketch.
SKETCH = 8
#: Members of a centre that are sorted next to one copy of its text.
RUN = 64
#: Bits of the table that tells which texts a shuffle needs: 1 MB at most, whatever the number of texts.
PLACES = 1 << 23
#: What a slice of compared pairs moves: this share of the bytes of all texts (or sketches), and so many at least.
SHARE, LEAST_BYTES = 0.25, 1 << 26


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text's word hashes; fewer words than the width are one shingle."""
    if len(h) == 0:
        return np.zeros(0, U64)
    return np.unique(windows(h, min(width, len(h))))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (small + large - shared)


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH places, the parity of the number of elements hashed to it."""
    odd = np.bincount((mix(s + U64(77)) & U64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class PartEnum:
    """Signatures for one threshold; ``parts`` (n2) and ``level`` (k2) choose the subsets.

    ``link`` asks a scheme for the ``sketch`` of a set, for the rows (sign, node) of all classes, and for ``close``, which says of sketches whether sets may link.
    """

    sketch = staticmethod(sketch)
    #: The greatest sum of two sets' sizes for which ``near`` leaves nothing to ``close``.
    small = math.inf

    def __init__(self, percent: int = 90, parts: int = 3, level: int = 1) -> None:
        self.percent, self.parts, self.level = percent, parts, level
        self.lows = [1]  # the least size of each band
        self.subsets = [list(c) for c in itertools.combinations(range(parts), parts - level)]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(self.high(len(self.lows) - 1) + 1)
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def high(self, band: int) -> int:
        return self.lows[band] * 100 // self.percent

    @functools.lru_cache(maxsize=4096)  # noqa: B019
    def groups(self, band: int) -> tuple[int, int]:
        """The most elements in which linked sets of this instance differ, and its number of groups."""
        while len(self.lows) <= band:
            self.lows.append(self.high(len(self.lows) - 1) + 1)
        # |a ^ b| = S - 2 |a & b| with S = |a| + |b| and |a & b| >= S * p / (100 + p)
        k = 2 * self.high(band) * (100 - self.percent) // (100 + self.percent)
        least = k // (self.level + 1) + 1
        # spare groups, so many that the least sets of this instance seldom have as many groups with a subset of empty parts
        for spare in range(least):
            chance = len(self.subsets) * math.exp(-(self.parts - self.level) * self.lows[max(0, band - 1)] / (self.parts * (least + spare)))
            barren = (least + spare) * min(1.0, chance)
            if barren + 3 * math.sqrt(barren) < 1 + spare:
                return k, least + spare
        return k, least

    def signatures(self, s: np.ndarray, parity: int | None = None) -> np.ndarray:
        """All signatures of a sorted set, or those of its even or odd instance; none where only equal sets can link."""
        if not len(s):
            return np.zeros(0, U64)
        own, out = self.band(len(s)), []
        where = mix(s ^ U64(0xA5A5A5A55A5A5A5A)) >> U64(32)
        value = mix(s + U64(0x1234567))
        low, high = (value & U64(0xFFFFFFFF)).astype(np.float64), (value >> U64(32)).astype(np.float64)
        for instance in (own, own + 1):
            k, groups = self.groups(instance)
            if k == 0 or parity is not None and instance % 2 != parity:
                continue
            cells = groups * self.parts
            part = (where * U64(cells) >> U64(32)).astype(np.int64)
            # sums of 32-bit halves are exact in doubles up to 2**21 elements a part
            total = np.bincount(part, low, cells).astype(U64) + (np.bincount(part, high, cells).astype(U64) << U64(32))
            total = mix(total + np.arange(cells, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(instance << 20)).reshape(groups, self.parts)
            empty = (np.bincount(part, minlength=cells) == 0).reshape(groups, self.parts)
            # Linked sets differ in at most ``level`` parts in all groups but k // (level + 1). A set with fewer groups that hold a subset of empty parts
            # than those has one of them without such a subset, and shares that, so its empty subsets, which unrelated sets have as well, are left out.
            barren = int((empty.sum(1) >= self.parts - self.level).sum())
            some = 0 < barren < groups - k // (self.level + 1)
            for subset in self.subsets:
                found = mix(total[:, subset].sum(1, dtype=U64) + U64(len(subset)))
                out.append(found[~empty[:, subset].all(1)] if some else found)
        return np.concatenate(out) if out else np.zeros(0, U64)

    def signed(self, classes: DataFrame, width: int, passes: int = 1, turn: int = 0) -> DataFrame:
        """(sign, node) of the signatures of one pass, each once a class. An even number of passes takes even and odd instances in turn, so no pass computes
        what the other keeps, and half as many parts of the hash domain; an odd number takes parts of the hash domain alone."""
        parity, shares, share = (turn % 2, passes // 2, turn // 2) if passes % 2 == 0 else (None, passes, turn)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, found in _unpacked(batches, width):
                signs = [self.signatures(s, parity) for s in found]
                signs = [np.unique(x[(x >> U64(40)) % U64(shares) == U64(share)] if shares > 1 else x) for x in signs]
                node = np.repeat(part.column(0).to_numpy(), [len(x) for x in signs])
                yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(signs))), pa.array(node)], names=["sign", "node"])

        return classes.select("node", "packed").mapInArrow(emit, "sign long, node long")

    def close(self) -> Column:
        """Whether sets of the sizes an and bn with the sketches abits and bbits may link."""
        return few_differ(self.percent)

    def short(self) -> Column:
        """The part of ``bits`` that ``near`` needs, which is asked where all classes of a signature meet; ``close`` follows if that is less than all."""
        return F.col("bits")

    def near(self) -> Column:
        return self.close()


def few_differ(percent: int) -> Column:
    """Each bit in which the parities abits and bbits differ is an element of one set alone; an and bn are the sets' sizes."""
    apart = reduce(Column.__add__, (F.bit_count(F.col("abits")[k].bitwiseXOR(F.col("bbits")[k])) for k in range(SKETCH)))
    return (100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")) & (apart * (100 + percent) <= (F.col("an") + F.col("bn")) * (100 - percent))


def sets(documents: DataFrame, width: int = 3, whole: bool = False, text: str = "text", id: str = "doc_id", sketch: Callable[[np.ndarray], np.ndarray] = sketch) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (the set's digest); with ``whole`` the sketch and the compressed text as well."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        w = Words(texts, lower=True)
        found = [shingle_set(w.hash[a:b], width) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        marks = [digest(s.tobytes()) for s in found]
        shrink = zstandard.ZstdCompressor(level=3).compress
        return {
            "doc_id": part.column(0),
            "n_shingles": [len(s) for s in found],
            "h1": [h for h, _ in marks],
            "h2": [h for _, h in marks],
        } | ({"bits": [sketch(s).tolist() for s in found], "packed": [shrink(t) for t in texts]} if whole else {})

    return map_texts(only(documents, id, text), work, "doc_id long, n_shingles long, h1 long, h2 long" + (", bits array<long>, packed binary" if whole else ""), text)


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches whose last column is a compressed text, with the texts' sets."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part in chunks(batch, batch.num_columns - 1, 1 << 19):
            w = Words([unpack(x.as_py()) for x in part.column(part.num_columns - 1)], lower=True)
            yield part, [shingle_set(w.hash[a:b], width) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def _frequent(rows: DataFrame, floor: int, folder: str) -> list[int]:
    """The buckets that hold far more signatures than the others; partial aggregates leave at most BUCKETS counts a task."""
    counts = rows.groupBy(F.col("sign").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    counts = settle(counts, folder, "buckets")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) // BUCKETS
    return [r["bucket"] for r in counts.where(F.col("n") > max(floor, 8 * mean)).collect()]  # under BUCKETS / 8 numbers


def _shared(rows: DataFrame, hot: list[int]) -> DataFrame:
    """(sign, node, size): the rows of signatures that two classes or more have, and how many have them."""
    same = Window.partitionBy("sign")
    if not hot:
        return rows.withColumn("size", F.count("*").over(same)).where("size > 1")
    dominated = F.col("sign").bitwiseAND(F.lit(BUCKETS - 1)).isin(hot)
    cold = rows.where(~dominated).withColumn("size", F.count("*").over(same)).where("size > 1")
    often = rows.where(dominated)
    return cold.unionByName(often.join(often.groupBy("sign").agg(F.count("*").alias("size")).where("size > 1"), "sign"))


def _centred(shared: DataFrame, folder: str) -> DataFrame:
    """Adds ``centre``: of a signature's classes, the one that shares most over all its signatures, the least node of equals. Written in two
    steps, so that of the shuffles by node and by signature only one is on disk at a time."""
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    least = shared.join(weight, "node").groupBy("sign").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    out = settle(shared.join(settle(least, folder, "centres", release=True), "sign"), folder, "members", release=True)
    discard(shared.sparkSession, folder, "centres")
    return out


def _among(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose node is one of the nodes, and some others: those whose hash has its bit in a table of PLACES bits, which every task gets.

    It only spares the shuffle before a join on node from moving rows without a partner, so others do no harm; a full table leaves all rows in.
    """
    place = F.xxhash64("node").bitwiseAND(F.lit(PLACES - 1))
    word, bit = F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(xxhash64(node) & 63 as int))")
    table = nodes.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    own = [F.col(c) for c in rows.columns]
    return rows.withColumn("word", word).join(F.broadcast(table), "word").where(F.col("bits").bitwiseAND(bit) != 0).select(*own)


def _beside(pairs: DataFrame, table: DataFrame, load: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]], fn: Callable[[np.ndarray, np.ndarray], tuple | None], schema: str, folder: str, name: str, whole: DataFrame | None = None) -> DataFrame:
    """(a, b) and what fn(a's value, b's value) returns for the pairs where it isn't None; ``load`` makes the values of table(node, packed).

    The rows of an a are dealt in runs of about RUN, and each run is sorted behind one copy of what a has, which is loaded once. What the pairs move
    may be many times the table, so runs are dealt to slices that move about SHARE of it each, one after the other.
    """
    size = F.length("packed").alias("bytes")
    moved = table.select("node", size).join(pairs.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("times")), "node", "left")
    whole, moved = moved.agg(F.sum("bytes"), F.sum(F.col("bytes") * F.col("times"))).first()
    slices = max(1, math.ceil((moved or 0) / max(LEAST_BYTES, SHARE * (whole or 0))))
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).alias("runs"))
    heads = runs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run")).withColumn("b", F.lit(None).cast("long"))
    rows = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).alias("run"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        from shotloom.llm._words import _ddl

        out, own = to_arrow_schema(_ddl(f"a long, b long{schema}")), None
        for part, found in load(batches):
            keep = []
            for a, b, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), found, strict=True):
                if b is None:
                    own = s
                elif (row := fn(own, s)) is not None:
                    keep.append((a, b, *row))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in keep], f.type) for k, f in enumerate(out)], schema=out)

    done = []
    for k in range(slices):
        mine = F.pmod(F.xxhash64("run", "a"), F.lit(slices)) == k
        these, own = rows.where(mine), heads.where(mine)
        texts = _among(table.select("node", "packed"), these.select(F.explode(F.array("a", "b")).alias("node")))
        both = own.join(texts, F.col("a") == F.col("node")).unionByName(these.join(texts, F.col("b") == F.col("node"))).select("a", "run", "b", "packed")
        both = both.repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
        done.append(settle(both.mapInArrow(work, f"a long, b long{schema}"), folder, f"{name}/{k}", release=True))
    return reduce(DataFrame.unionByName, done)


def _verified(pairs: DataFrame, classes: DataFrame, width: int, percent: int, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) whose texts link."""
    return _beside(pairs, classes, functools.partial(_unpacked, width=width), lambda x, y: () if linked(x, y, percent) else None, "", folder, name)


def parities(s: np.ndarray) -> bytes:
    """The size of a set, and a sketch with a bit or two an element: for each place, the parity of the number of elements hashed to it."""
    places = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((mix(s + U64(77)) & U64(places - 1)).astype(np.int64), minlength=places) & 1
    return len(s).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sets with these sizes and parities may link. Each place where they differ is an element of one set alone; the halves of a table, taken together, are that of half as many places."""
    sizes, (x, y) = int(x[0]) + int(y[0]), (x[1:], y[1:])
    while len(x) != len(y):
        x, y = (h[: len(h) // 2] ^ h[len(h) // 2 :] if len(h) > min(len(x), len(y)) else h for h in (x, y))
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= sizes * (100 - percent)


def _few_apart(pairs: DataFrame, classes: DataFrame, width: int, percent: int, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) that sketches as long as the sets let link. Those of SKETCH longs can't tell sets of more than about a thousand elements apart,
    and unrelated ones of that size that share a frequent element are pairs whose number grows with the square of the input; so texts move for few of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _unpacked(batches, width):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([parities(s) for s in found], pa.binary())], names=["node", "packed"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for part in batches:
            yield part, [np.frombuffer(x, U64) for x in part.column(part.num_columns - 1).to_pylist()]

    own = _among(classes.select("node", "packed"), pairs.select(F.explode(F.array("a", "b")).alias("node")))
    own = settle(own.mapInArrow(work, "node long, packed binary"), folder, f"{name}-parities")
    out = _beside(pairs, own, load, lambda x, y: () if may_link(x, y, percent) else None, "", folder, name, classes)
    discard(pairs.sparkSession, folder, f"{name}-parities")
    return out


def _sketched(pairs: DataFrame, classes: DataFrame, close: Column, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and sketches let link. Sizes come first, so that sketches move for few pairs."""
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(x), F.col("n").alias(f"{x}n")), x)
    pairs = pairs.where(100 * F.least("an", "bn") >= percent * F.greatest("an", "bn"))
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(x), F.col("bits").alias(f"{x}bits")), x)
    return pairs.where(close).select("a", "b")


def _prefixes(stars: DataFrame, classes: DataFrame, width: int, percent: int, folder: str) -> DataFrame:
    """Rows (centre, element, node) such that linked sets of one centre and of different components share an element; stars(a, b) are its members.

    Let d(x) be the elements in which x differs from the centre. Sets x and y differ in |d(x)| + |d(y)| - 2 |d(x) & d(y)| elements, at most
    k if they link, so d(x) and d(y) share t = (|d(x)| + |d(y)| - k) / 2 or more. As |d(y)| >= |d(x)| - k, t >= |d(x)| - k; and
    t > |d(x)| * p / (100 + p) where x links with the centre, since then y doesn't. Under any order of the elements the first |d(x)| - t + 1 of
    both have one in common. The order is one for all sets of a centre: elements that the centre lacks come first, then the centre's own; within
    both, those that fewer sets list before the others. What the centre has isn't listed by sets whose other elements fill the first
    places anyway; that makes their own first places no different, and the places of such elements only follow from counts. Elements that one
    set alone lists can't be shared and have no row. Close copies that all differ among themselves thus meet only where they share a change.
    """

    def apart(own: np.ndarray, other: np.ndarray) -> tuple:
        more, less = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
        d = len(more) + len(less)
        if d * (100 + percent) <= (len(own) + len(other)) * (100 - percent):
            places = d - d * percent // (100 + percent) if d else 0
        else:
            k = (len(other) + len(other) * 100 // percent) * (100 - percent) // (100 + percent)
            places = min(d, k + 1)
        return places, len(more), as_long(more if len(more) >= places else np.concatenate([more, less]))

    lists = _beside(stars, classes, functools.partial(_unpacked, width=width), apart, ", first int, added int, elements array<long>", folder, "apart")
    each = lists.select(F.col("a").alias("centre"), F.col("b").alias("node"), "added", F.posexplode("elements").alias("at", "element")).select("centre", "node", (F.col("at") >= F.col("added")).alias("own"), "element")
    common = settle(each.groupBy("centre", "element").agg(F.count("*").alias("have")).where("have > 1"), folder, "common", release=True)
    met = each.join(common, ["centre", "element"]).groupBy("centre", "node").agg(F.sort_array(F.collect_list(F.struct("own", "have", "element"))).alias("shared"))  # at most a set
    # Elements without a row take up places too: of those that the centre lacks, the ones that no other set has come first; of the centre's own, those that one set lists.
    others = F.size(F.filter("shared", lambda e: ~e["own"]))
    lacking = F.least(others, F.col("first") - F.col("added") + others)
    owns = F.col("first") - F.size("elements") + F.size("shared") - others
    kept = lists.select(F.col("a").alias("centre"), F.col("b").alias("node"), "first", "added", "elements").join(met, ["centre", "node"])
    kept = kept.withColumn("take", F.greatest(lacking, F.lit(0)) + F.greatest(owns, F.lit(0))).where("take > 0")
    rows = kept.select("centre", "node", F.explode(F.slice("shared", F.lit(1), F.col("take"))["element"]).alias("element"))
    rows = settle(rows.select("centre", "element", "node"), folder, "prefixes", release=True)
    discard(rows.sparkSession, folder, "apart", "common")
    return rows


def _meet(rows: DataFrame, keys: list[str], about: DataFrame, close: Column) -> DataFrame:
    """Pairs (a, b) of rows that agree in the keys, are in different components and may link by their sizes and sketches, and the sum of their sizes."""
    full = rows.select(*keys, "node").join(about, "node")
    a, b = (full.select(*keys, *(F.col(c).alias(x + c) for c in ("node", "n", "component", "bits"))) for x in "ab")
    return a.join(b, keys).where((F.col("anode") < F.col("bnode")) & (F.col("acomponent") != F.col("bcomponent")) & close).select(F.col("anode").alias("a"), F.col("bnode").alias("b"), (F.col("an") + F.col("bn")).alias("sizes"))


def link(documents: DataFrame, width: int = 3, percent: int = 90, enum: PartEnum | None = None, rounds: int = 4, passes: int = 1, floor: int = 200_000, few_members: int = 4096, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, h1, h2; equal (h1, h2) are equal sets. With more ``passes`` fewer signatures are on disk at a time, and
    they are computed that often; the result is the same. ``enum`` may be another scheme of signatures and sketches (see ``PartEnum``)."""
    enum, spark = enum or PartEnum(percent), documents.sparkSession
    folder = shared_folder(spark)
    some = sets(documents, width, True, text, id, enum.sketch).where("n_shingles > 0")
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("packed").alias("packed"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), folder, "classes", release=True)  # fixed once written

    turns = []
    for turn in range(passes):
        rows = settle(enum.signed(classes, width, passes, turn), folder, f"signed-{turn}")
        hot = _frequent(rows, floor, folder)
        for k in range(rounds):
            part = rows.where(F.pmod(F.shiftright("sign", 16), F.lit(rounds)) == k)
            turns.append(settle(_shared(part, hot), folder, f"shared-{len(turns)}", release=True))
        discard(spark, folder, f"signed-{turn}")
    members = _centred(reduce(DataFrame.unionByName, turns), folder)
    discard(spark, folder, *(f"shared-{k}" for k in range(len(turns))))

    stars = members.where("centre <> node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    stars = settle(_sketched(stars, classes, enum.close(), percent), folder, "stars", release=True)
    edges = _verified(stars, classes, width, percent, folder, "links-1")
    parts = connected(edges, folder, "parts-1")

    # pairs that share a signature of which neither is the centre, across components
    owned = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = owned.groupBy("sign").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sign")
    owned = settle(members.join(mixed, "sign"), folder, "mixed", release=True)
    about = classes.select("node", "n", enum.short().alias("bits")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    few = settle(_meet(owned.where(F.col("size") <= few_members), ["sign"], about, enum.near()).distinct(), folder, "few", release=True)
    many = owned.where((F.col("size") > few_members) & (F.col("centre") != F.col("node"))).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    rest = _meet(_prefixes(many, classes, width, percent, folder), ["centre", "element"], about, enum.near()).unionByName(few).distinct()
    rest = rest.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    if enum.small == math.inf:
        rest = rest.select("a", "b")
    else:
        rest, small = settle(rest, folder, "met", release=True), F.col("sizes") <= enum.small
        rest = rest.where(small).select("a", "b").unionByName(_sketched(rest.where(~small).select("a", "b"), classes, enum.close(), percent))
    rest = _few_apart(settle(rest, folder, "rest", release=True), classes, width, percent, folder, "close")
    more = _verified(rest, classes, width, percent, folder, "links-2")
    parts = connected(edges.unionByName(more), folder, "parts-2")

    least = classes.select("h1", "h2", "rep", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    least = settle(least.join(lowest, "component").select("h1", "h2", "component_id"), folder, "least", release=True)
    discard(spark, folder, "buckets", "classes", "members", "stars", "links-1", "parts-1", "mixed", "few", "prefixes", "met", "rest", "close", "links-2", "parts-2")
    out = sets(documents, width, False, text, id).join(least, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "h1", "h2")


def _digested(documents: DataFrame, width: int, names: tuple[str, str, str], text: str) -> DataFrame:
    """The rows with the number of shingles and the digest of their sets in further columns."""
    at, columns = documents.columns.index(text), documents.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at, 1 << 20):
                w = Words([x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()], lower=True)
                found = [shingle_set(w.hash[a:b], width) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                more = zip(*((len(s), *digest(s.tobytes())) for s in found), strict=True) if found else [[]] * 3
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(list(x), pa.int64()) for x in more)], names=[*columns, *names])

    return documents.mapInArrow(work, StructType([*documents.schema.fields, *(StructField(n, LongType()) for n in names)]))


def representatives(documents: DataFrame, width: int = 3, text: str = "text", id: str = "doc_id", passes: int = 4, rounds: int = 3, **options) -> DataFrame:
    """One document of each linked group, that with the least id, with all its columns.

    Rows with one id and different sets are different documents. Of rows with one id and one set one stays, the least when all columns are read as
    strings. Documents without words stay, and so do rows without an id.
    """
    columns, spark = documents.columns, documents.sparkSession
    n, h1, h2, times, row = fresh(columns, "n", "h1", "h2", "times", "row")
    found = link(documents, width, text=text, id=id, passes=passes, rounds=rounds, **options)
    found = found.where("doc_id is not null and (n_shingles = 0 or doc_id = component_id)").groupBy("doc_id", "h1", "h2").agg(F.count("*").alias(times))
    state = settle(found.select(F.col("doc_id").alias(id), F.col("h1").alias(h1), F.col("h2").alias(h2), times), shared_folder(spark), "kept", release=True)
    marked = _digested(documents, width, (n, h1, h2), text)
    joined = marked.join(state, [id, h1, h2])
    own = [F.col(f"`{c}`") for c in columns]
    out = joined.where((F.col(times) == 1) | (F.col(n) == 0)).select(*own).unionByName(documents.where(F.col(f"`{id}`").isNull()))
    if not state.where(F.col(times) > 1).isEmpty():
        again = joined.where((F.col(times) > 1) & (F.col(n) > 0)).groupBy(id, h1, h2).agg(F.min_by(F.struct(*own), F.struct(*own).cast("string")).alias(row))
        out = out.unionByName(again.select(f"{row}.*"))
    return out
