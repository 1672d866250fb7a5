"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are words. A document longer than the greatest capacity is cut into pieces of that size and a rest. Pieces are dealt by a hash of
id, text and piece into shards of about ``shard`` pieces, so no group grows with the input, and each shard is packed by itself:
longest piece first, into the open bin with the least room that fits. Where none fits, a bin of the least-cost size opens: for each
permitted size, the pieces still to come are imagined to fill it greedily, and the size with the least cost a packed word wins (a sequence
costs its capacity and ``overhead``). At last each bin is downsized to the least permitted capacity that holds its contents.

Defined results: a null or empty text, or one without words, has one row with 0 words and null shard, bin, position and capacity. Ties in
length go by id, piece and text, null ids first. Repeated rows are packed each. An empty table gives an empty one; further columns are
ignored. Every word of every document is in exactly one bin.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm._words import only

CAPACITIES = (256, 512, 1024, 2048)
OVERHEAD = 16
WORD = r"[^\x20\x09-\x0D]+"


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given longest first), and each bin's final capacity."""
    sizes = sorted(capacities)
    top = sizes[-1]
    left = np.bincount(np.asarray(lengths, np.int64), minlength=top + 1).tolist() if len(lengths) else [0] * (top + 1)
    present = sum(1 << n for n in range(1, top + 1) if left[n])  # bit n: pieces of n words are still to come
    rooms: list[list[int]] = [[] for _ in range(top + 1)]
    open_rooms = 0  # bit r: bins with r words of room
    used: list[int] = []
    room_of: list[int] = []
    bins, offsets = [], []

    def opening(first: int) -> int:
        best, choice = None, top
        for c in sizes:
            if c < first:
                continue
            room, taken = c - first, {}
            mask = present & ((1 << room + 1) - 1)
            while mask:
                n = mask.bit_length() - 1
                have = left[n] - taken.get(n, 0)
                k = min(have, room // n)
                if k:
                    taken[n] = taken.get(n, 0) + k
                    room -= k * n
                mask &= (1 << min(n, room + 1)) - 1
            cost = (c + overhead) / (c - room)
            if best is None or cost < best:
                best, choice = cost, c
        return choice

    for n in lengths:
        left[n] -= 1
        if not left[n]:
            present &= ~(1 << n)
        fit = open_rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(used), opening(n)
            used.append(0)
            room_of.append(room)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        room -= n
        if room:
            rooms[room].append(b)
            open_rooms |= 1 << room
    return bins, offsets, [next(c for c in sizes if c >= u) for u in used]


SCHEMA = "doc_id long, piece int, word_start long, n_words int, shard int, bin int, position int, capacity int"


def pieces(documents: DataFrame, most: int, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, piece, word_start, n_words, content (a hash of the whole text): the documents cut to at most ``most`` words."""
    counted = only(documents, id, text).select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n"), F.xxhash64(text).alias("content"))
    last = F.greatest(F.floor((F.col("n") - 1) / most), F.lit(0)).cast("int")
    cut = counted.select("doc_id", "n", "content", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * most
    return cut.select("doc_id", "piece", start.alias("word_start"), F.least(F.lit(most).cast("long"), F.col("n") - start).cast("int").alias("n_words"), "content")


def pack(documents: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, shard: int = 20_000, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A row for each piece: its place (shard, bin, position in words) and the bin's capacity."""
    sizes = tuple(sorted(capacities))
    cut = pieces(documents, sizes[-1], text, id)
    total = cut.count()
    shards = max(1, -(-total // shard))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "piece", "content"], ascending=[False, True, True, True], na_position="first", kind="stable")
        bins, offsets, final = best_fit(pdf["n_words"].tolist(), sizes, overhead)
        return pdf.assign(bin=np.asarray(bins, np.int32), position=np.asarray(offsets, np.int32), capacity=np.asarray(final, np.int32)[bins])

    dealt = cut.where("n_words > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "content"), F.lit(shards)).cast("int"))
    packed = dealt.groupBy("shard").applyInPandas(lambda pdf: work(pdf)[[x.split()[0] for x in SCHEMA.split(", ")]], SCHEMA)
    nothing = cut.where("n_words = 0").select("doc_id", "piece", "word_start", "n_words", *(F.lit(None).cast("int").alias(c) for c in ("shard", "bin", "position", "capacity")))
    return packed.unionByName(nothing)


def assemble(documents: DataFrame, placed: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The sequences themselves: shard, bin, capacity, n_words and their words joined by spaces, pieces in order; doc ids alike."""
    own = placed.where("bin is not null")
    words = only(documents, id, text).select(F.col(id).alias("doc_id"), F.regexp_extract_all(F.col(text), F.lit(WORD), 0).alias("words"))
    cut = own.join(words, "doc_id").select("shard", "bin", "capacity", "position", "doc_id", "n_words", F.array_join(F.slice("words", (F.col("word_start") + 1).cast("int"), F.col("n_words")), " ").alias("words"))
    rows = cut.groupBy("shard", "bin", "capacity").agg(F.sum("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("position", "doc_id", "words"))).alias("parts"))  # bounded by the capacity
    return rows.select("shard", "bin", "capacity", "n_words", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), F.array_join(F.transform("parts", lambda p: p["words"]), " ").alias("text"))
