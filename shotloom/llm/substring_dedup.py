"""Substring dedup by level-wise doubling over windows of words.

A window of ``size`` words (50) is repeated when its word sequence also starts in a document with a smaller id. A window can only be
repeated at one length if its halves are, so lengths double (25, 50, ...) and only what is repeated at one length is extended to the
next, until no candidates survive or the target length is decided:

1. Each text's words are hashed once. Texts with equal word sequences form a class, aggregated before the shuffle; every class is
   represented by its least id, and the windows of all its other rows are repeated by definition.
2. Length size/2: of the windows of each run of size/2 + 1 consecutive starts, the one with the least hash is kept. Equal
   windows of the full length choose equal ones inside, so any repeated window has a repeated kept half, at about 7 % of the rows.
   The least and greatest id of each hash are aggregated; hashes with one document are dropped.
3. Length size: starts whose window holds a surviving half are extended, and the least id of each full hash is aggregated. A start whose
   id is greater than that least id is repeated.
4. With a greater ``longest``, doubling goes on: a start is extended to twice the length where the windows at it and right behind it
   both survived, until no candidates survive or ``longest`` is reached (see ``longest_repeats``). ``dedup`` and ``without_repeats`` need
   the windows of ``size`` only, so one doubling decides there.

Halves only choose candidates and have 64-bit hashes; equality of full windows is decided by two independent 64-bit hashes together. Hot
windows (a passage in a third of all documents) only ever meet as partial minima and in a join whose skewed side the engine splits.
Texts travel compressed, once for each level and once for the result. Tables of steps that are done are deleted.

Defined results: a null or empty text has no words and keeps nothing; texts under ``size`` words lose nothing. Rows with one id and
equal words are judged alike; of rows with one id and different words neither removes from the other. A null id removes nothing and is
not removed from. An empty table gives an empty one; further columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shotloom.llm._words import OTHER, U64, Words, as_long, chunks, digest, discard, fresh, joined, map_texts, only, settle, shared_folder, windows


def sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` consecutive values, by doubling."""
    out, have = h, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def chosen(h: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the least value of at least one run of ``span`` values; ties all count."""
    if len(h) < span:
        return np.zeros(0, np.int64)
    low = sliding_min(h, span)
    pad = np.zeros(span - 1, h.dtype)
    return np.flatnonzero(~sliding_min(~np.concatenate([pad, low, pad]), span) == h)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Flags of the n words that lie in a window of ``size`` words from one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n] > 0


def to_spans(flags: np.ndarray) -> np.ndarray:
    """start, end, start, end, ... of the runs of True."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))


def profile(documents: DataFrame, size: int, text: str, id: str) -> DataFrame:
    """doc_id, n_words, digest (k1, k2), the hash of all kept words if nothing is removed, and the chosen halves' hashes."""
    half = size // 2

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        w = Words(texts)
        out: dict = {k: [] for k in ("k1", "k2", "whole")}
        halves = []
        for i, t in enumerate(texts):
            h = w.hash[w.first[i] : w.first[i + 1]]
            whole = joined(t)
            k1, k2 = digest(whole)
            out["k1"].append(k1)
            out["k2"].append(k2)
            out["whole"].append(hashlib.sha256(whole).hexdigest())
            v = windows(h, half) if len(h) >= size else np.zeros(0, U64)
            halves.append(as_long(np.unique(v[chosen(v, size - half + 1)])))
        ends = np.cumsum([0, *map(len, halves)]).astype(np.int32)
        flat = np.concatenate(halves) if halves else np.zeros(0, np.int64)
        return {"doc_id": part.column(0), "n_words": np.diff(w.first), "halves": pa.ListArray.from_arrays(ends, flat)} | out

    return map_texts(only(documents, id, text), work, "doc_id long, n_words long, k1 long, k2 long, whole string, halves array<long>", text)


def pack(documents: DataFrame, text: str, id: str) -> DataFrame:
    """doc_id, the digest of the words, and the compressed text."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        marks = [digest(joined(t)) for t in texts]
        shrink = zstandard.ZstdCompressor(level=3).compress
        return {"doc_id": part.column(0), "k1": [k for k, _ in marks], "k2": [k for _, k in marks], "packed": [shrink(t) for t in texts]}

    return map_texts(only(documents, id, text), work, "doc_id long, k1 long, k2 long, packed binary", text)


def repeated_hashes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, doc_id) to (keys, first): the hashes in two documents or more, with the least id."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(*keys, "first")


OWN = ["doc_id", "k1", "k2"]


def around(h: np.ndarray, kept: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of ``size`` words that hold a window of half the size whose hash is kept."""
    half = size // 2
    at = np.flatnonzero(np.isin(windows(h, half).view(np.int64), kept))
    flags = np.zeros(len(h) - size + 2, np.int64)
    np.add.at(flags, np.maximum(0, at - (size - half)), 1)
    np.add.at(flags, np.minimum(len(h) - size, at) + 1, -1)
    return np.flatnonzero(np.cumsum(flags)[:-1] > 0)


def twofold(h: np.ndarray, kept: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of ``size`` words whose halves both start where one survived."""
    return np.intersect1d(kept, kept - size // 2)


def _grown(documents: DataFrame, alive: DataFrame, size: int, starts, text: str, id: str) -> DataFrame:
    """(doc_id, k1, k2, hash, more, start) of the windows of ``size`` words at the starts that starts(h, kept, size) finds; alive has a list ``kept`` a text."""

    def extend(part: pa.RecordBatch, packed: list[bytes]) -> dict:
        unpack = zstandard.ZstdDecompressor().decompress
        w = Words([unpack(x) for x in packed])
        more = w.more
        out: dict = {"hashes": [], "mores": [], "starts": []}
        for i, keep in enumerate(part.column(4)):
            own = slice(w.first[i], w.first[i + 1])
            at = starts(w.hash[own], keep.values.to_numpy(), size)
            out["hashes"].append(as_long(windows(w.hash[own], size)[at]))
            out["mores"].append(as_long(windows(more[own], size, OTHER)[at]))
            out["starts"].append(at.astype(np.int32))
        ends = np.cumsum([0, *map(len, out["starts"])]).astype(np.int32)
        lists = {k: pa.ListArray.from_arrays(ends, np.concatenate(x)) for k, x in out.items()}
        return {"doc_id": part.column(0), "k1": part.column(1), "k2": part.column(2)} | lists

    texts = pack(documents, text, id).join(alive, OWN).dropDuplicates(OWN).select(*OWN, "packed", "kept")
    return map_texts(texts, extend, "doc_id long, k1 long, k2 long, hashes array<long>, mores array<long>, starts array<int>", "packed")


def find(documents: DataFrame, size: int = 50, text: str = "text", id: str = "doc_id", folder: str | None = None, longest: int = 0) -> tuple[DataFrame, dict[int, DataFrame]]:
    """A row for every row of documents (doc_id, n_words, k1, k2, whole), and for ``size`` and each double of it up to ``longest`` that has repeats the removals:
    (doc_id, k1, k2, starts) for the representatives with repeated windows."""
    spark = documents.sparkSession
    folder = folder or shared_folder(spark)
    profiles = settle(profile(documents, size, text, id), folder, "profile")
    base = settle(profiles.drop("halves"), folder, "base")
    rows = profiles.where(f"n_words >= {size} and doc_id is not null")
    heads = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("halves").alias("halves"))

    # length size / 2
    halves = settle(heads.select(F.explode("halves").alias("hash"), *OWN), folder, "halves", release=True)
    discard(spark, folder, "profile")
    # written first, so that both sides of the join are plain shuffles and the engine can split a hot hash
    twice = settle(repeated_hashes(halves.select("hash", "doc_id"), ["hash"]).select("hash"), folder, "halves-repeated")
    alive = settle(halves.join(twice, "hash").groupBy(*OWN).agg(F.collect_list("hash").alias("kept")), folder, f"alive-{size}", release=True)  # bounded by one text's length
    discard(spark, folder, "halves", "halves-repeated")

    found, starts = {}, around
    while not found or not alive.isEmpty():
        grown = settle(_grown(documents, alive, size, starts, text, id), folder, f"grown-{size}", release=True)
        full = grown.select(*OWN, F.explode(F.arrays_zip("hashes", "mores", "starts")).alias("w")).select(*OWN, F.col("w.hashes").alias("hash"), F.col("w.mores").alias("more"), F.col("w.starts").alias("start"))
        least = settle(repeated_hashes(full.select("hash", "more", "doc_id"), ["hash", "more"]), folder, f"repeated-{size}")
        again = full.join(least, ["hash", "more"])
        hits = again.where("first < doc_id").groupBy(*OWN).agg(F.collect_list("start").alias("starts"))  # bounded by one text
        found[size] = settle(hits, folder, f"hits-{size}", release=True)
        discard(spark, folder, f"alive-{size}")
        if 2 * size <= longest:
            alive = settle(again.groupBy(*OWN).agg(F.collect_list("start").alias("kept")), folder, f"alive-{2 * size}", release=True)
        discard(spark, folder, f"grown-{size}", f"repeated-{size}")
        if 2 * size > longest:
            break
        size, starts = 2 * size, twofold
    return base, found


def longest_repeats(documents: DataFrame, size: int = 50, longest: int = 6400, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, longest: the greatest of the lengths size, 2 * size, ... up to ``longest`` at which a window also starts in a document with
    a smaller id; 0 if none does. For a whole copy that is the greatest such length that its text has."""
    base, found = find(documents, size, text, id, None, longest)
    rows = base.join(_later(base, size), ["k1", "k2"], "left")
    lengths = sorted(found)
    for n in lengths:
        rows = rows.join(found[n].select(*OWN, F.lit(True).alias(f"at{n}")), OWN, "left")
    later = (F.col("head") < F.col("doc_id")) & (F.col("n_words") >= size)
    steps = [size << k for k in range((longest // size).bit_length())]
    whole = F.coalesce(*(F.when(F.col("n_words") >= n, n) for n in reversed(steps)))
    reached = F.coalesce(*(F.when(F.col(f"at{n}"), n) for n in reversed(lengths)), F.lit(0))
    return rows.select("doc_id", "n_words", F.when(later, whole).otherwise(reached).alias("longest"))


def _later(base: DataFrame, size: int) -> DataFrame:
    """(k1, k2, head): the least id of each class of equal word sequences that are long enough."""
    return base.where(f"n_words >= {size} and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("head"))


def dedup(documents: DataFrame, size: int = 50, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    folder = shared_folder(documents.sparkSession)
    base, found = find(documents, size, text, id, folder)
    hits = found[size]
    rows = base.join(_later(base, size), ["k1", "k2"], "left")
    later = (F.col("n_words") >= size) & F.col("doc_id").isNotNull() & (F.col("head") < F.col("doc_id"))

    def cut(part: pa.RecordBatch, packed: list[bytes]) -> dict:
        unpack = zstandard.ZstdDecompressor().decompress
        kept = [keep(unpack(x), starts.values.to_numpy(), size) for starts, x in zip(part.column(4), packed, strict=True)]
        return {"doc_id": part.column(0), "k1": part.column(1), "k2": part.column(2), "gone": [n for n, _ in kept], "sha": [hashlib.sha256(x).hexdigest() for _, x in kept]}

    texts = pack(documents, text, id).join(hits, ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "k1", "k2", "packed", "starts")
    out = rows.join(map_texts(texts, cut, "doc_id long, k1 long, k2 long, gone long, sha string", "packed"), ["doc_id", "k1", "k2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    removed = F.when(later, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0)))
    kept = F.when(later, F.lit(nothing)).otherwise(F.coalesce("sha", "whole"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))


def keep(text: bytes, starts: np.ndarray, size: int) -> tuple[int, bytes]:
    """How many words are covered by the windows, and the others joined by one space."""
    words = text.split()
    flags = covered(len(words), starts, size)
    return int(flags.sum()), b" ".join(w for w, f in zip(words, flags.tolist(), strict=True) if not f)


def without_repeats(documents: DataFrame, size: int = 50, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows, all columns: a text that loses words becomes its kept words joined by one space, the others stay as they are."""
    folder = shared_folder(documents.sparkSession)
    base, found = find(documents, size, text, id, folder)
    hits = found[size]
    columns = documents.columns
    k1, k2, n_words, hit, gone = fresh(columns, "k1", "k2", "n_words", "hit", "starts")
    later = base.join(_later(base, size), ["k1", "k2"]).where(f"n_words >= {size} and head < doc_id").select("doc_id", "k1", "k2").distinct()
    marks = hits.select("doc_id", "k1", "k2", "starts").unionByName(later.withColumn("starts", F.lit(None).cast("array<int>")))
    at = columns.index(text)
    fields = documents.schema

    def digests(batches):
        for batch in batches:
            for part in chunks(batch, at, 1 << 20):
                cut_up = [(x or b"").split() for x in part.column(at).cast(pa.binary()).to_pylist()]
                marks = [(*digest(b" ".join(words)), len(words)) for words in cut_up]
                arrays = [*part.columns, *(pa.array([m[k] for m in marks], pa.int64()) for k in range(3))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, k1, k2, n_words])

    def cut(batches):
        for batch in batches:
            for part in chunks(batch, at, 1 << 20):
                texts = part.column(at).cast(pa.binary()).to_pylist()
                for k, (cut_, starts) in enumerate(zip(part.column(hit).to_pylist(), part.column(gone), strict=True)):
                    if cut_:
                        texts[k] = keep(texts[k], starts.values.to_numpy(), size)[1] if starts.is_valid else b""
                out = [pa.array(texts, pa.binary()).cast(part.column(at).type) if k == at else part.column(k) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays(out, names=columns)

    marked = documents.mapInArrow(digests, _with(fields, (k1, k2, n_words)))
    marks = marks.select(F.col("doc_id").alias(id), F.col("k1").alias(k1), F.col("k2").alias(k2), F.lit(True).alias(hit), F.col("starts").alias(gone))
    joined = marked.join(marks, [id, k1, k2], "left").select(*(F.col(f"`{c}`") for c in (*columns, hit, gone)))
    return joined.mapInArrow(cut, fields)


def _with(fields: StructType, names: tuple[str, ...]) -> StructType:
    return StructType([*fields.fields, *(StructField(n, LongType()) for n in names)])
