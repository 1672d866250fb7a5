"""Shared plumbing: batched text mapping and vectorised word hashing.

Words are runs of bytes other than space and \\x09-\\x0D in the UTF-8 text; none of those six bytes occurs inside a
multi-byte UTF-8 sequence, so byte-wise splitting equals splitting by code point.

A word of up to 15 bytes is hashed through its bytes and length as two numbers, in four rounds of a Feistel network, so its two values together are
one to one; of a longer word BLAKE2b is taken, once for each distinct word of a batch. Word sequences are compared by 128 bits of BLAKE2b over the words (``digest``). All hashes are equal on every executor.
"""

from __future__ import annotations

import gc
import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_Q = 0xD6E8FEB86659FD93 | 1
#: The base of a second, independent hash of windows.
OTHER = 0xA24BAED4963EE407 | 1
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: The bytes that a word of k bytes fills in an 8-byte number.
_FILLED = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_KEYS = [U64(0x632BE59BD9B4E019), U64(0xE220A8397B1DCDAF), U64(0x6E789E6AA1B965F4), U64(0x06C45D188009454F)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(n, U64)
        k = 1
        while k < n:  # doubling: p[k:2k] = p[:k] * b**k
            m = min(k, n - k)
            p[k : k + m] = p[:m] * U64(pow(b, k, 1 << 64))
            k += m
        out.append(p)
    return out[0], out[1]


#: The longest table that a worker keeps, one a base; longer ones are made when needed and let go.
KEPT_POWERS = 1 << 21
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > KEPT_POWERS:
        return _powers(base, n)
    if base not in _kept or len(_kept[base][0]) < n:
        _kept[base] = _powers(base, 1 << max(16, (n - 1).bit_length()))
    p, q = _kept[base]
    return p[:n], q[:n]


class Words:
    """The words of a list of texts, hashed together.

    start, end: byte positions in ``buf``; hash, more: two independent values a word; first[i]:first[i + 1] are text i's words. Besides the flags of its bytes, all
    that a text takes up is a few numbers a word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        data = b"\n".join([*texts, b"\n" * 16])  # a separator behind each text, and room to read 16 bytes anywhere
        whole = np.frombuffer(data, np.uint8)
        if lower:
            whole = _LOWER[whole]
        self.buf = whole[: len(whole) - 16]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths + 1)])
        space = np.concatenate([[True], _SPACE[self.buf], [True]])
        turn = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = turn[::2], turn[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        size = self.end - self.start
        eight = np.ndarray(len(self.buf) + 9, "<u8", whole, strides=(1,))
        low = eight[self.start] & _FILLED[np.minimum(size, 8)]
        high = (np.minimum(size, 16).astype(U64) << U64(56)) | (eight[self.start + 8] & _FILLED[np.clip(size - 8, 0, 7)])
        for key in _KEYS:
            low, high = high, low ^ mix(high + key)
        long = np.flatnonzero(size > 15)
        if len(long):
            ends = np.stack([self.start[long], self.end[long]], 1).ravel()
            runs = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(whole)])
            coded = runs.take(pa.array(np.arange(0, len(ends), 2))).dictionary_encode()
            found = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in coded.dictionary.to_pylist()])
            low[long], high[long] = np.frombuffer(found, "<u8").reshape(-1, 2)[coded.indices.to_numpy()].T
        self.hash, self.more = high, low

    def windows(self, i: int, size: int) -> np.ndarray:
        """The hash of each window of ``size`` consecutive words of text i."""
        return windows(self.hash[self.first[i] : self.first[i + 1]], size)


#: The longest windows that are hashed as polynomials; modulo 2**64 those of some longer sequences agree for every base.
POLYNOMIAL = 256


def windows(h: np.ndarray, size: int, base: int = _Q) -> np.ndarray:
    """The hash of each run of ``size`` values; longer ones are hashed from their halves."""
    if len(h) < size:
        return np.zeros(0, U64)
    if size > POLYNOMIAL:
        half = size // 2
        left, right = windows(h, half, base), windows(h, size - half, base)
        return mix(mix(left[: len(right) - half] + U64(size)) * U64(base) ^ right[half:])
    p, q = powers(base, len(h) + 1)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[:-1], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * q[: len(h) - size + 1] + U64(size))


def digest(data: bytes) -> tuple[int, int]:
    """Two signed 64-bit values: BLAKE2b."""
    found = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def joined(text: bytes) -> bytes:
    """The words, joined by one space: equal where the sequences of words are."""
    return b" ".join(text.split())


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


def chunks(batch: pa.RecordBatch, texts: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about max_bytes of text each; a longer single text gets a slice of its own."""
    if batch.num_rows == 0:
        return
    column = batch.column(texts)
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    at, total = 0, 0
    for i, n in enumerate(size):
        if i > at and total + n > max_bytes:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    yield batch.slice(at)


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, list[bytes]], dict], schema: str, text: str = "text", max_bytes: int = 1 << 20) -> DataFrame:
    """Apply fn to slices of df in Arrow form; fn gets the slice and its texts as UTF-8 (null: empty) and returns columns."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = None
        for batch in batches:
            for part in chunks(batch, at, max_bytes):
                texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                columns = fn(part, texts)
                if out is None:
                    out = to_arrow_schema(_ddl(schema))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in out)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def _ddl(schema: str):
    """The StructType of "name type, name type", without a session (executors have none)."""
    from pyspark.sql import types as T

    simple = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}

    def kind(name: str):
        return T.ArrayType(kind(name[6:-1])) if name.startswith("array<") else simple[name]

    return T.StructType([T.StructField(n, kind(t)) for n, t in (x.split() for x in schema.split(", "))])


def shared_folder(spark: SparkSession) -> str:
    """A new folder where every executor can read and write: below spark.checkpoint.dir, or below the warehouse if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/shotloom-{uuid.uuid4().hex}"


#: Spark's setting that deletes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, folder: str, name: str, release: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and outlives lost executors.

    The shuffle files of the write are deleted at its end, since only it needed them; else they would lie on the executors' disks until the
    driver's memory fills. With ``release`` the driver also collects its garbage, on which Spark deletes those of earlier counts and collects.
    """
    path, conf = f"{folder}/{name}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    if release:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete settled tables that no later step reads."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for further columns, with underscores added to all until none is taken."""
    taken, tail = {c.lower() for c in columns}, "_"
    while taken & {n + tail for n in names}:
        tail += "_"
    return [n + tail for n in names]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns of the input cannot clash."""
    return df.select(*(F.col(f"`{n}`") for n in names))
