"""An approximate index of vectors: inverted lists with product-quantised residuals, exact distances for the best candidates.

``fit`` learns from a bounded sample, ``write`` indexes every unit: each goes to its ``spill`` nearest lists, as a code of one byte a subspace that stands for its difference
from the list's centroid. Lists are partitions of a Parquet table, so a search reads the codes of those lists alone that some query probes. Code distances are sums
of looked-up numbers; the ``rerank`` nearest by them are compared exactly with the units' vectors.

Vectors are compared by their cosine: they are normalised, and zero vectors are not found. Where vectors have no clusters, neighbours lie in many lists; more
than one list a unit (spill) then finds more of them for the same number of lists, at the price of that many codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotloom.functions import vectors as V
from shotloom.operators.search import TOP, _matrix, _unit

#: Codes of a block, and queries of a block, that meet in one step.
BLOCK = 4096


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's centroids in memory; at most as many as there are rows. An empty cluster keeps its centroid."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, the nearest first."""
    d = (c**2).sum(1) - 2 * x @ c.T
    k = min(k, len(c))
    some = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


@dataclass
class ProductIndex:
    """Centroids (lists x dim) and one codebook a subspace (subspaces x codes x dim / subspaces)."""

    centroids: np.ndarray
    books: np.ndarray
    spill: int = 1

    @classmethod
    def fit(cls, units: DataFrame, lists: int = 64, subspaces: int = 16, codes: int = 256, spill: int = 1, sample: int = 20_000, vector: str = "txt_vec", id: str = "unit_id", rounds: int = 12, seed: int = 5) -> ProductIndex:
        """Learn from the ``sample`` units with the least hashes of their ids, which bounds what the driver holds."""
        some = units.select(F.col(vector).cast("array<double>").alias("v"), F.col(id).alias("id")).where("v is not null")
        rows = some.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
        _, x = _unit(np.array([r[0] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, subspaces)))
        if not len(x):
            raise ValueError("no vectors to learn from")
        if x.shape[1] % subspaces:
            raise ValueError(f"{x.shape[1]} dimensions don't divide into {subspaces} subspaces")
        centroids = kmeans(x, lists, rounds, seed)
        own = nearest(x, centroids, spill)
        rest = (x[:, None] - centroids[own]).reshape(-1, subspaces, x.shape[1] // subspaces)
        rest = rest[np.random.default_rng(seed).permutation(len(rest))[:sample]]
        books = [kmeans(np.ascontiguousarray(rest[:, s]), codes, rounds, seed + s) for s in range(subspaces)]
        return cls(centroids, np.stack(books), spill)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """One byte a subspace for normalised vectors in the given lists."""
        subspaces, _, size = self.books.shape
        rest = (x - self.centroids[lists]).reshape(len(x), subspaces, size)
        return np.stack([nearest(rest[:, s], self.books[s], 1)[:, 0] for s in range(subspaces)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray, part: int) -> np.ndarray:
        """For normalised queries and a list: the squared distance to each code of each subspace (queries x subspaces x codes)."""
        subspaces, _, size = self.books.shape
        rest = (queries - self.centroids[part]).reshape(len(queries), subspaces, 1, size)
        return ((rest - self.books) ** 2).sum(-1)

    def write(self, units: DataFrame, path: str, vector: str = "txt_vec", id: str = "unit_id") -> None:
        """codes/list=l: ids and codes of each list in blocks; vectors: the units' vectors by id."""
        some = units.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
        kind = dict(some.dtypes)["id"]

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    rows, x = _unit(_matrix(part.column(1)))
                    if not len(rows):
                        continue
                    lists = nearest(x, self.centroids, self.spill)
                    of = np.repeat(np.arange(len(rows)), lists.shape[1])
                    codes = self.encode(x[of], lists.ravel())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[of])), pa.array(lists.ravel().astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "list", "code"])

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Runs of one list, at most BLOCK rows long, as a row each."""
            for batch in batches:
                lists = batch.column(1).to_numpy()
                turns = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]]) if len(lists) else np.zeros(1, np.int64)
                for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
                    for at in range(a, b, BLOCK):
                        n = min(BLOCK, b - at)
                        ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([batch.column(0).slice(at, n)]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([b"".join(batch.column(2).slice(at, n).to_pylist())], pa.binary()), pa.array([int(lists[at])], pa.int32())], names=["ids", "codes", "list"])

        coded = some.mapInArrow(code, f"id {kind}, list int, code binary").hint("rebalance", "list").sortWithinPartitions("list")  # a very long list is split
        coded.mapInArrow(block, f"ids array<{kind}>, codes binary, list int").write.partitionBy("list").parquet(f"{path}/codes")
        some.write.parquet(f"{path}/vectors")

    def search(self, spark: SparkSession, path: str, queries: DataFrame, k: int = TOP, probes: int = 8, rerank: int = 200, id: str = "unit_id", query_id: str = "query_id", query_vector: str = "query_vec") -> DataFrame:
        """query_id, id, distance, rank: the nearest of the ``rerank`` best codes in the ``probes`` lists nearest to each query."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null")
        stored = spark.read.parquet(f"{path}/vectors")
        kinds = dict(asked.dtypes)["query_id"], dict(stored.dtypes)["id"]

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, x = _unit(_matrix(batch.column(1)))
                if len(rows):
                    lists = nearest(x, self.centroids, probes)
                    of = np.repeat(rows, lists.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(lists.ravel().astype(np.int32))], names=["query_id", "v", "list"])

        probed = asked.mapInArrow(choose, f"query_id {kinds[0]}, v array<double>, list int")
        often = probed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        wanted = [r["list"] for r in often.select("list").collect()]  # at most as many as there are lists
        blocks = probed.join(often, "list").groupBy("list", F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))
        codes = spark.read.parquet(f"{path}/codes").where(F.col("list").isin(wanted))  # prunes partitions

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            subspaces = len(self.books)
            for batch in batches:
                for r in range(batch.num_rows):
                    part, asked, ids = batch.column(0)[r].as_py(), batch.column(1)[r].values, batch.column(2)[r].values
                    code = np.frombuffer(batch.column(3)[r].as_py(), np.uint8).reshape(-1, subspaces)
                    _, x = _unit(_matrix(asked.field(1)))
                    kept_q, kept_u, kept_d = [], [], []
                    for at in range(0, len(x), 64):
                        table = self.tables(x[at : at + 64], part)
                        far = sum(table[:, s][:, code[:, s]] for s in range(subspaces))
                        top = min(rerank, far.shape[1])
                        best = np.argpartition(far, top - 1, axis=1)[:, :top]
                        kept_q.append(np.repeat(np.arange(at, at + len(far)), top))
                        kept_u.append(best.ravel())
                        kept_d.append(np.take_along_axis(far, best, 1).ravel())
                    q, u, d = (np.concatenate(y) for y in (kept_q, kept_u, kept_d))
                    yield pa.RecordBatch.from_arrays([asked.field(0).take(pa.array(q)), ids.take(pa.array(u)), pa.array(d)], names=["query_id", "id", "near"])

        found = blocks.select("list", "asked").join(codes, "list").select("list", "asked", "ids", "codes").mapInArrow(compare, f"query_id {kinds[0]}, id {kinds[1]}, near double")
        found = found.groupBy("query_id", "id").agg(F.min("near").alias("near"))  # a unit may lie in several lists
        best = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "id"))).where(F.col("n") <= rerank)
        exact = best.select("query_id", "id").join(stored.withColumnRenamed("v", "u"), "id").join(asked, "query_id").select("query_id", "id", V.distance(F.col("u"), F.col("v")).alias("distance"))
        ranked = exact.where("distance is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
        return ranked.select(F.col("query_id").alias(query_id), F.col("id").alias(id), "distance", "rank")
