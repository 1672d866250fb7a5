"""Dense search: exact cosine top-k for one query or a batch, and filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shotloom.functions import paths as P
from shotloom.functions import vectors as V

TOP = 20
#: Queries or units of a block, of which a task holds one each.
BATCH = 4096
#: Units of a slot, about.
SLOT = 1 << 20


def filtered(units: DataFrame, wanted: Mapping[str, object] | None = None, representative: bool = True) -> DataFrame:
    """Units for search, before any ranking. A null or missing wish does not filter; a list means any of its values."""
    if representative and "is_representative" in units.columns:
        units = units.where("is_representative")
    for name, value in (wanted or {}).items():
        if value is not None:
            units = units.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return units


def top_k(units: DataFrame, query: Sequence[float] | Column, k: int = TOP, vector: str = "txt_vec", id: str = "unit_id") -> DataFrame:
    """The k nearest units with distance and rank; equal distances go by id, zero vectors are left out.

    One scan that keeps k rows a task: the plan is TakeOrderedAndProject over the columns in use.
    """
    q = query if isinstance(query, Column) else V.literal(query)
    near = units.withColumn("distance", V.distance(F.col(vector), q)).where("distance is not null").orderBy("distance", id).limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", id)))


def top_k_batch(units: DataFrame, queries: DataFrame, k: int = TOP, vector: str = "txt_vec", id: str = "unit_id", query_id: str = "query_id", query_vector: str = "query_vec") -> DataFrame:
    """query_id, id, distance, rank for a batch of queries against all units.

    Up to BATCH queries are sent to every task, which reads its units once and keeps k a query. More are a table: units are packed into blocks and dealt to
    slots of about SLOT units, once; queries are packed into blocks of about BATCH, which go to every slot; and a join on the slot brings each block
    of queries together with the slot's blocks of units, one after the other. Only k rows a slot and query are shuffled in either case.
    """
    kind = dict(queries.dtypes)[query_id], dict(units.dtypes)[id]
    out = f"query_id {kind[0]}, id {kind[1]}, distance double"
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("query_vec")).where("query_vec is not null")
    searched = units.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    first = asked.limit(BATCH + 1).collect()
    if len(first) <= BATCH:
        near = searched.mapInArrow(_nearest_of(first, to_arrow_type(queries.schema[query_id].dataType), k), out)
    else:
        blocks = -(-asked.count() // BATCH)
        slots = max(1, -(-searched.count() // SLOT))
        asked = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "query_vec")).alias("asked"))  # about BATCH each
        asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        dealt = searched.mapInArrow(_packed, f"ids array<{kind[1]}>, units array<array<double>>").withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
        near = asked.hint("merge").join(dealt, "slot").select("block", "asked", "ids", "units").mapInArrow(_nearest_blocks(k), out)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), F.col("id").alias(id), "distance", "rank")


def _matrix(rows: pa.Array) -> np.ndarray:
    """Vectors of one length, null components as NaN."""
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows aren't zero or broken, and those at length 1."""
    n = np.linalg.norm(x, axis=1)
    usable = np.flatnonzero(n > 0)
    return usable, x[usable] / n[usable, None]


class _Best:
    """The k nearest units to each query of a block so far; equal distances go by id."""

    def __init__(self, names: pa.Array, vectors: np.ndarray, k: int) -> None:
        self.usable, self.matrix = _unit(vectors)
        self.names, self.k = names, k
        self.query, self.distance, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, ids: pa.Array, vectors: np.ndarray) -> None:
        rows, x = _unit(vectors)
        if not len(rows) or not len(self.usable):
            return
        far = np.round(1 - self.matrix @ x.T, 6) + 0.0  # no negative zeros
        if len(rows) > self.k:
            q, u = np.nonzero(far <= np.partition(far, self.k - 1, axis=1)[:, self.k - 1 : self.k])  # with all that are as far as the k-th
        else:
            q, u = (y.ravel() for y in np.indices(far.shape))
        query, distance = np.concatenate([self.query, q]), np.concatenate([self.distance, far[q, u]])
        own = ids.take(pa.array(rows[u]))
        own = pa.concat_arrays([self.ids, own]) if self.ids is not None else own
        place = pc.rank(own, sort_keys="ascending", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, distance, query))
        query = query[order]
        start = np.searchsorted(query, query)
        keep = order[np.arange(len(query)) - start < self.k]
        self.query, self.distance, self.ids = np.concatenate([self.query, q])[keep], distance[keep], own.take(pa.array(keep))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            yield pa.RecordBatch.from_arrays([self.names.take(pa.array(self.usable[self.query])), self.ids, pa.array(self.distance)], names=["query_id", "id", "distance"])


def _nearest_of(rows: list[Row], kind: pa.DataType, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's k nearest units (id, vector) to each of the queries (id, vector)."""
    names, vectors = pa.array([r[0] for r in rows], kind), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(names, vectors, k)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                best.add(part.column(0), _matrix(part.column(1)))
        yield from best.rows()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units (id, vector) in blocks, a row each."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            ends = pa.array([0, part.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.concat_arrays([part.column(k)])) for k in (0, 1)], names=["ids", "units"])


def _nearest_blocks(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows of a block of queries and one of units: the k nearest of all units that follow each other with one block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = best = None
        for batch in batches:
            for r in range(batch.num_rows):
                number = batch.column(0)[r].as_py()
                if number != block:
                    if best is not None:
                        yield from best.rows()
                    asked = batch.column(1)[r].values
                    block, best = number, _Best(asked.field(0), _matrix(asked.field(1)), k)
                best.add(batch.column(2)[r].values, _matrix(batch.column(3)[r].values))
        if best is not None:
            yield from best.rows()

    return run


def results(found: DataFrame) -> DataFrame:
    """The public form of a result, with its media URLs."""
    return found.select("unit_id", "film_id", "t_start", "t_end", "caption", P.keyframe_url(F.col("shot_id")).alias("keyframe_url"), P.preview_url(F.col("shot_id")).alias("preview_url"), "distance", "rank")


def like_unit(units: DataFrame, unit_id, k: int = TOP, vector: str = "img_vec", id: str = "unit_id") -> DataFrame:
    """More like this: the nearest units to one unit's vector, itself left out."""
    row = units.where(F.col(id) == F.lit(unit_id)).select(vector).first()
    if row is None or row[0] is None:
        return units.limit(0).withColumns({"distance": F.lit(None).cast("double"), "rank": F.lit(None).cast("int")})
    return top_k(units.where(F.col(id) != F.lit(unit_id)), row[0], k, vector, id)
