"""A stored index for BM25: postings in blocks with bounds, from which a search reads its terms' blocks and decodes those that can matter.

``add`` writes a segment: rows are dealt to shards of about SHARD by the hash of their id, fewer where texts are long, and numbered there. A task turns the rows of a shard, in slices of at most
TOKENS, into blocks of up to BLOCK postings of one term: the rows' numbers as differences, frequencies and lengths, which the table's pages compress, and beside them its first and last row, its
greatest frequency and least length. From these follows a bound of its scores under any corpus' mean length, so that segments may be added later. Blocks lie in partitions by the hash of their term.

``search`` takes the blocks of the queries' terms, with document frequencies and lengths over all segments. A group is a shard with up to QUERIES queries, so a block is sent once for so many queries
and not once for each; a task's work is bounded by the shard. For a query the shard's rows are cut into chunks, each with the sum of its terms' greatest bounds. They are scored from the greatest bound
down, more at a time as it goes on, until no bound reaches the k-th best score; blocks of the rest are never decoded. So results equal those of ``lexical.bm25`` over all rows. An id is to be added once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotloom.functions.text import tokens
from shotloom.operators.lexical import K1, LENGTH

BLOCK, SHARD, BUCKETS = 128, 20_000, 64
#: A shard's characters a row, on average, beyond which there are more shards; and the tokens that a task holds at a time.
CHARS, TOKENS = 4000, 1 << 20
QUERIES = 512
_CODED = "term string, shard int, first int, last int, n int, most int, least int, data binary"


def _bucket(term: str):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def add(corpus: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> str:
    """Index the rows as a new segment below path; returns its name."""
    name = f"s{uuid.uuid4().hex}"
    size = corpus.agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).first()
    shards = max(1, -(-size["n"] // SHARD), -(-(size["chars"] or 0) // (SHARD * CHARS)))
    cut = corpus.select(F.col(id).alias("id"), F.filter(tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: t.isNotNull()).alias("t"))
    dealt = cut.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", F.size("t").alias("length"), "t")
    numbered = dealt.withColumn("no", (F.row_number().over(Window.partitionBy("shard").orderBy("id")) - 1).cast("int"))  # about SHARD rows a shard
    numbered.write.parquet(f"{path}/rows/segment={name}")
    rows = corpus.sparkSession.read.parquet(f"{path}/rows/segment={name}")  # in the order of their numbers
    block, most = BLOCK, TOKENS
    coded = rows.select("shard", "no", "length", "t").mapInArrow(lambda batches: _code(batches, block, most), _CODED)
    coded.withColumn("bucket", _bucket("term")).repartition("bucket").sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks/segment={name}")
    return name


def _code(batches: Iterator[pa.RecordBatch], block: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, no, length, tokens) to blocks; those of a shard that follow each other go together, up to ``most`` tokens."""
    held: list[tuple] = []
    shard, count = None, 0
    for batch in batches:
        of, total = batch.column(0).to_numpy(), np.cumsum(batch.column(2).to_numpy(), dtype=np.int64)
        turn = np.flatnonzero((np.diff(of) != 0) | (np.diff(total // most) != 0)) + 1
        for a, b in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            n = int(total[b - 1] - (total[a - 1] if a else 0))
            if held and (of[a] != shard or count + n > most):
                yield _blocks(shard, held, block)
                held, count = [], 0
            lists = batch.column(3).slice(a, b - a)  # only the tokens' numbers are held
            held.append((*(batch.column(c).to_numpy()[a:b].copy() for c in (1, 2)), pc.list_value_length(lists).to_numpy(), lists.flatten().dictionary_encode()))
            shard, count = of[a], count + n
    if held:
        yield _blocks(shard, held, block)


def _blocks(shard: int, parts: list[tuple], block: int) -> pa.RecordBatch:
    """Of the rows' numbers, lengths, list sizes and tokens the blocks by term, each in the order of the numbers."""
    nos, lengths, sizes = (np.concatenate([p[k] for p in parts]).astype(np.int32) for k in range(3))
    terms = pa.chunked_array([p[3] for p in parts]).unify_dictionaries().combine_chunks()
    order = np.argsort(nos, kind="stable")
    rank = np.empty(len(nos), np.int64)
    rank[order] = np.arange(len(nos))
    row = np.repeat(rank, sizes)
    nos, lengths = nos[order], lengths[order]
    cell, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(nos) + row, return_counts=True)
    which, row = cell // len(nos), cell % len(nos)
    no, length, tf = nos[row], lengths[row], tf.astype(np.int32)
    new = np.diff(which, prepend=-1) != 0
    at = np.arange(len(which))
    start = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % block == 0)
    n = np.diff(np.append(start, len(which)))
    gap = np.diff(no, prepend=np.int32(0))
    gap[start] = no[start]
    data = np.empty(3 * len(which), np.int32)
    place, size = at + 2 * np.repeat(start, n), np.repeat(n, n)
    for k, x in enumerate((gap, tf, length)):
        data[place + k * size] = x
    raw = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(12 * start, 12 * len(which)).astype(np.int32)), pa.py_buffer(data)])
    last = start + n - 1
    most, least = (f.reduceat(x, start) if len(start) else x for f, x in ((np.maximum, tf), (np.minimum, length)))
    columns = terms.dictionary.take(pa.array(which[start])), np.full(len(start), shard, np.int32), no[start], no[last], n.astype(np.int32), most, least, raw
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[c.split()[0] for c in _CODED.split(", ")])


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, k1: float = K1, b: float = LENGTH, id: str = "doc_id", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, id, score, rank of the k best rows. A query term counts once."""
    found = scan(spark, path, queries, k, k1, b, query_id, query).where("score is not null")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), F.col("id").alias(id), "score", "rank")


def scan(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, k1: float = K1, b: float = LENGTH, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, id, score of each shard's k best rows, and for each query and shard a row without score: its numbers of blocks and of those decoded."""
    rows = spark.read.parquet(f"{path}/rows").select("segment", "shard", "no", "id", "length")
    total = rows.agg(F.count("*").cast("double").alias("docs"), F.avg("length").alias("mean"))
    parts = max(1, -(-queries.count() // QUERIES))
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query)))).alias("term")).where("term is not null")
    terms = terms.distinct().withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    wanted = [r["bucket"] for r in terms.select(_bucket("term").alias("bucket")).distinct().collect()]  # at most BUCKETS numbers
    blocks = spark.read.schema(f"{_CODED}, segment string, bucket int").parquet(f"{path}/blocks").where(F.col("bucket").isin(wanted))
    df = blocks.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(df, "term").join(F.broadcast(total)).select("part", "query_id", "term", idf.alias("idf"), "mean")  # one row of totals
    asked = asked.join(F.broadcast(rows.select("segment", "shard").distinct()))  # every shard gets every query's terms
    met = blocks.join(terms.select("part", "term").distinct(), "term").select("part", "segment", "shard", "term", "first", "last", "n", "most", "least", "data")
    kind, chunk = dict(queries.dtypes)[query_id], BLOCK
    schema = f"query_id {kind}, segment string, shard int, no int, score double, blocks int, decoded int"

    def best(table: pa.Table) -> pa.Table:
        segment, shard = table.column("segment")[0].as_py(), table.column("shard")[0].as_py()
        given = table.filter(pc.is_valid(table.column("data"))).sort_by([("term", "ascending"), ("first", "ascending")]).combine_chunks()
        asks = table.filter(pc.is_null(table.column("data"))).combine_chunks()
        names, which, size = given.column("term").unique(), given.column("term"), given.num_rows
        term = pc.index_in(asks.column("term"), value_set=names)
        here = pc.is_valid(term)
        asks, term = asks.filter(here), term.filter(here).to_numpy().astype(np.int64)
        coded = asks.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        query, idfs = coded.indices.to_numpy(), asks.column("idf").to_numpy()
        found: list[tuple[int, np.ndarray, np.ndarray, int, int]] = []
        if size and len(query):
            first, last, n, most, least = (given.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "n", "most", "least"))
            raw = given.column("data").combine_chunks()
            at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + size].astype(np.int64) // 4
            numbers = np.frombuffer(raw.buffers()[2], np.int32)
            of = pc.index_in(which, value_set=names).to_numpy()
            edge = np.searchsorted(of, np.arange(len(names) + 1))  # a term's blocks
            mean = asks.column("mean")[0].as_py()
            weight = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
            bound = weight(most, least)
            order = np.argsort(query, kind="stable")
            ends = np.searchsorted(query[order], np.arange(len(coded.dictionary) + 1))
            for q, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                mine = order[x:y]
                found.append((q, *_best_of_shard(term[mine], idfs[mine], edge, first, last, n, bound, at, numbers, weight, k, chunk)))
        columns: dict[str, list] = {c: [] for c in ("q", "no", "score", "blocks", "decoded")}
        for q, no, score, blocks_, decoded in found:
            m = len(no)
            for c, x in zip(columns, ([q] * (m + 1), [*no.tolist(), None], [*score.tolist(), None], [0] * m + [blocks_], [0] * m + [decoded]), strict=True):
                columns[c] += x
        m = len(columns["q"])
        arrays = [coded.dictionary.take(pa.array(columns["q"], pa.int64())), pa.array([segment] * m, pa.string()), pa.array([shard] * m, pa.int32()), pa.array(columns["no"], pa.int32())]
        arrays += [pa.array(columns["score"], pa.float64()), *(pa.array(columns[c], pa.int32()) for c in ("blocks", "decoded"))]
        return pa.table(arrays, names=[c.split()[0] for c in schema.split(", ")])

    top = met.unionByName(asked, allowMissingColumns=True).groupBy("part", "segment", "shard").applyInArrow(best, schema)
    return top.join(rows.drop("length"), ["segment", "shard", "no"], "left").select("query_id", "id", "score", "blocks", "decoded")


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of n."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def _best_of_shard(term, idf, edge, first, last, n, bound, at, numbers, weight, k: int, chunk: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For one query: numbers and scores of the shard's k best rows with all that equal the k-th, its blocks, and those that were decoded."""
    many = edge[term + 1] - edge[term]
    own = _spread(edge[term], many)
    slot, factor = np.repeat(np.arange(len(term)), many), np.repeat(idf, many)
    a, z = first[own] // chunk, last[own] // chunk
    chunks = int(z.max()) + 1
    upper = np.zeros(len(term) * chunks)
    np.maximum.at(upper, _spread(slot * chunks + a, z - a + 1), np.repeat(factor * bound[own], z - a + 1))
    upper = upper.reshape(len(term), chunks).sum(axis=0)
    turns = np.argsort(-upper, kind="stable")
    turns = turns[upper[turns] > 0]
    no, score, least_best, seen, step, decoded = np.zeros(0, np.int64), np.zeros(0), -np.inf, 0, 1, np.zeros(len(own), bool)
    while seen < len(turns):
        now = turns[seen : seen + step]
        now = now[upper[now] + 2e-6 >= least_best]  # scores are rounded to six places
        if not len(now):
            break
        seen, step = seen + step, step * 4
        chosen = np.zeros(chunks, bool)
        chosen[now] = True
        before = np.concatenate([[0], np.cumsum(chosen)])
        use = before[z + 1] > before[a]
        decoded |= use
        blocks, size = own[use], n[own[use]]
        place, wide = _spread(at[blocks], size), np.repeat(size, size)
        row = np.cumsum(numbers[place], dtype=np.int64)
        begin = np.cumsum(size) - size
        row -= np.repeat(row[begin] - first[blocks], size)
        inside = chosen[row // chunk]
        row, place, wide = row[inside], place[inside], wide[inside]
        s = np.repeat(factor[use], size)[inside] * weight(numbers[place + wide].astype(np.float64), numbers[place + 2 * wide])
        sums = np.bincount(row, s)
        hit = np.flatnonzero(sums)
        no, score = np.concatenate([no, hit]), np.concatenate([score, np.round(sums[hit], 6)])
        if len(score) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            no, score = no[keep], score[keep]
        if len(score) >= k:
            least_best = score.min()
    return no, score, len(own), int(decoded.sum())


def merge(spark: SparkSession, path: str, into: str) -> str:
    """All segments as one, below another path."""
    rows = spark.read.parquet(f"{path}/rows")
    return add(rows.select("id", F.array_join("t", " ").alias("text")), into, "id", "text")
