"""Lexical search: Okapi BM25 over exploded tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shotloom.functions.text import tokens

K1, LENGTH = 1.2, 0.75
#: Pairs of query and term up to which they are sent to every task.
TERMS = 100_000
#: Queries up to which a task keeps the best rows of each, and scores that it holds at a time.
QUERIES, CELLS = 4096, 1 << 21


def bm25(corpus: DataFrame, queries: DataFrame, k: int | None = 10, k1: float = K1, b: float = LENGTH, id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, id, score, rank of the k best rows (all with None). A query term counts once.

    Few queries (``QUERIES``) over rows with ids of their own take two passes without a shuffle of rows: counts of the query terms, which are few, then each task scores its rows and keeps
    the k best a query. Else scores are joined and summed up, a row for each query and row with a term in common, as rows of one id are one row:

    the corpus is read and cut into tokens once: of its tokens only query terms go on, with one empty token a row, which sums up to the corpus'
    totals before the shuffle. Frequencies of terms, totals and scores all use that one shuffle, whose keys (term, row) are many. Up to ``TERMS``
    pairs of query and term are broadcast, so no term's occurrences meet in one task; more are joined, where skewed ones are split at run time.
    """
    terms = queries.select(query_id, F.explode(F.array_distinct(tokens(F.col(query)))).alias("term"))
    pairs = terms.where(F.col("term").isNotNull()).limit(TERMS + 1).toArrow()
    few = pairs.num_rows <= TERMS
    if few and k is not None and len(pairs.column(0).unique()) <= QUERIES and corpus.groupBy(id).count().where("count > 1").isEmpty():
        best = _best(corpus, pairs, k, k1, b, id, text, query_id, dict(queries.dtypes)[query_id])
        return best.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id))).where(F.col("rank") <= k)
    sent = F.broadcast if few else (lambda df: df)
    cut = corpus.select(id, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).withColumn("n", F.size("t"))
    spread = cut.select(id, "n", F.explode(F.concat(F.array(F.lit("")), "t")).alias("term")).where("term is not null")
    if few:
        spread = spread.join(F.broadcast(terms.select("term").union(corpus.sparkSession.sql("SELECT '' AS term")).distinct()), "term", "left_semi")
    real = F.col("term") != ""
    keys = "term", F.when(real, F.col(id)).alias(id), F.when(real, F.col("n")).alias("n")
    hits = spread.groupBy(*keys).agg(F.count("*").alias("tf"), F.sum(F.when(~real, F.col("n"))).alias("words"))
    total = hits.where("words is not null").select(F.col("tf").cast("double").alias("docs"), (F.col("words") / F.col("tf")).alias("mean"))
    found = hits.where("words is null")
    df = found.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # of tf, so that the shuffle is the same as that of the scores
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(df, "term").join(F.broadcast(total)).select(query_id, "term", "mean", idf.alias("idf"))  # one row of totals
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    scored = found.join(sent(asked), "term").groupBy(query_id, id).agg(F.round(F.sum(F.col("idf") * weight), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _best(corpus: DataFrame, pairs: pa.Table, k: int, k1: float, b: float, id: str, text: str, query_id: str, kind: str) -> DataFrame:
    """query_id, id, score of each task's k best rows for the pairs of query and term; ids occur once."""
    spark, own = corpus.sparkSession, corpus.schema[id].dataType
    cut = corpus.select(id, F.filter(tokens(F.coalesce(F.col(text), F.lit(""))), lambda t: t.isNotNull()).alias("t")).withColumn("n", F.size("t"))
    asked, names = pairs.column(0).unique(), pairs.column(1).unique()
    wanted = spark.createDataFrame([("",), *((x,) for x in names.to_pylist())], "term string")
    spread = cut.select("n", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("t"))).alias("term")).join(F.broadcast(wanted), "term", "left_semi")
    counts = {r["term"]: r for r in spread.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("words")).collect()}  # a row a query term, and one of totals
    docs, mean = (counts[""]["df"], counts[""]["words"] / counts[""]["df"]) if "" in counts else (0, 1.0)
    df = np.array([counts[x]["df"] if x in counts else 0 for x in names.to_pylist()], np.float64)
    idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
    term, query = (pc.index_in(pairs.column(i), value_set=v).to_numpy() for i, v in ((1, names), (0, asked)))
    query = query[np.argsort(term, kind="stable")]
    first = np.searchsorted(np.sort(term), np.arange(len(names) + 1))  # the queries of a term
    run = _best_of_task(names, asked, first, query, idf, mean, k, k1, b, to_arrow_type(own), query_id, id)
    return cut.select(id, "n", "t").mapInArrow(run, f"`{query_id}` {kind}, `{id}` {own.simpleString()}, score double")


def _best_of_task(names: pa.Array, asked: pa.Array, first: np.ndarray, query: np.ndarray, idf: np.ndarray, mean: float, k: int, k1: float, b: float, kind: pa.DataType, query_id: str, id: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (id, n, tokens) the k best for each query; equal scores go by id."""
    step = max(1, CELLS // max(1, len(asked)))

    def scores(part: pa.RecordBatch) -> np.ndarray:
        """Rows by queries, 0 without a term in common."""
        n, found = part.column(1).to_numpy(), pc.index_in(part.column(2).flatten(), value_set=names)
        rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy())
        there = found.is_valid().to_numpy(zero_copy_only=False)
        cell, tf = np.unique(rows[there] * len(names) + pc.drop_null(found).to_numpy(), return_counts=True)
        row, term = cell // max(1, len(names)), cell % max(1, len(names))
        weight = idf[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[row] / mean)))
        times = first[term + 1] - first[term]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[term], times)
        return np.bincount(np.repeat(row, times) * len(asked) + query[at], np.repeat(weight, times), part.num_rows * len(asked)).reshape(part.num_rows, len(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, best, ids = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        least = np.zeros(len(asked))  # the k-th score of each query so far
        for batch in batches:
            for start in range(0, batch.num_rows if len(asked) else 0, step):
                part = batch.slice(start, step)
                raw = scores(part)
                score = np.round(raw, 6)
                if len(score) > k:
                    least = np.maximum(least, np.partition(score, len(score) - k, axis=0)[len(score) - k])
                row, q = np.nonzero((raw > 0) & (score >= least))  # with all that equal the k-th
                of, best = np.concatenate([of, q]), np.concatenate([best, score[row, q]])
                ids = pa.concat_arrays([ids, part.column(0).take(pa.array(row))])
                place = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy()
                order = np.lexsort((place, -best, of))
                keep = order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < k]
                of, best, ids = of[keep], best[keep], ids.take(pa.array(keep))
                full = np.flatnonzero(np.bincount(of, minlength=len(asked)) >= k)
                low = np.full(len(asked), np.inf)
                np.minimum.at(low, of, best)
                least[full] = np.maximum(least[full], low[full])
        yield pa.RecordBatch.from_arrays([asked.take(pa.array(of)), ids, pa.array(best)], names=[query_id, id, "score"])

    return run
