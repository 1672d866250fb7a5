"""Fusion of ranked channels, the curation prior, diversification and reranking."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONSTANT = 60
DEPTH = 100


def fuse(channels: Mapping[str, DataFrame], weights: Mapping[str, float], id: str = "unit_id", query_id: str = "query_id", constant: int = CONSTANT) -> DataFrame:
    """Weighted reciprocal ranks: query_id, id, score. A channel that lacks a unit adds nothing."""
    tagged = [df.select(query_id, id, (F.lit(float(weights[name])) / (constant + F.col("rank"))).alias("part"), F.lit(name).alias("channel")) for name, df in channels.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    pick = lambda n: F.coalesce(F.max(F.when(F.col("channel") == n, F.col("part"))), F.lit(0.0))
    return rows.groupBy(query_id, id).agg(reduce(Column.__add__, map(pick, sorted(channels))).alias("score"))  # a fixed order of addition


def prior(**parts: tuple[float, Column]) -> Column:
    """1 + the weighted sum of scores in [0, 1]; a missing score counts 0, and nothing is filtered."""
    return reduce(Column.__add__, (F.lit(float(w)) * F.coalesce(s, F.lit(0.0)) for w, s in parts.values()), F.lit(1.0))


def ranked(scored: DataFrame, id: str = "unit_id", query_id: str = "query_id", k: int | None = None) -> DataFrame:
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id)))
    return out if k is None else out.where(F.col("rank") <= k)


def diversify(found: DataFrame, per_scene: int = 2, per_film: int = 4, k: int = 30, query_id: str = "query_id", order: str = "rank") -> DataFrame:
    """At most ``per_scene`` of a scene, then ``per_film`` of a film, then the first k. Equal to one greedy pass as each scene lies in one film."""
    count = lambda *keys: F.row_number().over(Window.partitionBy(query_id, *keys).orderBy(order))
    few = found.withColumn("_s", count("film_id", "scene_id")).where(F.col("_s") <= per_scene)
    few = few.withColumn("_f", count("film_id")).where(F.col("_f") <= per_film)
    return few.withColumn("place", count()).where(F.col("place") <= k).drop("_s", "_f")


def rerank(found: DataFrame, score: Column, k: int = 30, query_id: str = "query_id", id: str = "unit_id") -> DataFrame:
    """A second ranking of the first k by another score (1 to 10), ties by the first rank."""
    first = found.where(F.col("rank") <= k).withColumn("rerank_score", score)
    return first.withColumn("new_rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("rerank_score"), "rank", id)))
