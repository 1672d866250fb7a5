"""Connected components of an edge table, by alternating star contractions.

Each round rewrites the edges so that every node points at the least node it knows (first for its larger neighbours, then for the
smaller ones) and is written to the shared folder; the number of rounds grows with the logarithm of the longest chain. Only a row
count and a checksum reach the driver. Minima are aggregated before the joins, so a node with very many edges is split by
the engine's skew handling and never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm._words import discard, settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
    return row["n"], row["x"]


def connected(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """edges(a, b) of longs to (node, component): the least node reachable. Nodes without edges are left out; loops and repeats are allowed."""
    own = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    own = settle(own, folder, f"{name}/0")
    seen, k = _mark(own), 0
    while seen[0]:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        k += 1
        own = settle(small.where("u <> v").distinct(), folder, f"{name}/{k}")
        discard(own.sparkSession, folder, f"{name}/{k - 1}")
        now = _mark(own)
        if now == seen:
            break
        seen = now
    roots = own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return own.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
