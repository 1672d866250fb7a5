"""Vector pooling: the normalised mean of a group's vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.functions.vectors import l2_normalize


def mean_vector(frames: DataFrame, *keys: str, vector: str = "vec") -> DataFrame:
    """keys, n, mean (double): element-wise means, summed before the shuffle; dimensions come back in order."""
    parts = frames.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    rows = parts.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("a"))
    return rows.select(*keys, "n", F.transform("a", lambda s: s["m"]).alias("mean"))


def shot_vector(frames: DataFrame, *keys: str, vector: str = "vec") -> DataFrame:
    """The L2-normalised mean as float: one vector a shot from those of its keyframes."""
    return mean_vector(frames, *keys, vector=vector).select(*keys, l2_normalize(F.col("mean").cast("array<float>")).alias("img_vec"))


def require_frames(times: Column) -> Column:
    """The keyframe times; an error where a shot has none."""
    return F.when(F.size(times) > 0, times).otherwise(F.raise_error(F.lit("a shot has no keyframes")))
