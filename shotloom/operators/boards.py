"""Boards of saved units, and the log of what was shown and chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOARD = "board_id string, unit_id string, saved_at double, note string"
LOG = "query string, shown array<string>, chosen string, at double"


def contents(boards: DataFrame, units: DataFrame) -> DataFrame:
    """Saved units with their data; units that have gone keep their row."""
    return boards.join(units, "unit_id", "left")


def click_rates(log: DataFrame) -> DataFrame:
    """unit_id, shown, chosen, rate over the whole log."""
    seen = log.select(F.explode("shown").alias("unit_id"), F.lit(1).alias("shown"), F.lit(0).alias("chosen"))
    taken = log.where("chosen is not null").select(F.col("chosen").alias("unit_id"), F.lit(0).alias("shown"), F.lit(1).alias("chosen"))
    rows = seen.unionByName(taken).groupBy("unit_id").agg(F.sum("shown").alias("shown"), F.sum("chosen").alias("chosen"))
    return rows.withColumn("rate", F.try_divide(F.col("chosen").cast("double"), F.col("shown")))


def chosen_ranks(log: DataFrame) -> DataFrame:
    """How often the n-th shown unit was the chosen one."""
    return log.withColumn("rank", F.array_position("shown", F.col("chosen"))).where("rank > 0").groupBy("rank").agg(F.count("*").alias("n"))
