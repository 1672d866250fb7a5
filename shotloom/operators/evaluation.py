"""Retrieval evaluation: hits by containment, hit@k, reciprocal rank, roll-ups, comparisons."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the film id of an answer that has not been filled in.
PLACEHOLDER = "REPLACE_WITH_FILM_ID"
TOLERANCE = 5.0


def is_placeholder(acceptable: Column) -> Column:
    """All answers are placeholders; so are none at all."""
    none = F.array().cast("array<struct<film_id:string,t_start:double,t_end:double>>")
    return F.forall(F.coalesce(acceptable, none), lambda a: a["film_id"] == PLACEHOLDER)


def is_hit(film: Column, start: Column, end: Column, acceptable: Column, tolerance: float = TOLERANCE) -> Column:
    """The result lies inside one of the answers, widened by the tolerance on both sides."""
    inside = lambda a: (a["film_id"] == film) & (start >= a["t_start"] - tolerance) & (end <= a["t_end"] + tolerance)
    return F.coalesce(F.exists(acceptable, inside), F.lit(False))


def first_hits(gold: DataFrame, found: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """id, intent, first_rank of each evaluated query (null without a hit); found: id, rank, film_id, t_start, t_end."""
    asked = gold.where(~is_placeholder(F.col("acceptable")))
    hit = is_hit(F.col("film_id"), F.col("t_start"), F.col("t_end"), F.col("acceptable"), tolerance)
    return asked.join(found, "id", "left").groupBy("id", "intent").agg(F.min(F.when(hit, F.col("rank"))).alias("first_rank"))


def first_hits_by_table(asked: DataFrame, found: DataFrame, answers: DataFrame, by: str = "id", tolerance: float = TOLERANCE) -> DataFrame:
    """The same for answers in a table: asked: id, intent and ``by``, which names a query's set of answers; answers: ``by``, film_id, t_start, t_end, and
    unit_id where a query (of that id) isn't its own answer. A set that many queries share is kept once, and only found rows, k a query, meet their film's answers."""
    near = found.join(asked.select("id", by), "id")
    own = answers.select(F.col(by).alias("_set"), F.col("film_id").alias("_film"), F.col("t_start").alias("_start"), F.col("t_end").alias("_end"), *([F.col("unit_id").alias("_unit")] if "unit_id" in answers.columns else []))
    inside = (F.col(by) == F.col("_set")) & (F.col("film_id") == F.col("_film")) & (F.col("t_start") >= F.col("_start") - tolerance) & (F.col("t_end") <= F.col("_end") + tolerance)
    hits = near.join(own, inside & (F.col("_unit") != F.col("id")) if "_unit" in own.columns else inside, "left_semi")
    return asked.select("id", "intent").join(hits.groupBy("id").agg(F.min("rank").alias("first_rank")), "id", "left")


def _metrics(k5: int, k10: int) -> list[Column]:
    rate = lambda k: F.try_divide(F.count_if(F.col("first_rank") <= k), F.count("*"))
    return [F.count("*").alias("evaluated"), rate(k5).alias("hit@5"), rate(k10).alias("hit@10"), F.avg(F.coalesce(F.try_divide(F.lit(1.0), F.col("first_rank")), F.lit(0.0))).alias("mrr")]


def metrics(gold: DataFrame, found: DataFrame, k5: int = 5, k10: int = 10, tolerance: float = TOLERANCE) -> DataFrame:
    """One row: evaluated, skipped, hit@5, hit@10 (null without evaluated queries), mrr over the full lists. The names stay with other k."""
    skipped = gold.agg(F.count_if(is_placeholder(F.col("acceptable"))).alias("skipped"))
    return metrics_of(first_hits(gold, found, tolerance), skipped, k5, k10)


def metrics_of(first: DataFrame, skipped: DataFrame, k5: int = 5, k10: int = 10) -> DataFrame:
    """The metrics of first hits; skipped has one row."""
    return first.agg(*_metrics(k5, k10)).join(F.broadcast(skipped)).select("evaluated", "skipped", "hit@5", "hit@10", "mrr")


def by_intent(gold: DataFrame, found: DataFrame, k5: int = 5, k10: int = 10, tolerance: float = TOLERANCE) -> DataFrame:
    """The metrics for each intent, and with a null intent over all."""
    return by_intent_of(first_hits(gold, found, tolerance), k5, k10)


def by_intent_of(first: DataFrame, k5: int = 5, k10: int = 10) -> DataFrame:
    return first.rollup("intent").agg(F.grouping("intent").alias("is_total"), *_metrics(k5, k10))


def compare(runs: DataFrame, base: str, other: str, metric: str = "hit@5") -> DataFrame:
    """runs(config, intent, metric columns) to base, other and delta for each intent."""
    wide = runs.groupBy("intent").pivot("config", [base, other]).agg(F.first(metric))
    return wide.select("intent", F.col(f"`{base}`").alias("base"), F.col(f"`{other}`").alias("other"), (F.col(f"`{other}`") - F.col(f"`{base}`")).alias("delta"))


#: The probability that a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON = tuple(round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 9) for k in range(9))


def bootstrap(paired: DataFrame, resamples: int = 200, level: float = 0.95) -> DataFrame:
    """paired(id, intent, base, other), one row a query, to intent, queries, delta, low, high: the mean difference with its paired-bootstrap interval, for each intent and, with a
    null intent, over all.

    In resample b a query counts a Poisson number of times, which is fixed by a hash of its id and b; so all resamples are one aggregation, base and other are
    always drawn together, and a repetition gives the same interval. Resamples without queries are left out.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("b").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight = reduce(lambda total, p: total + F.when(u >= p, 1).otherwise(0), POISSON, F.lit(0))
    both = paired.select("id", "base", "other", F.explode(F.array_distinct(F.array("intent", F.lit(None).cast("string")))).alias("intent"))
    whole = both.groupBy("intent").agg(F.count("*").alias("queries"), F.avg(F.col("other") - F.col("base")).alias("delta"))
    drawn = both.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight)
    means = drawn.groupBy("intent", "b").agg((F.sum(F.col("w") * (F.col("other") - F.col("base"))) / F.nullif(F.sum("w"), F.lit(0))).alias("m")).where("m is not null")
    spread = means.groupBy("intent").agg(F.sort_array(F.collect_list("m")).alias("m"))  # at most ``resamples`` numbers
    tail = (1 - level) / 2
    at = lambda q: F.element_at("m", F.greatest(F.lit(1), F.ceil(F.size("m") * q - 1e-9)).cast("int"))
    ends = spread.select(F.col("intent").alias("i"), at(tail).alias("low"), at(1 - tail).alias("high"))
    return whole.join(ends, F.col("intent").eqNullSafe(F.col("i")), "left").select("intent", "queries", "delta", "low", "high")
