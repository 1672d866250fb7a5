"""Interval join by sweeping: pairs of open intervals of one key that overlap, for keys of any size.

A key's time is cut into parts at boundaries chosen from counts of starts, so that no part has many more rows than ``rows`` (only equal starts stay together). Each interval
goes to the parts that it meets. In a part, starts and ends are passed once in order; an interval that starts meets those that are open. So a part's
work follows its rows and pairs, and a long key is shared among tasks without all its left rows meeting all its right ones. A pair is met where the later of both starts lies, so once.

``totals`` sweeps for numbers and sums alone: no pairs are made, so its work follows the rows however many pairs there are.

Intervals meet where left.start < right.end and right.start < left.end. One that ends where or before it starts thus meets those that reach around it. Rows with null keys,
starts or ends meet none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ROWS = 50_000
#: Steps of the counts from which boundaries are chosen.
STEPS = 1024


def _ranges(times: DataFrame, key: str, at: str, rows: int) -> DataFrame:
    """(key, low, high, n) of the keys of more than so many rows and one time."""
    return times.groupBy(key).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n")).where((F.col("n") > rows) & (F.col("low") < F.col("high")))


def _step(at: Column) -> Column:
    return F.least(F.floor((at - F.col("low")) / (F.col("high") - F.col("low")) * STEPS), F.lit(STEPS - 1))


def boundaries(starts: DataFrame, key: str, start: str, rows: int = ROWS) -> DataFrame:
    """(key, cuts): sorted times, none for keys of few rows. starts has a row an interval."""
    range_ = _ranges(starts, key, start, rows)
    counts = starts.join(range_, key).groupBy(key, _step(F.col(start)).alias("step")).agg(F.count("*").alias("n"), F.min(start).alias("at"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("step")) - F.col("n")  # at most STEPS rows a key
    turn = counts.withColumn("turn", F.floor(before / rows)).groupBy(key, "turn").agg(F.min("at").alias("at")).where("turn > 0")
    return turn.groupBy(key).agg(F.sort_array(F.collect_set("at")).alias("cuts"))


def pairs(left: DataFrame, right: DataFrame, key: str = "film_id", rows: int = ROWS) -> DataFrame:
    """(key, left, right): structs of the further columns of left(key, start, end, ...) and right, for the pairs that overlap."""
    whole = {}
    for name, df in (("left", left), ("right", right)):
        rest = [c for c in df.columns if c not in (key, "start", "end")]
        whole[name] = df.where(" and ".join(f"`{c}` is not null" for c in (key, "start", "end"))).select(key, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.struct(*rest).alias(name))
    cuts = boundaries(whole["left"].select(key, "start").unionByName(whole["right"].select(key, "start")), key, "start", rows)
    parts = []
    for name, other in (("left", "right"), ("right", "left")):
        df = whole[name].join(cuts, key, "left")
        first = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("start"))), F.lit(0))
        last = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("end"))), F.lit(0))
        low = F.when(F.col("part") > 0, F.element_at("cuts", F.col("part"))).otherwise(F.lit(float("-inf")))
        empty = F.lit(None).cast(whole[other].schema[other].dataType)
        df = df.withColumn("part", F.explode(F.sequence(first, F.greatest(first, last)))).withColumn("low", low)
        parts.append(df.select(key, "part", "low", "start", "end", F.col(name), empty.alias(other)).select(key, "part", "low", "start", "end", "left", "right"))
    both = parts[0].unionByName(parts[1])
    schema = StructType([both.schema[key], *(StructField(n, both.schema[n].dataType) for n in ("left", "right"))])

    def sweep(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("left").is_valid().to_numpy()
        a, b = meeting(table.column("start").to_numpy(), table.column("end").to_numpy(), side, table.column("low")[0].as_py())
        return pa.table({key: table.column(key).take(a), "left": table.column("left").take(a), "right": table.column("right").take(b)})

    return both.groupBy(key, "part").applyInArrow(sweep, schema)


def meeting(start: np.ndarray, end: np.ndarray, left: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the left and right intervals of the pairs whose later start is ``low`` or after it."""
    proper = np.flatnonzero(start < end)
    at = np.concatenate([end[proper], start])
    kind = np.concatenate([np.zeros(len(proper), np.int8), np.where(start < end, 2, 1).astype(np.int8)])  # ends first, then intervals without extent
    which = np.concatenate([proper, np.arange(len(start))])
    order = np.lexsort((kind, at))
    open_: tuple[dict[int, None], dict[int, None]] = ({}, {})
    a: list[int] = []
    b: list[int] = []
    begins, ends, sides = start.tolist(), end.tolist(), left.tolist()
    for i, k, t in zip(which[order].tolist(), kind[order].tolist(), at[order].tolist(), strict=True):
        own = sides[i]
        if k == 0:
            open_[own].pop(i, None)
            continue
        others = open_[not own]
        if others and t >= low:
            met = list(others) if k == 2 else [j for j in others if begins[j] < ends[i]]
            (a if own else b).extend([i] * len(met))
            (b if own else a).extend(met)
        if k == 2:
            open_[own][i] = None
    return np.array(a, np.int64), np.array(b, np.int64)


def totals(left: DataFrame, right: DataFrame, id: str, value: str, key: str = "film_id", rows: int = ROWS) -> DataFrame:
    """(key, id, n, total): the number of pairs of each left id that has any, and the sum of their right rows' whole number ``value``.

    Of right intervals with an extent, a left one that doesn't end before it starts meets those that start before its end, without those that end up to its start (which start
    before its end too). Both numbers are running sums over a key's times in order, within parts of equal length of time and over parts. Other intervals go through ``pairs``.
    """
    there = " and ".join(f"`{c}` is not null" for c in (key, "start", "end"))
    left = left.where(there).select(key, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col(id).alias("id"))
    right = right.where(there).select(key, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col(value).alias("value"))
    back, flat = left.where("start > end"), right.where("start >= end")
    number = F.col("value").cast("decimal(38,0)")
    turn = lambda name, order: F.struct(F.col(name).alias("at"), F.lit(order).alias("turn"))
    asks = left.where("start <= end").select(key, F.explode(F.array(turn("start", 1), turn("end", 2))).alias("m"), "id", F.lit(None).cast("decimal(38,0)").alias("v"))
    gives = right.where("start < end").select(key, F.explode(F.array(turn("end", 0), turn("start", 3))).alias("m"), F.lit(None).cast(left.schema["id"].dataType).alias("id"), number.alias("v"))
    marks = asks.unionByName(gives).select(key, "m.at", "m.turn", "id", "v")  # at one time ends, what asks for ends, what asks for starts, starts
    cut = marks.join(_ranges(marks, key, "at", rows), key, "left").withColumn("step", F.coalesce(_step(F.col("at")), F.lit(0)))
    # what a row adds to the running numbers of ends and starts
    plus = {f"{of}_{k}": F.when(F.col("turn") == t, x).otherwise(F.lit(0)) for of, t in (("ends", 0), ("starts", 3)) for k, x in (("n", F.lit(1).cast("long")), ("known", F.col("v").isNotNull().cast("long")), ("sum", F.coalesce("v", F.lit(0).cast("decimal(38,0)"))))}
    cut = cut.select(key, "step", "at", "turn", "id", *(x.alias(c) for c, x in plus.items()))
    whole = cut.groupBy(key, "step").agg(*(F.sum(c).alias(c) for c in plus))
    earlier = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # at most STEPS rows a key
    whole = whole.select(key, "step", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in plus))
    order = Window.partitionBy(key, "step").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    run = cut.select(key, "step", "turn", "id", *(F.sum(c).over(order).alias(c) for c in plus)).where("turn in (1, 2)").join(whole, [key, "step"])
    met = lambda k: F.when(F.col("turn") == 2, F.col(f"starts_{k}") + F.col(f"before_starts_{k}")).otherwise(-F.col(f"ends_{k}") - F.col(f"before_ends_{k}"))
    found = run.groupBy(key, "id").agg(*(F.sum(met(k).cast("decimal(38,0)")).alias(k) for k in ("n", "known", "sum")))
    for some, others in ((back, right), (left.where("start <= end"), flat)):
        if not some.isEmpty() and not others.isEmpty():
            pair = pairs(some, others, key, rows).select(key, "left.id", F.col("right.value").alias("value"))
            more = pair.groupBy(key, "id").agg(F.count("*").cast("decimal(38,0)").alias("n"), F.count("value").cast("decimal(38,0)").alias("known"), F.coalesce(F.sum(number), F.lit(0)).alias("sum"))
            found = found.unionByName(more).groupBy(key, "id").agg(*(F.sum(k).alias(k) for k in ("n", "known", "sum")))
    return found.where("n > 0").select(key, F.col("id").alias(id), F.col("n").cast("long").alias("n"), F.when(F.col("known") > 0, F.col("sum").cast("long")).alias("total"))
