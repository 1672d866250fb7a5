"""Shots: cuts to seconds, flash merge, equal split, ids, keyframes. Everything is a projection or one window by film."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_runs(frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """film_id, frame, p to cuts (film_id, pos, start_frame, end_frame): a frame with p over the threshold ends its shot."""
    order = Window.partitionBy("film_id").orderBy("frame")
    cut = F.coalesce(F.lag("p").over(order) > threshold, F.lit(True))
    grouped = frames.withColumn("cut", cut).withColumn("pos", F.sum(F.col("cut").cast("int")).over(order) - 1)
    return grouped.groupBy("film_id", F.col("pos").cast("int").alias("pos")).agg(F.min("frame").cast("int").alias("start_frame"), F.max("frame").cast("int").alias("end_frame"))


def frame_to_time(cuts: DataFrame, fps: Column, duration: Column) -> DataFrame:
    """Frames (the end inclusive) to seconds, clipped to the duration; empty shots go."""
    timed = cuts.withColumns({"t_start": F.col("start_frame") / fps, "t_end": F.least((F.col("end_frame") + 1) / fps, duration)})
    return timed.where("t_end > t_start")


def flash_merge(shots: DataFrame, shortest: float = 0.5) -> DataFrame:
    """film_id, pos, t_start, t_end: a shot shorter than ``shortest`` joins the kept one before it, which then ends where the last such shot does.

    The first shot of a film is always kept. Own durations count, not merged ones.
    """
    order = Window.partitionBy("film_id").orderBy("pos")
    head = (F.row_number().over(order) == 1) | (F.col("t_end") - F.col("t_start") >= shortest)
    grouped = shots.withColumn("head", head.cast("int")).withColumn("run", F.sum("head").over(order))
    merged = grouped.groupBy("film_id", "run").agg(F.min_by("t_start", "pos").alias("t_start"), F.max_by("t_end", "pos").alias("t_end"))
    return merged.select("film_id", (F.col("run") - 1).cast("int").alias("pos"), "t_start", "t_end")


def keyframe_times(start: Column, end: Column, short: float = 2.0) -> Column:
    """The middle of a shot below ``short`` seconds, else its quarters."""
    d = end - start
    return F.when(d < short, F.array(start + d / 2)).otherwise(F.array(start + d * 0.25, start + d * 0.5, start + d * 0.75))


def segment(shots: DataFrame, longest: float = 20.0, short: float = 2.0) -> DataFrame:
    """Ids, equal split of long shots, keyframes.

    A shot over ``longest`` becomes ceil(d / longest) equal parts; its own id is used up as their parent but not emitted. Ids
    count base shots and parts in one sequence.
    """
    d = F.col("t_end") - F.col("t_start")
    n = F.when(d > longest, F.ceil(d / longest)).otherwise(F.lit(0)).cast("int")
    order = Window.partitionBy("film_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    slotted = shots.withColumn("n", n).withColumn("slot", F.coalesce(F.sum(F.lit(1) + F.col("n")).over(order), F.lit(0)))
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))))
    cut = slotted.withColumn("part", part).withColumn("step", F.col("t_end") - F.col("t_start")).withColumn("step", F.col("step") / F.greatest(F.col("n"), F.lit(1)))
    split = F.col("n") > 0
    start = F.when(split, F.col("t_start") + F.col("part") * F.col("step")).otherwise(F.col("t_start"))
    end = F.when(split & (F.col("part") < F.col("n") - 1), F.col("t_start") + (F.col("part") + 1) * F.col("step")).otherwise(F.col("t_end"))
    name = lambda k: F.format_string("%s_%04d", F.col("film_id").cast("string"), k.cast("int"))
    return cut.select(
        "film_id",
        F.when(split, name(F.col("slot") + 1 + F.col("part"))).otherwise(name(F.col("slot"))).alias("shot_id"),
        start.alias("t_start"),
        end.alias("t_end"),
        F.when(split, name(F.col("slot"))).alias("parent_shot_id"),
    ).withColumn("keyframe_times", keyframe_times(F.col("t_start"), F.col("t_end"), short))


def from_cuts(cuts: DataFrame, films: DataFrame, flash: float = 0.5, longest: float = 20.0, short: float = 2.0) -> DataFrame:
    """Cuts and films to shots."""
    timed = frame_to_time(cuts.join(films.select("film_id", "fps", "duration"), "film_id"), F.col("fps"), F.col("duration"))
    return segment(flash_merge(timed.select("film_id", "pos", "t_start", "t_end"), flash), longest, short)


def split_by_content(seconds: DataFrame, cut: float = 0.35) -> DataFrame:
    """shot_id, second, vec to parts (shot_id, part, t_start, t_end): split where neighbouring vectors are farther apart than ``cut``."""
    from shotloom.functions.vectors import cosine

    order = Window.partitionBy("shot_id").orderBy("second")
    far = F.coalesce((1 - cosine(F.col("vec"), F.lag("vec").over(order))) > cut, F.lit(False))
    marked = seconds.withColumn("far", far.cast("int")).withColumn("part", F.sum("far").over(order))
    return marked.groupBy("shot_id", F.col("part").cast("int").alias("part")).agg(F.min("second").alias("t_start"), (F.max("second") + 1).alias("t_end"))


def flash_merge_by_content(shots: DataFrame, gap: float = 1.0, like: float = 0.9) -> DataFrame:
    """film_id, pos, t_start, t_end, vec: a shot joins the one before it if it starts less than ``gap`` after that began to end and looks like it."""
    from shotloom.functions.vectors import cosine

    order = Window.partitionBy("film_id").orderBy("pos")
    near = (F.col("t_start") - F.lag("t_end").over(order) < gap) & (cosine(F.col("vec"), F.lag("vec").over(order)) > like)
    grouped = shots.withColumn("head", (~F.coalesce(near, F.lit(False))).cast("int")).withColumn("run", F.sum("head").over(order))
    return grouped.groupBy("film_id", (F.col("run") - 1).cast("int").alias("pos")).agg(F.min_by("t_start", "pos").alias("t_start"), F.max_by("t_end", "pos").alias("t_end"))
