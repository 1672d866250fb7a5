"""Media plans: keyframe seeks, preview clips and playback bounds as rows; an encoder runs them outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of padding after a cut, and of a preview at most; a clip's padding.
PAD = 0.1
PREVIEW = 4.0
CLIP_PAD = 0.25


def keyframe_plan(shots: DataFrame) -> DataFrame:
    """A row for each keyframe: shot_id, n, t and the seek time, padded for the first one."""
    frames = shots.select("film_id", "shot_id", "t_start", F.posexplode("keyframe_times").alias("n", "t"))
    seek = F.when(F.col("n") == 0, F.greatest(F.col("t"), F.col("t_start") + PAD)).otherwise(F.col("t"))
    return frames.select("film_id", "shot_id", "n", "t", seek.alias("seek"))


def preview_bounds(start: Column, end: Column) -> dict[str, Column]:
    """seek and dur of a preview of at most PREVIEW seconds around the middle."""
    d = end - start
    clip = F.least(F.lit(PREVIEW), d)
    seek = F.greatest(start, start + d / 2 - clip / 2)
    return {"preview_seek": seek, "preview_dur": F.least(clip, end - seek)}


def clip_bounds(start: Column, end: Column, duration: Column, pad: float = CLIP_PAD) -> Column:
    """A shot's clip, padded on both sides and kept inside the film."""
    return F.struct(F.greatest(F.lit(0.0), start - pad).alias("start"), F.least(duration, end + pad).alias("end"))


def inward_bounds(start: Column, end: Column, fps: Column, frames: int = 3) -> Column:
    """A shot without its first and last frames; its middle where nothing would be left."""
    cut = frames / fps
    middle = (start + end) / 2
    return F.struct(F.least(start + cut, middle).alias("start"), F.greatest(end - cut, middle).alias("end"))


def play_position(start: Column) -> Column:
    return F.greatest(F.lit(0.0), start - 1)


def commands(plan: DataFrame, source: str, asset_dir: Column) -> DataFrame:
    """Encoder argument lists for a keyframe plan: seek before the input, one frame, scaled to 1280 wide."""
    out = F.concat(asset_dir, F.lit("/keyframes/"), F.col("shot_id"), F.lit("_"), F.col("n").cast("string"), F.lit(".webp"))
    args = F.array(F.lit("ffmpeg"), F.lit("-ss"), F.format_string("%.6f", "seek"), F.lit("-i"), F.col(source), F.lit("-frames:v"), F.lit("1"), F.lit("-vf"), F.lit("scale=1280:-1"), F.lit("-y"), out)
    return plan.withColumn("command", args)


def run_commands(planned: DataFrame, runner) -> None:
    """Run each row's command where its partition is; ``runner`` gets the argument list."""

    def each(rows) -> None:
        for row in rows:
            runner(list(row["command"]))

    planned.select("command").foreachPartition(each)
