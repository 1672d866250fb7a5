"""Scenes: grouping of neighbouring shots, clusters of takes, curation scores, motion features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions.vectors import cosine

#: Rows of a scene that are compared with the others at once.
BLOCK = 1024


def links(shots: DataFrame, similar: float = 0.75, gap: float = 2.5, sound: float = 0.9, apart: float = 0.2) -> DataFrame:
    """Adds ``linked``: the shot continues the one before it, by any of: looks, that is, the least similarity of a keyframe of one and a keyframe of the other (vecs, or one vec a
    shot); dialogue that goes on (speech_start, speech_end: first and last line); sound (audio_vec), where that is known.

    Where no dialogue goes on and the looks fall below ``apart``, that is a break whatever the sound.
    """
    order = Window.partitionBy("film_id").orderBy("pos")
    before = lambda c: F.lag(c).over(order)
    looks = F.lit(None).cast("double")
    if "vecs" in shots.columns:
        shots = shots.withColumn("_before", before("vecs"))
        looks = F.array_min(F.flatten(F.transform("vecs", lambda a: F.transform("_before", lambda b: cosine(a, b)))))
    elif "vec" in shots.columns:
        looks = cosine(F.col("vec"), before("vec"))
    talks = before("speech_end").isNotNull() & (F.col("speech_start") - before("speech_end") < gap) if "speech_start" in shots.columns else F.lit(None)
    sounds = cosine(F.col("audio_vec"), before("audio_vec")) > sound if "audio_vec" in shots.columns else F.lit(None)
    talks, alike = F.coalesce(talks, F.lit(False)), F.coalesce(looks > similar, F.lit(False))
    cut = ~talks & F.coalesce(looks < apart, F.lit(False))
    return shots.withColumn("linked", (alike | talks | F.coalesce(sounds, F.lit(False))) & ~cut).drop("_before")


def group_uncapped(linked: DataFrame) -> DataFrame:
    """scene_no by film: a running count of shots that continue nothing."""
    order = Window.partitionBy("film_id").orderBy("pos")
    starts = (~F.col("linked")).cast("int")
    return linked.withColumn("scene_no", (F.sum(starts).over(order) - F.first(starts).over(order)).cast("int"))


def group(linked: DataFrame, longest: float = 300.0) -> DataFrame:
    """film_id, pos, scene_no: a scene also ends where the next shot would take it over ``longest`` seconds.

    The cap makes this a fold over shots in order. Shots are first cut into the runs that the cap leaves out of account, and each run is folded by itself
    into the places where its scenes start; so no film is one array, and the fold lists scenes, not shots.
    """
    runs = group_uncapped(linked).select("film_id", F.col("pos").cast("int").alias("pos"), "t_start", "t_end", F.col("scene_no").alias("run"))
    folded = runs.groupBy("film_id", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "t_start", "t_end"))).alias("s"))

    def step(acc, x):
        goes_on = x["t_end"] - acc["since"] <= longest
        since = F.when(goes_on, acc["since"]).otherwise(x["t_start"].cast("double"))
        return F.struct(since.alias("since"), F.when(goes_on, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(x["pos"]))).alias("starts"))

    none = F.struct(F.lit(None).cast("double").alias("since"), F.array().cast("array<int>").alias("starts"))
    starts = folded.select("film_id", F.explode(F.aggregate("s", none, step, lambda a: a["starts"])).alias("pos"), F.lit(1).alias("start"))
    order = Window.partitionBy("film_id").orderBy("pos")
    marked = runs.select("film_id", "pos").join(starts, ["film_id", "pos"], "left")
    return marked.select("film_id", "pos", (F.sum(F.coalesce("start", F.lit(0))).over(order) - 1).cast("int").alias("scene_no"))


def cluster(shots: DataFrame, distance: float = 0.12, id: str = "unit_id", vector: str = "vec") -> DataFrame:
    """Takes within a scene: single linkage at a cosine distance. Adds cluster_id (the least id) and is_representative (the longest, ties by id).

    A scene's shots are compared in one task, in blocks of ``BLOCK`` rows, so its memory grows with the shots and not with their pairs; its time
    grows with the pairs, which ``group``'s cap on the duration bounds.
    """
    kind = dict(shots.dtypes)[id]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id).reset_index(drop=True)
        x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        n = np.linalg.norm(x, axis=1)
        x = x / np.where(n > 0, n, 1)[:, None]
        label, real = np.arange(len(x)), n > 0
        for at in range(0, len(x), BLOCK):
            end = min(at + BLOCK, len(x))
            near = (np.round(1 - x[at:end] @ x[:end].T, 6) <= distance) & real[at:end, None] & real[None, :end]
            for row in near:
                joined = np.unique(label[:end][row])
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
        longest = (pdf["t_end"] - pdf["t_start"]).to_numpy()
        best = pd.DataFrame({"c": label, "d": -longest, "i": np.arange(len(x))}).sort_values(["c", "d", "i"]).drop_duplicates("c")["i"].to_numpy()
        return pd.DataFrame({"film_id": pdf["film_id"], "scene_id": pdf["scene_id"], id: pdf[id], "cluster_id": pdf[id].to_numpy()[label], "is_representative": np.isin(np.arange(len(x)), best)})

    types = dict(shots.dtypes)
    schema = f"film_id {types['film_id']}, scene_id {types['scene_id']}, {id} {kind}, cluster_id {kind}, is_representative boolean"
    return shots.select("film_id", "scene_id", id, vector, "t_start", "t_end").groupBy("film_id", "scene_id").applyInPandas(run, schema)


def other_takes(clustered: DataFrame, id: str = "unit_id") -> DataFrame:
    """Pairs (id, other) of a cluster: each representative with its further takes."""
    head = clustered.where("is_representative").select("film_id", "scene_id", "cluster_id", F.col(id).alias("representative"))
    rest = clustered.where("not is_representative").select("film_id", "scene_id", "cluster_id", F.col(id).alias("other"))
    return head.join(rest, ["film_id", "scene_id", "cluster_id"]).select("representative", "other", "cluster_id")


def scores(shots: DataFrame, **measures: str) -> DataFrame:
    """Adds ``<name>_score`` in [0, 1] for each measure: min-max within the film, 0 where all are equal."""
    film = Window.partitionBy("film_id")
    low = lambda c: F.min(c).over(film)
    return shots.withColumns({f"{n}_score": F.coalesce(F.try_divide(F.col(c) - low(c), F.max(c).over(film) - low(c)), F.lit(0.0)) for n, c in measures.items()})


def motion(flows: DataFrame, bins: int = 8) -> DataFrame:
    """shot_id, frame, dx, dy (mean optical flow of a block) to motion features of a shot: mean length, direction histogram, global share, shakiness."""
    turn = F.floor((F.atan2("dy", "dx") + math.pi) / (2 * math.pi) * bins)
    named = flows.select("shot_id", "frame", "dx", "dy", F.hypot("dx", "dy").alias("length"), F.pmod(turn, F.lit(bins)).cast("int").alias("direction"))
    frames = named.groupBy("shot_id", "frame").agg(F.avg("dx").alias("gx"), F.avg("dy").alias("gy"), F.avg("length").alias("mean"), *(F.count_if(F.col("direction") == k).alias(f"d{k}") for k in range(bins)))
    order = Window.partitionBy("shot_id").orderBy("frame")
    jerk = F.hypot(F.col("gx") - F.lag("gx").over(order), F.col("gy") - F.lag("gy").over(order))
    return frames.withColumn("jerk", jerk).groupBy("shot_id").agg(
        F.avg("mean").alias("flow_mean"),
        F.array(*(F.sum(f"d{k}") for k in range(bins))).alias("direction_histogram"),
        F.try_divide(F.avg(F.hypot("gx", "gy")), F.avg("mean")).alias("global_ratio"),
        F.coalesce(F.avg("jerk"), F.lit(0.0)).alias("shakiness"),
    )
