"""The ingest plan: films to units, stage by stage, with a ledger of the films that each stage has done.

A stage's rows lie below the digest of the settings that it uses, and its ledger names each film (by content) with the run that made its rows. A run makes the films that
the ledger lacks and adds them, so one new film among many computes one film; rows of a run that failed aren't in the ledger and are made again. Everything is a plan over all
those films at once; nothing loops over shots.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.config import Config
from shotloom.functions import paths as P
from shotloom.operators import annotate, dialogue, media, pooling, shots
from shotloom.plans import models
from shotloom.schemas import CUT, UNITS, conform
from shotloom.sources import films as film_source
from shotloom.sources import subtitles
from shotloom.sources.store import Store


@dataclass
class Stages:
    """The pluggable parts. ``detector`` gets films and gives cuts; the others are described in ``plans.models`` and ``sources``."""

    detector: Callable[[DataFrame], DataFrame]
    hasher: Callable[[str], str] = film_source.content_hash
    prober: Callable[[str], str] = film_source.run_probe
    extractor: Callable[[str], str] = subtitles.extract
    recogniser: Callable[[str], list] | None = None
    captioner: Callable[[list[str], list[str]], str] = models.caption_stub
    image_encoder: models.Encoder | None = None
    text_encoder: models.Encoder | None = None
    encode_media: Callable[[list[str]], None] | None = None


@dataclass
class Ingest:
    spark: SparkSession
    config: Config
    stages: Stages
    timings: list[tuple[str, float, bool, int]] = field(default_factory=list)

    def _ledger(self, path: str) -> DataFrame:
        """film_id and the first run that the ledger has for it."""
        try:
            rows = self.spark.read.schema("film_id string, run string").parquet(f"{path}/ledger")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], "film_id string, run string")
        return rows.groupBy("film_id").agg(F.min("run").alias("run"))

    def _kept(self, name: str, digest: str, films: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stage's rows of the films. ``make`` gets those that the ledger lacks; its rows have a film_id."""
        path = f"{self.config.paths.assets_dir}/stages/{name}/{digest}"
        began = time.time()
        lacking = films.join(self._ledger(path).select("film_id"), "film_id", "left_anti").persist()
        n = lacking.count()
        if n:
            run = f"r{uuid.uuid4().hex}"
            make(lacking).write.parquet(f"{path}/rows/run={run}")
            lacking.select("film_id", F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/ledger")
        lacking.unpersist()
        mine = films.select("film_id").join(self._ledger(path), "film_id").persist()
        runs = [r["run"] for r in mine.select("run").distinct().collect()]
        if runs:
            rows = self.spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/run={r}" for r in runs))
            rows = rows.join(mine, ["film_id", "run"], "left_semi").drop("run")
        else:
            rows = make(films).limit(0)
        self.timings.append((name, time.time() - began, n == 0, n))
        return rows

    def run(self, files: DataFrame, store: Store) -> DataFrame:
        """files(path) to units in the store; the films' earlier units are replaced. Returns the films."""
        c, s = self.config, self.stages
        dim = models.dimension(c.models.visual_encoder)
        probed = film_source.probe_files(files, s.hasher, s.prober)
        films = film_source.describe(probed, c.paths.assets_dir).dropDuplicates(["film_id"]).persist()
        whisper = hashlib.sha256(c.models.whisper.encode()).hexdigest()[:8]
        lines = self._kept("dialogue", whisper, films, lambda new: subtitles.lines(new, s.extractor, s.recogniser))
        t = c.thresholds
        cut = lambda new: shots.from_cuts(conform(s.detector(new), CUT), new, t.flash_min_duration, t.subsegment_min_duration, t.keyframe_short_shot_s)
        found = self._kept("shots", c.digest("thresholds"), films, cut)
        placed = found.join(films.select("film_id", "asset_dir", "path"), "film_id")
        placed = placed.withColumn("keyframe_paths", P.keyframe_paths(F.col("asset_dir"), F.col("shot_id"), pooling.require_frames(F.col("keyframe_times"))))
        if s.encode_media is not None:
            plan = media.keyframe_plan(placed).join(films.select("film_id", "asset_dir", "path"), "film_id")
            media.run_commands(media.commands(plan, "path", F.col("asset_dir")), s.encode_media)

        def vectors(new: DataFrame) -> DataFrame:
            frames = placed.join(new.select("film_id"), "film_id", "left_semi").select("film_id", "shot_id", F.posexplode("keyframe_paths").alias("i", "frame"))
            return pooling.shot_vector(models.embed(frames, s.image_encoder or models.path_hash(dim), dim, "frame", "vec"), "film_id", "shot_id")

        def captions(new: DataFrame) -> DataFrame:
            called = annotate.parse(annotate.call(said.join(new.select("film_id"), "film_id", "left_semi"), s.captioner))
            return called.select("film_id", "shot_id", "caption", "mood", "searchable_text", "annotation_error")

        images = self._kept("images", c.digest("thresholds", "models"), films, vectors)
        said = dialogue.overlap(placed, lines)
        notes = self._kept("annotations", c.digest("thresholds", "models"), films, captions)
        rows = said.join(images, ["film_id", "shot_id"]).join(notes, ["film_id", "shot_id"])
        rows = models.embed(rows, s.text_encoder or models.bag_of_words(dim), dim, "searchable_text", "txt_vec")
        units = rows.withColumns({"unit_id": F.col("shot_id"), "is_representative": F.lit(True)})
        store.create()
        store.films.upsert(films)
        began = time.time()
        store.units.replace(conform(units, UNITS), "film_id")
        self.timings.append(("units", time.time() - began, False, films.count()))
        return films

    def stage_log(self) -> DataFrame:
        """stage, seconds, cached (nothing was made), films (made)."""
        return self.spark.createDataFrame(self.timings, "stage string, seconds double, cached boolean, films long")
