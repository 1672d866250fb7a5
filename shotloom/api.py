"""The engine: what the application's calls return, as DataFrames or plain values."""

from __future__ import annotations

import os
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.config import Config
from shotloom.functions import paths as P
from shotloom.operators import evaluation
from shotloom.operators import library as shelf
from shotloom.operators import search as dense
from shotloom.plans import models
from shotloom.plans.ingest import Ingest, Stages
from shotloom.schemas import JOB
from shotloom.sources import films as film_source
from shotloom.sources import ranges
from shotloom.sources.store import Store


class NotFound(LookupError):
    """No such row or file (status 404)."""


class Rejected(ValueError):
    """The request is not acceptable; ``status`` is 400 or 409."""

    def __init__(self, status: int, why: str) -> None:
        super().__init__(why)
        self.status = status


class Engine:
    def __init__(self, spark: SparkSession, config: Config, stages: Stages | None = None, text_encoder: models.Encoder | None = None, workers: int = 2) -> None:
        self.spark, self.config, self.stages = spark, config, stages
        self.store = Store(spark, f"{config.paths.assets_dir}/db")
        self.encode = text_encoder or models.bag_of_words(models.dimension(config.models.visual_encoder))
        self._jobs: dict[str, dict] = {}
        self._lock = threading.Lock()
        self._pool = ThreadPoolExecutor(workers)

    # search
    def search(self, query: str, k: int = dense.TOP, where: dict | None = None) -> DataFrame:
        """Up to k representative units, best first; a blank query finds nothing."""
        units = dense.filtered(self.store.units.read(), where)
        if not query.strip():
            return dense.results(dense.top_k(units.limit(0), [0.0], k))
        vector = models.normalized(self.encode([query.strip()]))[0]
        return dense.results(dense.top_k(units, vector.tolist(), k))

    def search_batch(self, queries: DataFrame, k: int = dense.TOP) -> DataFrame:
        """queries(id, query) to id, rank and the units' data, in one job."""
        dim = models.dimension(self.config.models.visual_encoder)
        embedded = models.embed(queries.select(F.col("id").alias("query_id"), "query"), self.encode, dim, "query", "query_vec")
        units = dense.filtered(self.store.units.read())
        found = dense.top_k_batch(units, embedded, k)
        return found.withColumnRenamed("query_id", "id").join(units.drop("img_vec", "txt_vec"), "unit_id")

    def more_like(self, unit_id: str, k: int = dense.TOP) -> DataFrame:
        return dense.results(dense.like_unit(dense.filtered(self.store.units.read()), unit_id, k))

    # lookup
    def unit(self, unit_id: str) -> dict:
        row = self.store.units.lookup(unit_id).first()
        if row is None:
            raise NotFound(unit_id)
        return row.asDict(recursive=True)

    def _film(self, film_id: str) -> dict:
        row = self.store.films.lookup(film_id).first()
        if row is None:
            raise NotFound(film_id)
        return row.asDict()

    def _asset(self, shot_id: str, kind: str, name: str) -> str:
        film = shot_id.rsplit("_", 1)[0]
        path = f"{self.config.paths.assets_dir}/{film}/{kind}/{name}"
        if not os.path.exists(path):
            raise NotFound(path)
        return path

    def keyframe(self, shot_id: str, n: int) -> tuple[str, str]:
        """Path and media type."""
        return self._asset(shot_id, "keyframes", f"{shot_id}_{n}.webp"), "image/webp"

    def preview(self, shot_id: str) -> tuple[str, str]:
        return self._asset(shot_id, "previews", f"{shot_id}.webm"), "video/webm"

    def video(self, film_id: str, header: str | None = None) -> dict:
        """A response's status, headers, media type and chunks."""
        path = self._film(film_id)["path"]
        if not os.path.exists(path):
            raise NotFound(path)
        out = ranges.response(path, os.path.getsize(path), header)
        kind = P.VIDEO_TYPES.get(Path(path).suffix.lower(), "application/octet-stream")
        return out | {"media_type": kind, "chunks": ranges.stream(path, out["first"], out["last"])}

    # library and jobs
    def library(self) -> DataFrame:
        return shelf.status(film_source.scan(self.spark, self.config.paths.films_dir), self.store.films.read())

    def ingest(self, path: str) -> dict:
        """Start a job for one film."""
        if self.stages is None:
            raise Rejected(400, "no ingest stages are set")
        real = str(Path(path).resolve())
        if not os.path.exists(real) or Path(real).suffix.lower() not in P.VIDEO:
            raise Rejected(400, "the path does not exist or is not a supported video file")
        with self._lock:
            if any(j["path"] == real and j["status"] == "running" for j in self._jobs.values()):
                raise Rejected(409, "this file is being ingested")
            job = {"job_id": uuid.uuid4().hex[:8], "path": real, "filename": Path(real).name, "status": "running", "started_at": time.time(), "finished_at": None, "error": None}
            self._jobs[job["job_id"]] = job

        def work() -> None:
            try:
                self.run([real])
                job["status"] = "done"
            except Exception as e:  # any failure of a job is its state
                job["error"], job["status"] = str(e), "error"
            job["finished_at"] = time.time()

        self._pool.submit(work)
        return {"job_id": job["job_id"], "status": "running"}

    def run(self, paths: list[str]) -> DataFrame:
        """Ingest films now; returns them."""
        files = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return Ingest(self.spark, self.config, self.stages).run(files, self.store)

    def jobs(self, now: float | None = None) -> DataFrame:
        """All jobs; those that finished long ago are forgotten."""
        now = time.time() if now is None else now
        with self._lock:
            self._jobs = {k: j for k, j in self._jobs.items() if j["status"] == "running" or j["finished_at"] is None or now - j["finished_at"] <= shelf.KEPT}
            rows = [tuple(j[f] for f in JOB.names) for j in self._jobs.values()]
        return self.spark.createDataFrame(rows, JOB)

    # evaluation
    def evaluate(self, gold: DataFrame, k5: int = 5, k10: int = 10) -> DataFrame:
        asked = gold.where(~evaluation.is_placeholder(F.col("acceptable")))
        return evaluation.metrics(gold, self.search_batch(asked.select("id", "query")), k5, k10)
