"""Library and jobs: which films are indexed, what is being ingested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.functions import paths as P

#: Fixed value: seconds that a finished job stays listed.
KEPT = 300


def status(files: DataFrame, films: DataFrame) -> DataFrame:
    """files(path, length) and films(path) to filename, path, size_gb and status, by lower-case name."""
    known = films.select("path").distinct().withColumn("known", F.lit(True))
    rows = files.where(P.is_video(F.col("path"))).join(known, "path", "left")
    named = rows.select(P.filename(F.col("path")).alias("filename"), "path", P.size_gb(F.col("length")).alias("size_gb"), F.when(F.col("known"), "indexed").otherwise("not_indexed").alias("status"))
    return named.orderBy(F.lower("filename"), "path")


def latest_jobs(jobs: DataFrame, order: str = "pos") -> DataFrame:
    """The last job of each path."""
    columns = [c for c in jobs.columns if c != "path"]
    return jobs.groupBy("path").agg(F.max_by(F.struct(*columns), order).alias("j")).select("path", "j.*")


def prune(jobs: DataFrame, now: float | Column, kept: float = KEPT) -> DataFrame:
    """Jobs without those that finished more than ``kept`` seconds ago."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    stale = F.col("status").isin("done", "error") & F.col("finished_at").isNotNull() & (now - F.col("finished_at") > kept)
    return jobs.where(~F.coalesce(stale, F.lit(False)))


def conflicts(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests whose path a running job has."""
    return requests.join(jobs.where("status = 'running'").select("path"), "path", "left_semi")


def display(library: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each file's shown state: running before error before indexed before not indexed."""
    last = latest_jobs(jobs).select("path", F.col("status").alias("job"))
    shown = F.when(F.col("job") == "running", "running").when(F.col("job") == "error", "error").otherwise(F.col("status"))
    return library.join(last, "path", "left").withColumn("shown", shown).drop("job")


def indexed_count(library: DataFrame, jobs: DataFrame) -> DataFrame:
    return display(library, jobs).agg(F.count_if((F.col("status") == "indexed") & (F.col("shown") != "running")).alias("indexed"))
