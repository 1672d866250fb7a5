"""Subtitle sources: SRT files, extraction, speech recognition as a fallback, and the JSON form of lines."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.functions import paths as P
from shotloom.functions.text import strip
from shotloom.operators.dialogue import parse_srt
from shotloom.sources.films import plain

LINES = "film_id string, pos int, start double, end double, text string"


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """film_id (the file's stem) and srt (its whole text)."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("srt"), plain(F.input_file_name()).alias("path"))
    return files.select(P.stem(F.col("path")).alias("film_id"), "srt")


def extract(path: str) -> str:
    """The first subtitle stream as SRT, by an external program."""
    return subprocess.run(["ffmpeg", "-v", "error", "-i", path, "-map", "0:s:0", "-f", "srt", "-"], check=True, capture_output=True, text=True).stdout


def lines(films: DataFrame, extractor: Callable[[str], str] = extract, recogniser: Callable[[str], list[tuple[float, float, str]]] | None = None) -> DataFrame:
    """Dialogue lines of films: embedded subtitles where there are any, else recognised speech (none without a recogniser)."""

    def srt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"film_id": pdf["film_id"], "srt": [extractor(p) for p in pdf["path"]]})

    def speech(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, float(a), float(e), t) for f, p in zip(pdf["film_id"], pdf["path"], strict=True) for a, e, t in (recogniser(p) if recogniser else [])]
            pos: dict = {}
            out = [(f, pos.setdefault(f, 0), a, e, t) for f, a, e, t in rows if not pos.update({f: pos.get(f, -1) + 1})]
            yield pd.DataFrame(out, columns=["film_id", "pos", "start", "end", "text"])

    own = films.select("film_id", "path", "has_embedded_subs")
    read = parse_srt(own.where("has_embedded_subs").mapInPandas(srt, "film_id string, srt string"))
    heard = own.where("not has_embedded_subs").mapInPandas(speech, LINES).withColumn("text", strip(F.col("text"))).where("text <> ''")
    return read.unionByName(heard)


def write_json(lines: DataFrame, path: str) -> None:
    """Lines as JSON, those of a film side by side in files of about one size; a folder a film would be as many files as there are films, or more."""
    lines.hint("rebalance", "film_id").sortWithinPartitions("film_id", "pos").write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINES).json(path)
