"""Annotation: captioner output to caption, moods and searchable text; failures are rows, not exceptions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.functions import paths as P
from shotloom.functions import text as X
from shotloom.schemas import ONTOLOGY

IMAGES = 3
PROMPT = "Describe this film shot in two or three sentences: setting, people, action, light, colour and camera. Then add one line 'Mood:' with three to five keywords, separated by commas."


def requests(shots: DataFrame) -> DataFrame:
    """What a captioner gets for each shot: the first images, their media types, and the prompt."""
    images = F.slice("keyframe_paths", 1, IMAGES)
    return shots.withColumns({"images": images, "media_types": F.transform(images, lambda p: P.media_type(p)), "prompt": F.lit(PROMPT)})


def call(shots: DataFrame, captioner: Callable[[list[str], list[str]], str]) -> DataFrame:
    """Adds raw (null on failure) and annotation_error; the captioner gets image paths and dialogue of one shot."""
    schema = "shot_id string, raw string, annotation_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, error = [], []
            for images, dialogue in zip(pdf["keyframe_paths"], pdf["dialogue"], strict=True):
                try:
                    raw.append(captioner(list(images if images is not None else [])[:IMAGES], list(dialogue if dialogue is not None else [])))
                    error.append(None)
                except Exception as e:  # an outside model may fail in any way; the row records it
                    raw.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"shot_id": pdf["shot_id"], "raw": raw, "annotation_error": error})

    said = shots.select("shot_id", "keyframe_paths", "dialogue").mapInPandas(run, schema)
    return shots.join(said, "shot_id", "left")


def parse(called: DataFrame) -> DataFrame:
    """caption, mood and searchable_text from raw and dialogue; a failed call leaves all three empty."""
    found = called.withColumn("parsed", X.caption_and_mood(F.col("raw")))
    text = F.when(F.col("raw").isNull(), F.lit("")).otherwise(X.searchable(F.col("parsed.caption"), F.col("dialogue")))
    return found.withColumns({"caption": F.col("parsed.caption"), "mood": F.col("parsed.mood"), "searchable_text": text}).drop("parsed")


def parse_structured(called: DataFrame, raw: str = "raw") -> DataFrame:
    """The structured form: JSON by the ontology, null fields where it doesn't parse."""
    return called.withColumn("annotation", F.from_json(raw, ONTOLOGY, {"mode": "PERMISSIVE"}))


def inherit_scene(shots: DataFrame, scenes: DataFrame) -> DataFrame:
    """Shots with their scene's narrative."""
    return shots.join(scenes.select("scene_id", F.col("narrative").alias("scene_narrative")), "scene_id", "left")
