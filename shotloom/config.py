"""Configuration: frozen dataclasses on the driver, whose values reach plans as literals."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import typing
from dataclasses import dataclass
from pathlib import Path

#: Fixed value: the environment variable that names the file.
ENVIRONMENT = "CINEMA_CONFIG"


@dataclass(frozen=True)
class Paths:
    films_dir: str
    assets_dir: str


@dataclass(frozen=True)
class Models:
    visual_encoder: str
    text_encoder: str
    annotator: str
    router: str
    whisper: str = "large-v3"


@dataclass(frozen=True)
class Thresholds:
    shot_dedup_cosine: float
    scene_visual_sim: float
    scene_dialogue_gap: float
    scene_max_duration: int
    subsegment_min_duration: int
    flash_min_duration: float = 0.5
    keyframe_short_shot_s: float = 2.0


@dataclass(frozen=True)
class Weights:
    img: float
    txt: float
    lex: float


@dataclass(frozen=True)
class Diversity:
    max_per_scene: int
    max_per_film: int


@dataclass(frozen=True)
class Retrieval:
    weights: Weights
    diversity: Diversity
    rerank_enabled: bool


@dataclass(frozen=True)
class Scoring:
    duration_weight: float
    motion_weight: float
    frame_worthiness_weight: float


@dataclass(frozen=True)
class Config:
    paths: Paths
    models: Models
    thresholds: Thresholds
    retrieval: Retrieval
    scoring: Scoring

    def digest(self, *sections: str) -> str:
        """A key for cached stages: changes with any value of the named sections (all by default)."""
        values = dataclasses.asdict(self)
        return hashlib.sha256(json.dumps({k: values[k] for k in sections or values}, sort_keys=True).encode()).hexdigest()[:16]


def _build(kind: type, raw: dict, where: str = "config"):
    """The dataclass from nested mappings: each field without a default is mandatory, unknown keys are ignored."""
    hints = typing.get_type_hints(kind)
    values = {}
    for field in dataclasses.fields(kind):
        if field.name in raw:
            to = hints[field.name]
            values[field.name] = _build(to, raw[field.name], f"{where}.{field.name}") if dataclasses.is_dataclass(to) else to(raw[field.name])
        elif field.default is dataclasses.MISSING:
            raise KeyError(f"{where}.{field.name}")
    return kind(**values)


def load(path: str | Path | None = None) -> Config:
    """From the path, else the file that the environment names, else ./config.yaml."""
    import yaml

    chosen = Path(path or os.environ.get(ENVIRONMENT) or "config.yaml")
    if not chosen.exists():
        raise FileNotFoundError(f"no configuration at {chosen}")
    return _build(Config, yaml.safe_load(chosen.read_text(encoding="utf-8")))
