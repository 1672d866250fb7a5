"""Models as plain callables, with deterministic stand-ins.

A stage takes any callable of the right form, so real encoders and captioners plug in without touching the plans. Stand-ins need no weights:
texts become hashed bags of words, images the hash of their path, captions a sentence from the file's name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.functions.text import tokens

#: Encoder names and their dimensions.
DIMENSIONS = {"pe_core_l14": 1024, "siglip2_so400m": 1152}
BATCH = 32

Encoder = Callable[[Sequence[str]], np.ndarray]
_loaded: dict[str, object] = {}


def dimension(name: str) -> int:
    if name not in DIMENSIONS:
        raise ValueError(f"unknown encoder: {name}")
    return DIMENSIONS[name]


def once(name: str, loader: Callable[[], object]) -> object:
    """One model a worker process, however many tasks it runs."""
    if name not in _loaded:
        _loaded[name] = loader()
    return _loaded[name]


def normalized(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def bag_of_words(dim: int) -> Encoder:
    """Counts of words by md5 bucket; what ``text_vector`` computes in the JVM."""
    import re

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for k, t in enumerate(texts):
            for w in re.split(r"[\W_]+", (t or "").lower()):
                if w:
                    out[k, int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % dim] += 1
        return out

    return encode


def path_hash(dim: int) -> Encoder:
    """A fixed random direction for each path."""

    def encode(paths: Sequence[str]) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.sha256(p.encode()).digest()[:8], "big") for p in paths]
        return np.stack([np.random.default_rng(s).normal(size=dim) for s in seeds]) if seeds else np.zeros((0, dim))

    return encode


def embed(rows: DataFrame, encoder: Encoder, dim: int, source: str, out: str, batch: int = BATCH) -> DataFrame:
    """Adds ``out``: the normalised vector of the ``source`` text or path, encoded in batches; checked against dim."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            found = []
            for k in range(0, len(s), batch):
                x = np.asarray(encoder(s.iloc[k : k + batch].fillna("").tolist()), np.float64)
                if x.shape[1] != dim:
                    raise ValueError(f"the encoder gave {x.shape[1]} dimensions, not {dim}")
                found.extend(normalized(x))
            yield pd.Series(found, index=s.index, dtype=object)

    return rows.withColumn(out, run(source))


def text_vector(text, dim: int = 64):
    """The bag-of-words stand-in as a column expression: token counts by md5 bucket (not normalised)."""
    bucket = lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("long") % dim).cast("int")
    slots = F.transform(tokens(F.coalesce(text, F.lit(""))), bucket)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))


def caption_stub(images: list[str], dialogue: list[str]) -> str:
    """A captioner without a model."""
    name = images[0].rsplit("/", 1)[-1] if images else "no image"
    return f"A shot shown in {name} with {len(dialogue)} lines of dialogue.\nMood: {'spoken, calm' if dialogue else 'silent, still'}"
