"""Hybrid search: dense text, dense image and lexical channels, fused, weighted by the curation prior, and diversified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.config import Diversity, Weights
from shotloom.operators import fusion, lexical, search


def hybrid(units: DataFrame, queries: DataFrame, weights: Weights = Weights(0.4, 0.4, 0.2), prior: Column | None = None, depth: int = fusion.DEPTH) -> DataFrame:
    """queries(query_id, query, query_vec) against units: query_id, unit_id, score, rank.

    The prior, an expression over units, multiplies the fused score; it never filters.
    """
    text = search.top_k_batch(units, queries, depth, "txt_vec")
    image = search.top_k_batch(units, queries, depth, "img_vec")
    words = lexical.bm25(units.withColumn("_t", F.concat_ws(" ", "caption", "searchable_text")), queries, depth, id="unit_id", text="_t")
    fused = fusion.fuse({"img": image, "txt": text, "lex": words}, {"img": weights.img, "txt": weights.txt, "lex": weights.lex})
    if prior is not None:
        fused = fused.join(units.select("unit_id", prior.alias("prior")), "unit_id").withColumn("score", F.col("score") * F.col("prior")).drop("prior")
    return fusion.ranked(fused.withColumn("score", F.round("score", 9)))


def diversified(units: DataFrame, found: DataFrame, diversity: Diversity = Diversity(2, 4), k: int = 30) -> DataFrame:
    """The ranked units with film and scene, at most so many of each."""
    return fusion.diversify(found.join(units.select("unit_id", "film_id", "scene_id"), "unit_id"), diversity.max_per_scene, diversity.max_per_film, k)
