"""The corpus pipeline: quality classifier, near-duplicate join, substring dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and reads again as
the next stage's documents. All but the last keep the columns of ``documents``. SQL cannot train the classifier, so ORACLE_SQL is None;
tests compare every stage with a brute-force version.

Defined results. Null texts: scored as empty ones; where the classifier keeps them they pass all stages and are packed as rows of 0 words. Null
ids: kept by every stage that doesn't score them away; they are never dropped as copies, and lose no words. Repeated rows (one id, one set of
shingles): one stays after near_duplicates; rows with one id and different texts are different documents. Ties: the least id of a group stays,
and of equal passages that in the least id. Empty tables give an empty result. Further columns, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.llm import ngram_join, packing, quality_mil, secret_scan, substring_dedup
from shotloom.llm._words import discard, read, settle, shared_folder


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier accepts."""
    return quality_mil.accept(docs, quality_mil.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the Jaccard join links."""
    return ngram_join.representatives(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that an earlier document has."""
    return _counted(substring_dedup.without_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return _counted(secret_scan.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces go: shard, bin, position and the bin's capacity."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secrets), ("packed", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``. A stage's table is deleted when the next one is written."""
    folder = shared_folder(spark)
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), folder, name, release=True)
        discard(spark, folder, *before)
        before = [name]
    return docs
