"""Gold queries from YAML."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from shotloom.schemas import GOLD


def read_gold(spark: SparkSession, path: str | Path) -> DataFrame:
    """id, query, intent, acceptable; an empty file has no rows, an absent list of answers is null."""
    import yaml

    rows = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    answer = lambda a: (str(a["film_id"]), float(a["t_start"]), float(a["t_end"]))
    return spark.createDataFrame([(r["id"], r["query"], r.get("intent"), None if r.get("acceptable") is None else [answer(a) for a in r["acceptable"]]) for r in rows], GOLD)
