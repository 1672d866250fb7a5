"""Query routing: intent, filters and weights of a query; anything unreadable falls back to a flat hybrid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTENTS = ("vibe", "dialogue_quote", "plot_moment", "visual_specific", "hybrid")
SCHEMA = "intent string, film string, is_bw boolean, time_of_day string, camera_movement string, rewrites array<string>, img double, txt double, lex double"
DEFAULT = {"img": 0.4, "txt": 0.4, "lex": 0.2}


def by_rules(query: Column) -> Column:
    """The stand-in for a routing model: JSON by simple signs in the text."""
    q = F.lower(query)
    intent = (
        F.when(q.rlike(r"[\"“”]|\bsays?\b|\bquote|\bline\b"), "dialogue_quote")
        .when(q.rlike(r"\b(when|after|before|moment|finds?|discovers?|dies?|leaves?|arrives?)\b"), "plot_moment")
        .when(q.rlike(r"\b(close-?up|wide shot|black and white|neon|red|blue|green|yellow|window|mirror|car|rain|snow)\b"), "visual_specific")
        .when(q.rlike(r"\b(mood|feeling|lonely|loneliness|silence|quiet|whimsical|tense|vibe|empty|melanchol\w*)\b"), "vibe")
        .otherwise("hybrid")
    )
    night = F.when(q.rlike(r"\bnight\b"), "night").when(q.rlike(r"\b(dawn|morning)\b"), "dawn").when(q.rlike(r"\bday(light)?\b"), "day")
    move = F.when(q.rlike(r"\bpan(s|ning)?\b"), "pan").when(q.rlike(r"\b(tracking|dolly)\b"), "tracking").when(q.rlike(r"\bhandheld\b"), "handheld")
    bw = F.when(q.rlike(r"black and white|\bb&w\b"), F.lit(True))
    return F.to_json(F.struct(intent.alias("intent"), bw.alias("is_bw"), night.alias("time_of_day"), move.alias("camera_movement"), F.array(query).alias("rewrites")))


def parse(routed: DataFrame, raw: str = "route", query: str = "query") -> DataFrame:
    """Adds the route's fields; an unreadable or unknown intent is hybrid, missing weights are the defaults, missing rewrites the query."""
    route = F.from_json(raw, SCHEMA, {"mode": "PERMISSIVE"})
    rows = routed.withColumn("_r", route)
    fields = {
        "intent": F.when(F.col("_r.intent").isin(*INTENTS), F.col("_r.intent")).otherwise("hybrid"),
        "rewrites": F.coalesce(F.col("_r.rewrites"), F.array(F.col(query))),
        "filters": F.struct("_r.film", "_r.is_bw", "_r.time_of_day", "_r.camera_movement"),
        "weights": F.struct(*(F.coalesce(F.col(f"_r.{n}"), F.lit(w)).alias(n) for n, w in DEFAULT.items())),
    }
    return rows.withColumns(fields).drop("_r")
