"""Schemas of the data model and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _struct(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


S, D, B, I, L = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType()
STRINGS = T.ArrayType(S)
DOUBLES = T.ArrayType(D)
VECTOR = T.ArrayType(T.FloatType())
SPAN = _struct(("film_id", S), ("t_start", D), ("t_end", D))

FILM = _struct(("film_id", S), ("path", S), ("asset_dir", S), ("duration", D), ("fps", D), ("has_embedded_subs", B), ("title", S))
FILMS_TABLE = _struct(("film_id", S), ("title", S), ("path", S), ("duration", D))
LINE = _struct(("film_id", S), ("pos", I), ("start", D), ("end", D), ("text", S))
CUT = _struct(("film_id", S), ("pos", I), ("start_frame", I), ("end_frame", I))
SHOT = _struct(("film_id", S), ("shot_id", S), ("t_start", D), ("t_end", D), ("parent_shot_id", S), ("keyframe_times", DOUBLES))
ANNOTATION = _struct(("caption", S), ("mood", STRINGS), ("searchable_text", S))
UNITS = _struct(
    ("unit_id", S), ("film_id", S), ("shot_id", S), ("t_start", D), ("t_end", D), ("is_representative", B), ("img_vec", VECTOR), ("txt_vec", VECTOR),
    ("caption", S), ("searchable_text", S), ("mood", STRINGS), ("dialogue", STRINGS), ("keyframe_paths", STRINGS),
)
RESULT = _struct(("unit_id", S), ("film_id", S), ("t_start", D), ("t_end", D), ("caption", S), ("keyframe_url", S), ("preview_url", S), ("distance", D), ("rank", I))
GOLD = _struct(("id", S), ("query", S), ("intent", S), ("acceptable", T.ArrayType(SPAN)))
METRICS = _struct(("evaluated", L), ("skipped", L), ("hit@5", D), ("hit@10", D))
LIBRARY = _struct(("filename", S), ("path", S), ("size_gb", D), ("status", S))
JOB = _struct(("job_id", S), ("path", S), ("filename", S), ("status", S), ("started_at", D), ("finished_at", D), ("error", S))
PROBE = _struct(
    ("streams", T.ArrayType(_struct(("codec_type", S), ("r_frame_rate", S), ("avg_frame_rate", S), ("duration", S)))),
    ("format", _struct(("duration", S), ("tags", T.MapType(S, S)))),
)
#: Annotation ontology of a shot: what a structured captioner returns.
ONTOLOGY = _struct(
    ("caption", S), ("mood", STRINGS), ("shot_size", S), ("camera_movement", S), ("time_of_day", S), ("setting", S), ("is_bw", B), ("colors", STRINGS), ("people", I), ("actions", STRINGS), ("objects", STRINGS), ("frame_worthiness", I),
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, cast; a missing column fails, others are dropped."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))


def of_dimension(vector: Column, dim: int) -> Column:
    """The vector; an error where its size differs from dim (Spark has no fixed-size list)."""
    return F.when(vector.isNull() | (F.size(vector) == dim), vector).otherwise(F.raise_error(F.concat(F.lit(f"vector size is not {dim}: "), F.size(vector).cast("string"))))


def with_json_lists(units: DataFrame) -> DataFrame:
    """The compatibility form: mood, dialogue and keyframe_paths as JSON text."""
    return units.withColumns({c: F.to_json(c) for c in ("mood", "dialogue", "keyframe_paths")})
