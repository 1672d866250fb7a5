"""Path, URL, type and byte-range expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Film suffixes and media types.
VIDEO = (".mkv", ".mp4", ".avi", ".mov", ".m4v", ".webm")
IMAGE_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif"}
VIDEO_TYPES = {".mp4": "video/mp4", ".m4v": "video/x-m4v", ".mkv": "video/x-matroska", ".webm": "video/webm", ".mov": "video/quicktime", ".avi": "video/x-msvideo"}


def suffix(path: Column) -> Column:
    """The lower-case suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])(\.[^./]+)$", 1))


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(filename(path), r"(?<=.)\.[^.]+$", "")


def is_video(path: Column) -> Column:
    return suffix(path).isin(*VIDEO)


def media_type(path: Column, types: dict[str, str] = IMAGE_TYPES, default: str = "image/jpeg") -> Column:
    table = F.create_map(*(F.lit(x) for kv in types.items() for x in kv))
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit(default))


def video_type(path: Column) -> Column:
    return media_type(path, VIDEO_TYPES, "application/octet-stream")


def size_gb(length: Column) -> Column:
    return F.bround(length / F.lit(1024.0**3), 1)


def keyframe_paths(asset_dir: Column, shot_id: Column, times: Column) -> Column:
    """One path for each keyframe time, numbered from 0."""
    return F.transform(times, lambda t, i: F.concat(asset_dir, F.lit("/keyframes/"), shot_id, F.lit("_"), i.cast("string"), F.lit(".webp")))


def keyframe_url(shot_id: Column) -> Column:
    return F.concat(F.lit("/media/keyframe/"), shot_id, F.lit("/0"))


def preview_url(shot_id: Column) -> Column:
    return F.concat(F.lit("/media/preview/"), shot_id)


def byte_range(header: Column, size: Column, strict: bool = False) -> Column:
    """struct(start, end) of a Range header, both inclusive; an unsatisfiable one is null, or an error with ``strict``."""
    text = F.trim(header)
    first = F.regexp_extract(text, r"^bytes=(\d*)-(\d*)$", 1)
    last = F.regexp_extract(text, r"^bytes=(\d*)-(\d*)$", 2)
    tail = (first == "") & (last != "")
    start = F.when(tail, F.greatest(size - last.try_cast("long"), F.lit(0))).otherwise(F.coalesce(first.try_cast("long"), F.lit(0)))
    end = F.when(tail | (last == ""), size - 1).otherwise(last.try_cast("long"))
    good = text.rlike(r"^bytes=(\d*)-(\d*)$") & (start <= end) & (start < size)
    bad = F.raise_error(F.concat(F.lit("416: "), header)) if strict else F.lit(None)
    return F.when(good, F.struct(start.cast("long").alias("start"), F.least(end, size - 1).cast("long").alias("end"))).otherwise(bad)


def chunk_spans(start: Column, end: Column, chunk: int = 1 << 20) -> Column:
    """The chunks of an inclusive byte range: array of struct(start, length)."""
    at = F.sequence(start, end, F.lit(chunk).cast("long"))
    return F.transform(at, lambda a: F.struct(a.alias("start"), F.least(F.lit(chunk).cast("long"), end - a + 1).alias("length")))
