"""Text expressions: white space, tags and references, subtitle times, labels, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character references that are decoded without Python, the ampersand last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: An SRT time and the line that holds two of them.
TIME = r"(\d{2}):(\d{2}):(\d{2}),(\d{3})"
TIME_LINE = r"^(\d{2}:\d{2}:\d{2},\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2},\d{3})"
TAG = r"<[^>]+>"


def strip(x: Column) -> Column:
    """Without white space at both ends, by Unicode's definition."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def unescape(x: Column) -> Column:
    for name, value in REFERENCES:
        x = F.replace(x, F.lit(name), F.lit(value))
    return x


def strip_tags(x: Column) -> Column:
    """Tags removed, then references decoded, then stripped; an escaped tag survives as text."""
    return strip(unescape(F.regexp_replace(x, TAG, "")))


def srt_seconds(x: Column) -> Column:
    """HH:MM:SS,mmm in seconds; null for another form."""
    h, m, s, ms = (F.regexp_extract(x, f"^{TIME}$", k) for k in range(1, 5))
    whole = h.try_cast("int") * 3600 + m.try_cast("int") * 60 + s.try_cast("int")
    return whole.cast("double") + ms.try_cast("int") / F.lit(1000.0)


def lines(x: Column) -> Column:
    return F.split(x, r"\R")


def tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def time_label(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def elapsed_label(seconds: Column) -> Column:
    """Xm Ys, or Ys below a minute; negative times are 0."""
    whole = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    m, s = F.floor(whole / 60), whole % 60
    return F.when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def film_label(film_id: Column) -> Column:
    """Hyphens and underscores as spaces, the first letter of each word in capitals, the rest as it is."""
    parts = F.split(F.regexp_replace(film_id, "[-_]", " "), " ")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def caption_and_mood(raw: Column) -> Column:
    """struct(caption, mood) of a captioner's text: the last line that starts with 'Mood:' lists moods, the other lines are the caption."""
    body = F.filter(F.transform(lines(strip(F.coalesce(raw, F.lit("")))), strip), lambda x: x != "")
    moods = F.filter(body, lambda x: x.startswith("Mood:"))
    last = F.coalesce(F.try_element_at(moods, F.lit(-1)), F.lit("Mood:"))
    listed = F.filter(F.transform(F.split(F.substring(last, 6, 1 << 20), ","), strip), lambda x: x != "")
    caption = F.array_join(F.filter(body, lambda x: ~x.startswith("Mood:")), " ")
    return F.struct(caption.alias("caption"), listed.alias("mood"))


def searchable(caption: Column, dialogue: Column) -> Column:
    return F.when(F.size(F.coalesce(dialogue, F.array().cast("array<string>"))) == 0, caption).otherwise(F.concat(caption, F.lit(" "), F.array_join(dialogue, " ")))
