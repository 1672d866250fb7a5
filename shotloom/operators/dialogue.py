"""Dialogue: subtitle text to lines, and the interval join of lines to shots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.functions import text as X
from shotloom.operators import intervals


def parse_srt(subtitles: DataFrame, text: str = "srt") -> DataFrame:
    """film_id and SRT text to lines (film_id, pos, start, end, text) in the text's order.

    A block without a time line is skipped, as are blocks without text. Tags go, then references are decoded, then lines join by spaces.
    """
    blocks = subtitles.select("film_id", F.posexplode(F.split(X.strip(F.regexp_replace(F.col(text), r"\r\n?", "\n")), r"\n\s*\n")).alias("block", "body"))
    own = blocks.withColumn("rows", F.transform(X.lines(X.strip(F.col("body"))), X.strip))
    at = F.array_position(F.transform("rows", lambda r: r.rlike(X.TIME_LINE)), True).cast("int")
    timed = own.withColumn("at", at).where("at > 0").withColumn("line", F.element_at("rows", F.col("at")))
    said = F.filter(F.slice("rows", F.col("at") + 1, F.greatest(F.size("rows") - F.col("at"), F.lit(0))), lambda r: r != "")
    done = timed.select(
        "film_id",
        "block",
        X.srt_seconds(F.regexp_extract("line", X.TIME_LINE, 1)).alias("start"),
        X.srt_seconds(F.regexp_extract("line", X.TIME_LINE, 2)).alias("end"),
        X.strip(F.array_join(F.transform(said, X.strip_tags), " ")).alias("text"),
    )
    return done.where("text <> ''").select("film_id", F.col("block").alias("pos"), "start", "end", "text")


def to_srt(lines: DataFrame) -> DataFrame:
    """Lines to one SRT text a film."""
    stamp = lambda s: F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s % 3600 / 60), F.floor(s % 60), F.round((s - F.floor(s)) * 1000).cast("long"))
    block = F.concat((F.col("pos") + 1).cast("string"), F.lit("\n"), stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end")), F.lit("\n"), F.col("text"))
    return lines.withColumn("block", block).groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b")).select("film_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("srt"))


def overlap(shots: DataFrame, lines: DataFrame, bucket: float | None = None, rows: int | None = None) -> DataFrame:
    """Each shot with the texts of the lines that overlap it (both ends open), in the lines' order; shots without lines have none.

    The join always has the film as its equality. ``bucket`` (seconds) adds a time bucket for films with very many lines: a
    pair is then met in the bucket where the later of both starts lies, so once. With ``rows`` films are cut into parts of about so many rows, each of
    which is swept in order (see ``intervals``): for films of any length, without a width to choose.
    """
    if rows:
        met = intervals.pairs(
            shots.select("film_id", F.col("t_start").alias("start"), F.col("t_end").alias("end"), "shot_id"), lines.select("film_id", "start", "end", "pos", "text"), rows=rows
        ).select("film_id", "left.shot_id", "right.pos", "right.text")
        return _gathered(shots, met)
    said = lines.select("film_id", "pos", F.col("start").alias("l_start"), F.col("end").alias("l_end"), "text")
    meets = (F.col("l_start") < F.col("t_end")) & (F.col("l_end") > F.col("t_start"))
    keys = ["film_id"]
    left = shots.select("film_id", "shot_id", "t_start", "t_end")
    if bucket:
        spread = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(F.greatest(a, b) / bucket)))
        left = left.withColumn("slot", spread(F.col("t_start"), F.col("t_end")))
        said = said.withColumn("slot", spread(F.col("l_start"), F.col("l_end")))
        meets &= F.floor(F.greatest("l_start", "t_start") / bucket) == F.col("slot")
        keys.append("slot")
    return _gathered(shots, left.join(said, keys).where(meets))


def _gathered(shots: DataFrame, met: DataFrame) -> DataFrame:
    pairs = met.groupBy("film_id", "shot_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("found"))
    found = pairs.select("film_id", "shot_id", F.transform("found", lambda x: x["text"]).alias("dialogue"))
    return shots.join(found, ["film_id", "shot_id"], "left").withColumn("dialogue", F.coalesce("dialogue", F.array().cast("array<string>")))


def overlap_text(shots: DataFrame, lines: DataFrame) -> DataFrame:
    """shot_id and the overlapping lines as one string, joined in order."""
    return overlap(shots, lines).select("film_id", "shot_id", F.array_join("dialogue", " ").alias("dialogue"))
