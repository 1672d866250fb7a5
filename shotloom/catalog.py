"""Named queries over the test tables, each with the DuckDB SQL that must give the same rows.

The tables play the parts of the data model: ``embeddings`` are unit vectors (film = vec_id % 20, scene = film * 10 + vec_id / 20 % 10),
``events`` of a user are a film's shot boundaries, ``conversations`` are dialogue, ``documents`` captions, ``benchmark`` query texts,
``labels`` curation scores, and customers and orders a library and its index.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.functions import paths as P
from shotloom.functions import text as X
from shotloom.functions import vectors as V
from shotloom.operators import annotate, boards, dialogue, evaluation, fusion, intervals, lexical, library, media, pooling, router, scenes, search, shots
from shotloom.plans import models
from shotloom.sources import films as film_source
from shotloom.sources.store import last_by_key, merge
from shotloom.streaming.incremental import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FLASH, LONG, SHORT = 3600.0, 21600.0, 7200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- the tables in their parts ---


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    film = (F.col("vec_id") % 20).cast("int")
    scene = film * 10 + (F.floor(F.col("vec_id") / 20) % 10).cast("int")
    start = (F.col("vec_id") * 10).cast("double")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("unit_id"), film.alias("film_id"), scene.alias("scene_id"), "label", F.col("embedding").alias("txt_vec"), start.alias("t_start"), (start + 5 + F.col("vec_id") % 7).alias("t_end")
    )


UNITS_SQL = """units AS (SELECT vec_id AS unit_id, (vec_id % 20)::INT AS film_id, ((vec_id % 20) * 10 + (vec_id // 20) % 10)::INT AS scene_id, label,
  embedding::DOUBLE[] AS v, (vec_id * 10)::DOUBLE AS t_start, (vec_id * 10)::DOUBLE + 5 + vec_id % 7 AS t_end FROM embeddings)"""


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of the searches: every vector whose id is divisible by 100, against all."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def raw_shots(spark: SparkSession, d: str) -> DataFrame:
    """film_id, pos, t_start, t_end in seconds: the spans between a user's consecutive events."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    ev = table(spark, d, "events").select("user_id", "event_id", "ts", at.alias("t_start"))
    ev = ev.withColumns({"t_end": F.lead("t_start").over(order), "pos": F.row_number().over(order)})
    return ev.where("t_end > t_start").select(F.col("user_id").alias("film_id"), "pos", "t_start", "t_end")


RAW_SQL = """ev AS (SELECT user_id, event_id, ts, epoch_us(ts) / 1e6::DOUBLE AS t_start FROM events),
 led AS (SELECT user_id AS film_id, t_start, lead(t_start) OVER w AS t_end, row_number() OVER w AS pos FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 raw AS (SELECT film_id, pos, t_start, t_end FROM led WHERE t_end > t_start)"""
MERGED_SQL = (
    RAW_SQL
    + f""", headed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY film_id ORDER BY pos) = 1 OR t_end - t_start >= {FLASH} THEN 1 ELSE 0 END AS head FROM raw),
 runs AS (SELECT *, sum(head) OVER (PARTITION BY film_id ORDER BY pos) AS run FROM headed),
 merged AS (SELECT film_id, (run - 1)::INT AS pos, arg_min(t_start, pos) AS t_start, arg_max(t_end, pos) AS t_end FROM runs GROUP BY film_id, run)"""
)
SEGMENTED_SQL = (
    MERGED_SQL
    + f""", cut AS (SELECT *, CASE WHEN t_end - t_start > {LONG} THEN ceil((t_end - t_start) / {LONG}) ELSE 0 END::INT AS n FROM merged),
 slotted AS (SELECT *, coalesce(sum(1 + n) OVER (PARTITION BY film_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS slot, (t_end - t_start) / greatest(n, 1) AS step FROM cut),
 parted AS (SELECT *, unnest(range(greatest(n, 1)))::INT AS part FROM slotted),
 shots AS (SELECT film_id, CASE WHEN n > 0 THEN printf('%s_%04d', film_id::VARCHAR, slot + 1 + part) ELSE printf('%s_%04d', film_id::VARCHAR, slot) END AS shot_id,
   CASE WHEN n > 0 THEN t_start + part * step ELSE t_start END AS t_start,
   CASE WHEN n > 0 AND part < n - 1 THEN t_start + (part + 1) * step ELSE t_end END AS t_end,
   CASE WHEN n > 0 THEN printf('%s_%04d', film_id::VARCHAR, slot) END AS parent_shot_id FROM parted)"""
)


def segmented(spark: SparkSession, d: str) -> DataFrame:
    return shots.segment(shots.flash_merge(raw_shots(spark, d), FLASH), LONG, SHORT)


def talk(spark: SparkSession, d: str) -> DataFrame:
    """film_id, pos, start, end, text: a conversation's turns, as long as their text over 16."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length(F.coalesce("text", F.lit(""))) / F.lit(16.0)
    c = table(spark, d, "conversations").withColumn("size", size)
    c = c.withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))
    return c.select(F.col("conv_id").alias("film_id"), F.col("turn").cast("int").alias("pos"), "start", "end", F.coalesce("text", F.lit("")).alias("text"))


TALK_SQL = """sized AS (SELECT *, length(coalesce(text, '')) / 16.0::DOUBLE AS size FROM conversations),
 talk AS (SELECT conv_id AS film_id, turn::INT AS pos, sum(size) OVER w - size AS "start", sum(size) OVER w AS "end", coalesce(text, '') AS text FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


def talk_shots(spark: SparkSession, d: str) -> DataFrame:
    """Shots of 20 seconds over each conversation."""
    films = talk(spark, d).groupBy("film_id").agg(F.max("end").alias("duration"))
    n = F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") / 20).cast("int")))
    rows = films.withColumn("n", n)
    return rows.select("film_id", F.format_string("%d_%04d", "film_id", "n").alias("shot_id"), (F.col("n") * F.lit(20.0)).alias("t_start"), (F.col("n") * F.lit(20.0) + 20).alias("t_end"))


TALK_SHOTS_SQL = (
    TALK_SQL
    + """, films AS (SELECT film_id, max("end") AS duration FROM talk GROUP BY film_id),
 grid AS (SELECT film_id, unnest(range(floor(duration / 20)::INT + 1)) AS n FROM films),
 shots AS (SELECT film_id, printf('%d_%04d', film_id, n) AS shot_id, n * 20.0::DOUBLE AS t_start, n * 20.0::DOUBLE + 20 AS t_end FROM grid),
 pairs AS (SELECT s.film_id, s.shot_id, l.pos, l.text FROM shots s JOIN talk l ON l.film_id = s.film_id AND l."start" < s.t_end AND l."end" > s.t_start)"""
)

# --- dense search ---

KNN_SQL = "WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id AS unit_id, round(1.0 - list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS distance FROM embeddings, q {where}) SELECT unit_id, distance, row_number() OVER (ORDER BY distance, unit_id)::INT AS rank FROM d ORDER BY distance, unit_id LIMIT 20"


@query(KNN_SQL.format(where=""))
def knn_top20(spark, d):
    vector = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]
    return search.top_k(unit_vectors(spark, d), vector).select("unit_id", "distance", "rank")


@query(KNN_SQL.format(where="WHERE vec_id <> 0"))
def more_like_this(spark, d):
    return search.like_unit(unit_vectors(spark, d), 0, vector="txt_vec").select("unit_id", "distance", "rank")


@query(KNN_SQL.format(where="WHERE label = 3"))
def filtered_search(spark, d):
    vector = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]
    return search.top_k(search.filtered(unit_vectors(spark, d), {"label": 3, "film_id": None}), vector).select("unit_id", "distance", "rank")


BATCH_SQL = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
 d AS (SELECT query_id, unit_id, round(1.0 - list_cosine_similarity(v, qv), 6) AS distance FROM units, q),
 found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, unit_id)::INT AS rank FROM d QUALIFY rank <= {k})"""


@query(f"WITH {UNITS_SQL}, {BATCH_SQL.format(k=10)} SELECT query_id, unit_id, distance, rank FROM found")
def knn_batch_k10(spark, d):
    return search.top_k_batch(unit_vectors(spark, d), queries_of(spark, d), 10)


@query(f"WITH {UNITS_SQL} SELECT unit_id, '/media/keyframe/' || unit_id || '/0' AS keyframe_url, '/media/preview/' || unit_id AS preview_url FROM units")
def media_urls(spark, d):
    name = F.col("unit_id").cast("string")
    return unit_vectors(spark, d).select("unit_id", P.keyframe_url(name).alias("keyframe_url"), P.preview_url(name).alias("preview_url"))


@query(f"WITH {UNITS_SQL}, x AS (SELECT unit_id, unnest(v) AS x, unnest(range(64)) AS i, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM units) SELECT unit_id, i::INT AS i, round((CASE WHEN n = 0 THEN x ELSE x / n END)::FLOAT::DOUBLE, 4) + 0.0::DOUBLE AS x FROM x")
def l2_normalize(spark, d):
    return unit_vectors(spark, d).select("unit_id", F.posexplode(V.l2_normalize(F.col("txt_vec"))).alias("i", "x")).select("unit_id", "i", (F.round(F.col("x").cast("double"), 4) + F.lit(0.0)).alias("x"))


@query(f"WITH {UNITS_SQL}, x AS (SELECT film_id, scene_id, unnest(v) AS x, unnest(range(64)) AS i FROM units) SELECT film_id, scene_id, i::INT AS i, count(*) AS n, round(avg(x), 6) AS mean FROM x GROUP BY film_id, scene_id, i")
def mean_vector_by_scene(spark, d):
    means = pooling.mean_vector(unit_vectors(spark, d), "film_id", "scene_id", vector="txt_vec")
    return means.select("film_id", "scene_id", "n", F.posexplode("mean").alias("i", "m")).select("film_id", "scene_id", "i", "n", F.round("m", 6).alias("mean"))


@query(
    """WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
 b AS (SELECT item_id, (('0x' || substr(md5(unnest(w)), 1, 7))::BIGINT % 64)::INT AS bucket FROM t)
 SELECT item_id, bucket, count(*) AS n FROM b GROUP BY item_id, bucket"""
)
def text_embedding_stub(spark, d):
    vec = table(spark, d, "benchmark").select("item_id", F.posexplode(models.text_vector(F.col("text"), 64)).alias("bucket", "n"))
    return vec.where("n > 0").select("item_id", "bucket", F.col("n").cast("long").alias("n"))


# --- shots ---


@query(f"WITH {MERGED_SQL} SELECT film_id, pos, t_start, t_end FROM merged")
def flash_merge(spark, d):
    return shots.flash_merge(raw_shots(spark, d), FLASH)


@query(
    f"""WITH {SEGMENTED_SQL} SELECT film_id, shot_id, t_start, t_end, parent_shot_id,
 CASE WHEN t_end - t_start < {SHORT} THEN 1 ELSE 3 END::INT AS n_keyframes,
 CASE WHEN t_end - t_start < {SHORT} THEN t_start + (t_end - t_start) / 2 ELSE t_start + (t_end - t_start) * 0.25::DOUBLE END AS first_keyframe FROM shots"""
)
def shot_subsegments(spark, d):
    return segmented(spark, d).select("film_id", "shot_id", "t_start", "t_end", "parent_shot_id", F.size("keyframe_times").alias("n_keyframes"), F.col("keyframe_times")[0].alias("first_keyframe"))


@query(
    """WITH c AS (SELECT user_id AS film_id, event_id, (event_id % 500)::INT AS start_frame, (event_id % 500 + event_id % 37 - 2)::INT AS end_frame FROM events),
 t AS (SELECT film_id, event_id, start_frame / 24.0::DOUBLE AS t_start, least((end_frame + 1) / 24.0::DOUBLE, 20.0::DOUBLE) AS t_end FROM c) SELECT * FROM t WHERE t_end > t_start"""
)
def frame_to_time(spark, d):
    start = (F.col("event_id") % 500).cast("int")
    cuts = table(spark, d, "events").select(F.col("user_id").alias("film_id"), "event_id", start.alias("start_frame"), (start + (F.col("event_id") % 37).cast("int") - 2).alias("end_frame"))
    return shots.frame_to_time(cuts, F.lit(24.0), F.lit(20.0)).select("film_id", "event_id", "t_start", "t_end")


@query(
    """WITH f AS (SELECT user_id AS film_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS p FROM events),
 c AS (SELECT *, coalesce((lag(p) OVER (PARTITION BY film_id ORDER BY frame) > 0.9)::INT, 1) AS cut FROM f),
 g AS (SELECT *, sum(cut) OVER (PARTITION BY film_id ORDER BY frame) - 1 AS pos FROM c)
 SELECT film_id, pos::INT AS pos, min(frame)::INT AS start_frame, max(frame)::INT AS end_frame FROM g GROUP BY film_id, pos"""
)
def cut_runs(spark, d):
    from pyspark.sql import Window

    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    frames = table(spark, d, "events").select(F.col("user_id").alias("film_id"), frame.alias("frame"), ((F.col("event_id") * 7919 % 1000) / F.lit(1000.0)).alias("p"))
    return shots.cut_runs(frames, 0.9)


@query(
    f"""WITH {SEGMENTED_SQL}, k AS (SELECT film_id, shot_id, t_start, t_end, CASE WHEN t_end - t_start < {SHORT} THEN [t_start + (t_end - t_start) / 2]
   ELSE [t_start + (t_end - t_start) * 0.25::DOUBLE, t_start + (t_end - t_start) * 0.5::DOUBLE, t_start + (t_end - t_start) * 0.75::DOUBLE] END AS ts FROM shots),
 e AS (SELECT film_id, shot_id, t_start, unnest(ts) AS t, unnest(range(len(ts)))::INT AS n FROM k)
 SELECT film_id, shot_id, n, t, CASE WHEN n = 0 THEN greatest(t, t_start + 0.1::DOUBLE) ELSE t END AS seek FROM e"""
)
def keyframe_plan(spark, d):
    return media.keyframe_plan(segmented(spark, d))


@query(
    f"""WITH {RAW_SQL}, b AS (SELECT film_id, pos, t_start, t_end, least(4.0::DOUBLE, t_end - t_start) AS clip FROM raw),
 s AS (SELECT *, greatest(t_start, t_start + (t_end - t_start) / 2 - clip / 2) AS preview_seek FROM b)
 SELECT film_id, pos, preview_seek, least(clip, t_end - preview_seek) AS preview_dur, greatest(0.0::DOUBLE, t_start - 0.25::DOUBLE) AS clip_start, greatest(0.0::DOUBLE, t_start - 1) AS play_at FROM s"""
)
def media_plan(spark, d):
    raw = raw_shots(spark, d).withColumns(media.preview_bounds(F.col("t_start"), F.col("t_end")))
    clip = media.clip_bounds(F.col("t_start"), F.col("t_end"), F.col("t_end"))
    return raw.select("film_id", "pos", "preview_seek", "preview_dur", clip["start"].alias("clip_start"), media.play_position(F.col("t_start")).alias("play_at"))


@query(
    f"""WITH {SEGMENTED_SQL} SELECT shot_id, '/assets/' || film_id || '/keyframes/' || shot_id || '_0.webp' AS first_path, CASE WHEN t_end - t_start < {SHORT} THEN 1 ELSE 3 END::INT AS n FROM shots"""
)
def keyframe_paths(spark, d):
    own = segmented(spark, d).withColumn("p", P.keyframe_paths(F.concat(F.lit("/assets/"), F.col("film_id").cast("string")), F.col("shot_id"), F.col("keyframe_times")))
    return own.select("shot_id", F.col("p")[0].alias("first_path"), F.size("p").alias("n"))


# --- dialogue and annotation ---


@query(f"WITH {TALK_SHOTS_SQL} SELECT s.film_id, s.shot_id, count(p.pos) AS n, coalesce(string_agg(p.text, ' ' ORDER BY p.pos), '') AS dialogue FROM shots s LEFT JOIN pairs p USING (film_id, shot_id) GROUP BY s.film_id, s.shot_id")
def dialogue_overlap(spark, d):
    joined = dialogue.overlap(talk_shots(spark, d), talk(spark, d))
    return joined.select("film_id", "shot_id", F.size("dialogue").cast("long").alias("n"), F.array_join("dialogue", " ").alias("dialogue"))


@query(
    """WITH p AS (SELECT *, percent_rank() OVER (ORDER BY ts) AS r, epoch_us(ts) / 1000000 AS s FROM events),
 a AS (SELECT user_id % 3 AS film_id, event_id, s AS "start", s + value AS "end" FROM p WHERE event_id % 2 = 0), b AS (SELECT user_id % 3 AS film_id, event_id, s AS "start", s + 600 AS "end" FROM p WHERE event_id % 2 = 1)
 SELECT a.film_id, a.event_id AS shot_id, count(b.event_id) AS n, sum(b.event_id)::BIGINT AS lines FROM a JOIN b ON a.film_id = b.film_id AND a."start" < b."end" AND b."start" < a."end" GROUP BY ALL"""
)
def interval_sweep(spark, d):
    """How many intervals of odd events each of the even ones overlaps, in three very long films, swept in parts."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    rows = table(spark, d, "events").select((F.col("user_id") % 3).alias("film_id"), "event_id", at.alias("start"), (at + F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(600.0)).alias("end"))
    met = intervals.totals(rows.where("event_id % 2 = 0").withColumnRenamed("event_id", "shot_id"), rows.where("event_id % 2 = 1"), "shot_id", "event_id", rows=2000)
    return met.withColumnRenamed("total", "lines")


@query(f"WITH {TALK_SHOTS_SQL} SELECT s.film_id, s.shot_id, count(p.pos) AS n, coalesce(string_agg(p.text, ' ' ORDER BY p.pos), '') AS dialogue FROM shots s LEFT JOIN pairs p USING (film_id, shot_id) GROUP BY s.film_id, s.shot_id")
def dialogue_sweep(spark, d):
    joined = dialogue.overlap(talk_shots(spark, d), talk(spark, d), rows=intervals.ROWS)
    return joined.select("film_id", "shot_id", F.size("dialogue").cast("long").alias("n"), F.array_join("dialogue", " ").alias("dialogue"))


@query(f"WITH {TALK_SHOTS_SQL} SELECT s.shot_id, CASE WHEN count(p.pos) = 0 THEN 'Shot ' || s.shot_id ELSE 'Shot ' || s.shot_id || ' ' || string_agg(p.text, ' ' ORDER BY p.pos) END AS searchable_text FROM shots s LEFT JOIN pairs p USING (film_id, shot_id) GROUP BY s.film_id, s.shot_id")
def searchable_text(spark, d):
    joined = dialogue.overlap(talk_shots(spark, d), talk(spark, d), bucket=60.0)
    return joined.select("shot_id", X.searchable(F.concat(F.lit("Shot "), F.col("shot_id")), F.col("dialogue")).alias("searchable_text"))


@query(
    f"""WITH {TALK_SQL} SELECT film_id, pos, floor("start" * 1000 + 0.5)::BIGINT AS start_ms, floor("end" * 1000 + 0.5)::BIGINT AS end_ms,
 trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM talk WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"""
)
def srt_parse(spark, d):
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5) / 1000
    lines = talk(spark, d).select("film_id", "pos", ms("start").alias("start"), ms("end").alias("end"), flat.alias("text")).where("text <> ''")
    parsed = dialogue.parse_srt(dialogue.to_srt(lines)).join(lines.select("film_id", "pos"), ["film_id", "pos"], "left_semi")
    return parsed.select("film_id", "pos", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), F.round(F.col("end") * 1000).cast("long").alias("end_ms"), "text")


@query(
    """WITH m AS (SELECT conv_id, turn, (conv_id * 7919 + turn * 104729) % 360000000 AS ms FROM conversations)
 SELECT conv_id, turn, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp,
 (ms // 3600000 * 3600 + ms // 60000 % 60 * 60 + ms // 1000 % 60)::DOUBLE + (ms % 1000) / 1000.0::DOUBLE AS seconds FROM m"""
)
def srt_timestamp(spark, d):
    ms = (F.col("conv_id") * 7919 + F.col("turn") * 104729) % 360000000
    part = lambda unit, top: F.floor(ms / unit) % top if top else F.floor(ms / unit)
    stamp = F.format_string("%02d:%02d:%02d,%03d", part(3600000, 0), part(60000, 60), part(1000, 60), ms % 1000)
    return table(spark, d, "conversations").select("conv_id", "turn", stamp.alias("stamp")).withColumn("seconds", X.srt_seconds(F.col("stamp")))


@query(
    """SELECT page_id, trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) AS text FROM pages"""
)
def strip_tags_unescape(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query(
    """WITH r AS (SELECT doc_id, text || chr(10) || 'Mood: ' || lang || ' ,  ' || source || ', ' AS raw FROM documents),
 l AS (SELECT doc_id, list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM r)
 SELECT doc_id, array_to_string(list_filter(ls, lambda x: x[1:5] <> 'Mood:'), ' ') AS caption,
 array_to_string(list_filter(list_transform(string_split(substr(list_filter(ls, lambda x: x[1:5] = 'Mood:')[-1], 6), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS mood FROM l"""
)
def caption_mood_parse(spark, d):
    raw = F.concat(F.col("text"), F.lit("\nMood: "), F.col("lang"), F.lit(" ,  "), F.col("source"), F.lit(", "))
    parsed = annotate.parse(table(spark, d, "documents").select("doc_id", raw.alias("raw"), F.array().cast("array<string>").alias("dialogue")))
    return parsed.select("doc_id", "caption", F.array_join("mood", "|").alias("mood"))


# --- lexical and hybrid search ---

QUERY_SQL = "qs AS (SELECT item_id * 100 AS query_id, text AS query FROM benchmark)"
BM25_SQL = (
    QUERY_SQL
    + """, toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
 total AS (SELECT count(*)::DOUBLE AS docs, avg(len(t)) AS mean FROM toks),
 terms AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM qs),
 occ AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM toks),
 hits AS (SELECT term, doc_id, n, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
 w AS (SELECT term, doc_id, ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / mean))) AS w FROM hits JOIN df USING (term), total),
 scored AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM terms JOIN w USING (term) GROUP BY query_id, doc_id),
 lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored)"""
)


def query_texts(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark items as query texts, numbered like the query vectors."""
    return table(spark, d, "benchmark").select((F.col("item_id") * 100).alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM lex WHERE rank <= 10")
def bm25_top10(spark, d):
    return lexical.bm25(table(spark, d, "documents"), query_texts(spark, d), 10)


def channels(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two ranked lists of units: dense for the query vectors, lexical for the query texts."""
    units, asked = unit_vectors(spark, d), queries_of(spark, d)
    dense = search.top_k_batch(units, asked, 50)
    lexical_ = lexical.bm25(table(spark, d, "documents").withColumnRenamed("doc_id", "unit_id"), query_texts(spark, d), 50, id="unit_id")
    return {"txt": dense, "lex": lexical_}


FUSED_SQL = f"""{UNITS_SQL}, {BATCH_SQL.format(k=50)}, {BM25_SQL},
 parts AS (SELECT query_id, unit_id, 0.2::DOUBLE / (60 + rank) AS lex, 0.0::DOUBLE AS txt FROM (SELECT query_id, doc_id AS unit_id, rank FROM lex WHERE rank <= 50)
  UNION ALL SELECT query_id, unit_id, 0.0::DOUBLE, 0.4::DOUBLE / (60 + rank) FROM found),
 fused AS (SELECT query_id, unit_id, max(lex) + max(txt) AS score FROM parts GROUP BY query_id, unit_id)"""


@query(f"WITH {FUSED_SQL} SELECT query_id, unit_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id)::INT AS rank FROM fused")
def rrf_fusion(spark, d):
    fused = fusion.fuse(channels(spark, d), {"txt": 0.4, "lex": 0.2})
    return fusion.ranked(fused.withColumn("score", F.round("score", 9)))


HYBRID_SQL = f"""WITH {FUSED_SQL}, p AS (SELECT query_id, unit_id, round(score * (1.0 + 0.05::DOUBLE * coalesce(quality, 0) + 0.10::DOUBLE * coalesce(1 - toxic, 0)), 9) AS score FROM fused LEFT JOIN labels ON doc_id = unit_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id)::INT AS rank FROM p)"""


@query(f"{HYBRID_SQL} SELECT query_id, unit_id, score, rank FROM r WHERE rank <= 30")
def hybrid_search(spark, d):
    fused = fusion.fuse(channels(spark, d), {"txt": 0.4, "lex": 0.2})
    curated = table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"), "quality", "toxic")
    weight = fusion.prior(quality=(0.05, F.col("quality").cast("double")), clean=(0.10, (1 - F.col("toxic")).cast("double")))
    scored = fused.join(curated, "unit_id", "left").withColumn("score", F.round(F.col("score") * weight, 9))
    return fusion.ranked(scored.select("query_id", "unit_id", "score"), k=30)


@query(
    f"""WITH {UNITS_SQL}, {BATCH_SQL.format(k=100)}, m AS (SELECT query_id, unit_id, film_id, scene_id, rank FROM found JOIN units USING (unit_id)),
 s AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, film_id, scene_id ORDER BY rank) <= 2),
 f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, film_id ORDER BY rank) <= 4)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS place FROM f QUALIFY place <= 30"""
)
def diversified_top30(spark, d):
    units = unit_vectors(spark, d)
    found = search.top_k_batch(units, queries_of(spark, d), 100).join(units.select("unit_id", "film_id", "scene_id"), "unit_id")
    return fusion.diversify(found.select("query_id", "unit_id", "film_id", "scene_id", "rank"))


@query(
    f"""WITH {UNITS_SQL}, {BATCH_SQL.format(k=30)}, s AS (SELECT query_id, unit_id, rank, (unit_id * 7 % 10 + 1)::INT AS rerank_score FROM found)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, unit_id)::INT AS new_rank FROM s"""
)
def rerank(spark, d):
    found = search.top_k_batch(unit_vectors(spark, d), queries_of(spark, d), 30).select("query_id", "unit_id", "rank")
    return fusion.rerank(found, (F.col("unit_id") * 7 % 10 + 1).cast("int"))


@query(
    """SELECT item_id, CASE WHEN regexp_matches(lower(text), '["“”]|\\bsays?\\b|\\bquote|\\bline\\b') THEN 'dialogue_quote'
  WHEN regexp_matches(lower(text), '\\b(when|after|before|moment|finds?|discovers?|dies?|leaves?|arrives?)\\b') THEN 'plot_moment'
  WHEN regexp_matches(lower(text), '\\b(close-?up|wide shot|black and white|neon|red|blue|green|yellow|window|mirror|car|rain|snow)\\b') THEN 'visual_specific'
  WHEN regexp_matches(lower(text), '\\b(mood|feeling|lonely|loneliness|silence|quiet|whimsical|tense|vibe|empty|melanchol\\w*)\\b') THEN 'vibe' ELSE 'hybrid' END AS intent,
 0.4::DOUBLE AS img FROM benchmark"""
)
def query_router(spark, d):
    routed = router.parse(table(spark, d, "benchmark").select("item_id", F.col("text").alias("query")).withColumn("route", router.by_rules(F.col("query"))))
    return routed.select("item_id", "intent", F.col("weights.img").alias("img"))


# --- evaluation ---

GOLD_SQL = """gold AS (SELECT vec_id AS id, CASE vec_id // 100 % 4 WHEN 0 THEN 'vibe' WHEN 1 THEN 'dialogue' WHEN 2 THEN 'visual' ELSE 'plot' END AS intent, label AS wanted, vec_id // 100 % 5 = 4 AS placeholder FROM embeddings WHERE vec_id % 100 = 0),
 answers AS (SELECT g.id, u.film_id, u.t_start, u.t_end FROM gold g JOIN units u ON u.label = g.wanted AND u.unit_id <> g.id WHERE NOT placeholder),
 ranked AS (SELECT query_id AS id, f.unit_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM found f WHERE f.unit_id <> query_id),
 firsts AS (SELECT g.id, g.intent, min(CASE WHEN a.id IS NOT NULL THEN r.rank END) AS first_rank FROM gold g LEFT JOIN ranked r ON r.id = g.id LEFT JOIN units u ON u.unit_id = r.unit_id
  LEFT JOIN answers a ON a.id = g.id AND a.film_id = u.film_id AND u.t_start >= a.t_start - 5 AND u.t_end <= a.t_end + 5 WHERE NOT g.placeholder GROUP BY g.id, g.intent)"""


def gold_set(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The query vectors, every fifth still a placeholder, and their first hits among the ranked results; answers are the units of the query's label."""
    from pyspark.sql import Window

    units = unit_vectors(spark, d)
    intents, nth = F.array(*map(F.lit, ("vibe", "dialogue", "visual", "plot"))), F.floor(F.col("unit_id") / 100)
    asked = units.where("unit_id % 100 = 0").select(F.col("unit_id").alias("id"), "label", intents[(nth % 4).cast("int")].alias("intent"), (nth % 5 == 4).alias("placeholder"))
    found = search.top_k_batch(units, queries_of(spark, d), 21).where("unit_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    placed = found.join(units.select("unit_id", "film_id", "t_start", "t_end"), "unit_id").select(F.col("query_id").alias("id"), "rank", "film_id", "t_start", "t_end")
    return asked, evaluation.first_hits_by_table(asked.where("not placeholder"), placed, units, "label")


EVAL_SQL = f"WITH {UNITS_SQL}, {BATCH_SQL.format(k=21)}, {GOLD_SQL}"
RATES = 'count(*) AS evaluated, round(count(*) FILTER (WHERE first_rank <= 5) / count(*)::DOUBLE, 9) AS "hit@5", round(count(*) FILTER (WHERE first_rank <= 10) / count(*)::DOUBLE, 9) AS "hit@10", round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 9) AS mrr'


@query(f"{EVAL_SQL} SELECT id, intent, first_rank::INT AS first_rank, coalesce(first_rank <= 5, false) AS hit5, coalesce(first_rank <= 10, false) AS hit10 FROM firsts")
def hit_at_k(spark, d):
    _, first = gold_set(spark, d)
    return first.select("id", "intent", "first_rank", F.coalesce(F.col("first_rank") <= 5, F.lit(False)).alias("hit5"), F.coalesce(F.col("first_rank") <= 10, F.lit(False)).alias("hit10"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(f"`{c}`", 9) for c in ("hit@5", "hit@10", "mrr")})


@query(f'{EVAL_SQL} SELECT evaluated, (SELECT count(*) FROM gold WHERE placeholder) AS skipped, "hit@5", "hit@10", mrr FROM (SELECT {RATES} FROM firsts)')
def eval_metrics(spark, d):
    asked, first = gold_set(spark, d)
    return _rounded(evaluation.metrics_of(first, asked.agg(F.count_if("placeholder").alias("skipped"))))


@query(f"{EVAL_SQL} SELECT intent, grouping(intent)::INT AS is_total, {RATES} FROM firsts GROUP BY ROLLUP (intent)")
def eval_rollup(spark, d):
    return _rounded(evaluation.by_intent_of(gold_set(spark, d)[1])).withColumn("is_total", F.col("is_total").cast("int"))


@query(f"{EVAL_SQL} SELECT intent, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 9) AS mrr FROM firsts GROUP BY intent")
def mrr_by_intent(spark, d):
    return _rounded(evaluation.by_intent_of(gold_set(spark, d)[1])).where("is_total = 0").select("intent", "mrr")


@query("SELECT vec_id AS id, vec_id % 5 IN (1, 4, 0) AS placeholder FROM embeddings")
def placeholder_skip(spark, d):
    """Gold queries of the units: answers that are all placeholders, of both kinds, real, none, or missing."""
    answer = lambda film: F.struct(film.alias("film_id"), F.col("t_start"), F.col("t_end"))
    fake, real = answer(F.lit(evaluation.PLACEHOLDER)), answer(F.col("film_id").cast("string"))
    kind, n = F.array().cast("array<struct<film_id:string,t_start:double,t_end:double>>"), F.col("unit_id") % 5
    some = F.when(n == 1, F.array(fake)).when(n == 2, F.array(fake, real)).when(n == 3, F.array(real)).when(n == 4, kind)
    return unit_vectors(spark, d).select(F.col("unit_id").alias("id"), evaluation.is_placeholder(some).alias("placeholder"))


@query(
    f"""{EVAL_SQL}, half AS (SELECT intent, avg((coalesce(first_rank, 99) <= 5)::INT) AS a, avg((coalesce(first_rank, 99) <= 10)::INT) AS b FROM firsts GROUP BY intent)
 SELECT intent, round(a, 9) AS base, round(b, 9) AS other, round(b - a, 9) AS delta FROM half"""
)
def eval_compare(spark, d):
    one = evaluation.by_intent_of(gold_set(spark, d)[1]).where("is_total = 0")
    runs = one.select(F.lit("k5").alias("config"), "intent", F.col("`hit@5`").alias("rate")).unionByName(one.select(F.lit("k10").alias("config"), "intent", F.col("`hit@10`").alias("rate")))
    return evaluation.compare(runs, "k5", "k10", "rate").select("intent", *(F.round(c, 9).alias(c) for c in ("base", "other", "delta")))


_LEVELS = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in evaluation.POISSON)


@query(
    f"""{EVAL_SQL}, pairs AS (SELECT id, intent, (coalesce(first_rank, 99) <= 5)::INT::DOUBLE AS base, (coalesce(first_rank, 99) <= 10)::INT::DOUBLE AS other FROM firsts),
 both_ AS (SELECT id, intent, base, other FROM pairs UNION ALL SELECT id, NULL, base, other FROM pairs),
 drawn AS (SELECT *, {_LEVELS} AS w FROM (SELECT *, ('0x' || substr(md5(id || ':' || b), 1, 8))::UBIGINT::DOUBLE / 4294967296 AS u FROM both_, (SELECT unnest(range(200)) AS b))),
 means AS (SELECT intent, b, sum(w * (other - base)) / nullif(sum(w), 0) AS m FROM drawn GROUP BY intent, b),
 ends AS (SELECT intent, list_sort(list(m)) AS m FROM means WHERE m IS NOT NULL GROUP BY intent),
 whole AS (SELECT intent, count(*) AS queries, avg(other - base) AS delta FROM both_ GROUP BY intent)
 SELECT w.intent, queries, round(delta, 9) AS delta, round(m[greatest(1, ceil(len(m) * 0.025 - 1e-9)::INT)], 9) AS low, round(m[greatest(1, ceil(len(m) * 0.975 - 1e-9)::INT)], 9) AS high FROM whole w LEFT JOIN ends e ON w.intent IS NOT DISTINCT FROM e.intent"""
)
def eval_bootstrap(spark, d):
    """hit@5 against hit@10, with the interval of the difference."""
    rank = F.coalesce("first_rank", F.lit(99))
    paired = gold_set(spark, d)[1].select("id", "intent", (rank <= 5).cast("int").cast("double").alias("base"), (rank <= 10).cast("int").cast("double").alias("other"))
    found = evaluation.bootstrap(paired)
    return found.select("intent", "queries", *(F.round(c, 9).alias(c) for c in ("delta", "low", "high")))


# --- scenes ---

GAP = 1800.0


@query(
    f"""WITH {MERGED_SQL}, l AS (SELECT *, coalesce(t_end - t_start < {LONG} AND t_start - lag(t_end) OVER w < {GAP}, false) AS linked FROM merged WINDOW w AS (PARTITION BY film_id ORDER BY pos))
 SELECT film_id, pos, (sum((NOT linked)::INT) OVER (PARTITION BY film_id ORDER BY pos) - 1)::INT AS scene_no FROM l"""
)
def scene_grouping(spark, d):
    return scenes.group_uncapped(linked_shots(spark, d)).select("film_id", "pos", "scene_no")


def linked_shots(spark: SparkSession, d: str) -> DataFrame:
    """A shot continues the one before if it starts soon after it and isn't long."""
    merged = shots.flash_merge(raw_shots(spark, d), FLASH)
    speech = merged.withColumns({"speech_start": F.when(F.col("t_end") - F.col("t_start") < LONG, F.col("t_start")), "speech_end": F.col("t_end")})
    return scenes.links(speech, gap=GAP)


@query(
    f"""WITH RECURSIVE {MERGED_SQL}, l AS (SELECT film_id, pos, t_start, t_end, coalesce(t_end - t_start < {LONG} AND t_start - lag(t_end) OVER w < {GAP}, false) AS linked FROM merged WINDOW w AS (PARTITION BY film_id ORDER BY pos)),
 fold AS (SELECT film_id, pos, 0 AS scene_no, t_start AS since FROM l WHERE pos = 0
  UNION ALL SELECT l.film_id, l.pos, CASE WHEN l.linked AND l.t_end - f.since <= 43200 THEN f.scene_no ELSE f.scene_no + 1 END, CASE WHEN l.linked AND l.t_end - f.since <= 43200 THEN f.since ELSE l.t_start END
  FROM fold f JOIN l ON l.film_id = f.film_id AND l.pos = f.pos + 1)
 SELECT film_id, pos, scene_no::INT AS scene_no FROM fold"""
)
def scene_grouping_capped(spark, d):
    return scenes.group(linked_shots(spark, d), longest=43200.0)


@query(
    """WITH v AS (SELECT (vec_id % 20)::INT AS film_id, (vec_id // 40)::INT AS pos, vec_id // 20 % 2 AS frame, label, embedding::DOUBLE[] AS v FROM embeddings),
 s AS (SELECT film_id, pos, list(v ORDER BY frame) AS vecs, max(label) AS label FROM v GROUP BY film_id, pos),
 n AS (SELECT *, lag(vecs) OVER w AS prev, lag(label) OVER w AS last FROM s WINDOW w AS (PARTITION BY film_id ORDER BY pos)),
 l AS (SELECT *, list_min(flatten(list_transform(vecs, lambda a: list_transform(prev, lambda b: list_cosine_similarity(a, b))))) AS looks, coalesce(pos * 10.0 + label - (pos * 10.0 - 10 + last + 5) < 5, false) AS talks FROM n),
 k AS (SELECT *, (coalesce(looks > -0.05, false) OR talks) AND NOT (NOT talks AND coalesce(looks < -0.3, false)) AS linked FROM l)
 SELECT film_id, pos, (sum((NOT linked)::INT) OVER (PARTITION BY film_id ORDER BY pos) - 1)::INT AS scene_no FROM k"""
)
def scene_grouping_keyframes(spark, d):
    """Scenes by the least similarity of neighbouring shots' keyframes and by dialogue that goes on."""
    pos = F.floor(F.col("vec_id") / 40).cast("int")
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 20).cast("int").alias("film_id"), pos.alias("pos"), (F.floor(F.col("vec_id") / 20) % 2).alias("frame"), "label", F.col("embedding").cast("array<double>").alias("v"))
    shot = rows.groupBy("film_id", "pos").agg(F.sort_array(F.collect_list(F.struct("frame", "v"))).alias("f"), F.max("label").alias("label"))  # two frames a shot
    said = shot.select("film_id", "pos", F.transform("f", lambda x: x["v"]).alias("vecs"), (F.col("pos") * 10.0 + F.col("label")).alias("speech_start"), (F.col("pos") * 10.0 + F.col("label") + 5).alias("speech_end"))
    return scenes.group_uncapped(scenes.links(said, similar=-0.05, gap=5.0, apart=-0.3)).select("film_id", "pos", "scene_no")


def takes(spark: SparkSession, d: str) -> DataFrame:
    units = unit_vectors(spark, d).withColumnRenamed("txt_vec", "vec")
    return scenes.cluster(units, distance=0.9)


TAKES_SQL = f"""WITH RECURSIVE {UNITS_SQL}, e AS (SELECT a.unit_id AS a, b.unit_id AS b FROM units a JOIN units b ON a.film_id = b.film_id AND a.scene_id = b.scene_id AND round(1.0 - list_cosine_similarity(a.v, b.v), 6) <= 0.9),
 reach AS (SELECT unit_id AS a, unit_id AS b FROM units UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
 c AS (SELECT a AS unit_id, min(b) AS cluster_id FROM reach GROUP BY a),
 k AS (SELECT film_id, scene_id, unit_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY t_end - t_start DESC, unit_id) = 1 AS is_representative FROM c JOIN units USING (unit_id))"""


@query(f"{TAKES_SQL} SELECT * FROM k")
def dedup_clusters(spark, d):
    return takes(spark, d)


@query(f"{TAKES_SQL} SELECT h.unit_id AS representative, o.unit_id AS other, h.cluster_id FROM k h JOIN k o USING (cluster_id) WHERE h.is_representative AND NOT o.is_representative")
def other_takes(spark, d):
    return scenes.other_takes(takes(spark, d))


@query(f"{TAKES_SQL} SELECT film_id, scene_id, unit_id FROM k WHERE is_representative")
def representatives(spark, d):
    return takes(spark, d).where("is_representative").select("film_id", "scene_id", "unit_id")


@query(
    f"""WITH {RAW_SQL}, m AS (SELECT film_id, pos, t_end - t_start AS d, min(t_end - t_start) OVER (PARTITION BY film_id) AS lo, max(t_end - t_start) OVER (PARTITION BY film_id) AS hi FROM raw)
 SELECT film_id, pos, round(CASE WHEN hi = lo THEN 0 ELSE (d - lo) / (hi - lo) END, 9) AS duration_score FROM m"""
)
def scores(spark, d):
    measured = raw_shots(spark, d).withColumn("d", F.col("t_end") - F.col("t_start"))
    return scenes.scores(measured, duration="d").select("film_id", "pos", F.round("duration_score", 9).alias("duration_score"))


@query("SELECT doc_id, round(1.0 + 0.05::DOUBLE * coalesce(quality, 0) + 0.10::DOUBLE * coalesce(1 - toxic, 0), 9) AS prior FROM labels")
def curation_prior(spark, d):
    weight = fusion.prior(quality=(0.05, F.col("quality").cast("double")), clean=(0.10, (1 - F.col("toxic")).cast("double")))
    return table(spark, d, "labels").select("doc_id", F.round(weight, 9).alias("prior"))


@query(
    """WITH v AS (SELECT vec_id AS second, vec_id % 20 AS shot_id, embedding::DOUBLE[] AS v FROM embeddings),
 f AS (SELECT *, coalesce((1 - list_cosine_similarity(v, lag(v) OVER (PARTITION BY shot_id ORDER BY second)) > 1.0)::INT, 0) AS far FROM v),
 p AS (SELECT *, sum(far) OVER (PARTITION BY shot_id ORDER BY second) AS part FROM f)
 SELECT shot_id, part::INT AS part, min(second) AS t_start, max(second) + 1 AS t_end FROM p GROUP BY shot_id, part"""
)
def content_subsegments(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 20).alias("shot_id"), F.col("vec_id").alias("second"), F.col("embedding").alias("vec"))
    return shots.split_by_content(rows, 1.0)


# --- library, jobs, tables ---

FILES_SQL = "files AS (SELECT '/films/' || c_name || CASE c_custkey % 4 WHEN 0 THEN '.MKV' WHEN 1 THEN '.mp4' WHEN 2 THEN '.txt' ELSE '.webm' END AS path, c_custkey * 7654321 AS length FROM customer), films AS (SELECT DISTINCT '/films/Customer#' || lpad(o_custkey::VARCHAR, 9, '0') || CASE o_custkey % 4 WHEN 0 THEN '.MKV' WHEN 1 THEN '.mp4' WHEN 2 THEN '.txt' ELSE '.webm' END AS path FROM orders WHERE o_orderstatus = 'F')"


def files_and_films(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    end = lambda k: F.when(F.col(k) % 4 == 0, ".MKV").when(F.col(k) % 4 == 1, ".mp4").when(F.col(k) % 4 == 2, ".txt").otherwise(".webm")
    files = table(spark, d, "customer").select(F.concat(F.lit("/films/"), F.col("c_name"), end("c_custkey")).alias("path"), (F.col("c_custkey") * 7654321).alias("length"))
    films = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("/films/Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), end("o_custkey")).alias("path"))
    return files, films


@query(f"WITH {FILES_SQL} SELECT split_part(f.path, '/', 3) AS filename, f.path, round_even(length / 1073741824.0::DOUBLE, 1) AS size_gb, CASE WHEN films.path IS NULL THEN 'not_indexed' ELSE 'indexed' END AS status FROM files f LEFT JOIN films USING (path) WHERE NOT ends_with(f.path, '.txt')")
def library_status(spark, d):
    return library.status(*files_and_films(spark, d))


JOBS_SQL = "jobs AS (SELECT event_id AS pos, '/films/' || user_id AS path, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'done' ELSE 'error' END AS status, (event_id * 10)::DOUBLE AS finished_at FROM events)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "done").otherwise("error")
    return table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("/films/"), F.col("user_id").cast("string")).alias("path"), state.alias("status"), (F.col("event_id") * 10).cast("double").alias("finished_at"))


@query(f"WITH {JOBS_SQL} SELECT path, arg_max(pos, pos) AS pos, arg_max(status, pos) AS status FROM jobs GROUP BY path")
def latest_job(spark, d):
    return library.latest_jobs(jobs(spark, d)).select("path", "pos", "status")


@query(f"WITH {JOBS_SQL} SELECT pos, path, status FROM jobs WHERE NOT (status IN ('done', 'error') AND 5000 - finished_at > 300)")
def job_prune(spark, d):
    return library.prune(jobs(spark, d), 5000.0).select("pos", "path", "status")


@query(f"WITH {JOBS_SQL} SELECT DISTINCT path FROM jobs j WHERE EXISTS (SELECT 1 FROM jobs k WHERE k.path = j.path AND k.status = 'running')")
def job_conflicts(spark, d):
    own = jobs(spark, d)
    return library.conflicts(own.select("path").distinct(), own)


@query(
    f"""WITH {JOBS_SQL}, last AS (SELECT path, arg_max(status, pos) AS job FROM jobs GROUP BY path), lib AS (SELECT DISTINCT '/films/' || user_id AS path, CASE WHEN user_id % 2 = 0 THEN 'indexed' ELSE 'not_indexed' END AS status FROM events)
 SELECT path, CASE WHEN job = 'running' THEN 'running' WHEN job = 'error' THEN 'error' ELSE status END AS shown FROM lib LEFT JOIN last USING (path)"""
)
def display_status(spark, d):
    status = F.when(F.col("user_id") % 2 == 0, "indexed").otherwise("not_indexed")
    lib = table(spark, d, "events").select(F.concat(F.lit("/films/"), F.col("user_id").cast("string")).alias("path"), status.alias("status")).distinct()
    return library.display(lib, jobs(spark, d)).select("path", "shown")


@query(
    """WITH new AS (SELECT doc_id, 'quality ' || quality AS text FROM labels UNION ALL SELECT item_id + 1000000000, text FROM benchmark)
 SELECT doc_id, text FROM documents WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.doc_id = documents.doc_id) UNION ALL SELECT doc_id, text FROM new"""
)
def upsert_units(spark, d):
    old = table(spark, d, "documents").select("doc_id", "text")
    updated = table(spark, d, "labels").select("doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"))
    added = table(spark, d, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id"), "text")
    new = updated.unionByName(added).withColumn("version", F.lit(2))
    stale = new.withColumns({"text": F.lit("stale"), "version": F.lit(1)})
    return merge(old, last_by_key(new.unionByName(stale), "doc_id", "version").select("doc_id", "text"), "doc_id")


@query("SELECT vec_id AS unit_id, label FROM embeddings WHERE vec_id = 17")
def unit_lookup(spark, d):
    return unit_vectors(spark, d).where(F.col("unit_id") == 17).limit(1).select("unit_id", "label")


@query("SELECT count(*) AS n FROM embeddings")
def row_counts(spark, d):
    return unit_vectors(spark, d).agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT event_id, event_id % 9 AS k, event_id % 2000 AS a, user_id AS b FROM events),
 r AS (SELECT event_id, CASE WHEN k IN (0, 1, 4, 6) THEN a WHEN k = 2 THEN greatest(0, 1000 - b) WHEN k = 5 THEN 0 END AS s, CASE WHEN k = 0 THEN a + b WHEN k = 4 THEN a - 3 WHEN k IN (1, 2, 5, 6) THEN 999 END AS e FROM e)
 SELECT event_id, CASE WHEN s <= least(e, 999) AND s < 1000 THEN s END AS "start", CASE WHEN s <= least(e, 999) AND s < 1000 THEN least(e, 999) END AS "end" FROM r"""
)
def range_parse(spark, d):
    """Headers of all forms from the events' numbers, for a file of 1,000 bytes: whole, open, suffix, other units, reversed, empty and padded ones."""
    a, b, k = (F.col("event_id") % 2000).cast("string"), F.col("user_id").cast("string"), F.col("event_id") % 9
    whole = F.concat(F.lit("bytes="), a, F.lit("-"), (F.col("event_id") % 2000 + F.col("user_id")).cast("string"))
    back = F.concat(F.lit("bytes="), a, F.lit("-"), (F.col("event_id") % 2000 - 3).cast("string"))
    header = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("bytes="), a, F.lit("-"))).when(k == 2, F.concat(F.lit("bytes=-"), b)).when(k == 3, F.concat(F.lit("items="), a, F.lit("-")))
    header = header.when(k == 4, back).when(k == 5, F.lit("bytes=-")).when(k == 6, F.concat(F.lit("  bytes="), a, F.lit("-99999 "))).when(k == 7, F.lit("")).otherwise(F.col("event_type"))
    span = P.byte_range(header, F.lit(1000))
    return table(spark, d, "events").select("event_id", span["start"].alias("start"), span["end"].alias("end"))


@query(
    """WITH s AS (SELECT event_id, floor(abs(value) * 100)::BIGINT AS s FROM events)
 SELECT event_id, CASE WHEN s // 3600 > 0 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s % 3600 // 60, s % 60) END AS label,
 CASE WHEN s // 60 > 0 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s % 60) END AS elapsed FROM s"""
)
def time_label(spark, d):
    s = F.floor(F.abs("value") * 100)
    return table(spark, d, "events").select("event_id", X.time_label(s).alias("label"), X.elapsed_label(s).alias("elapsed"))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(replace(replace(lower(n_name), '_', ' '), '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM nation")
def film_label(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.film_label(F.lower("n_name")).alias("label"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' ELSE 'image/jpeg' END AS media_type FROM part")
def media_types(spark, d):
    end = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".webp", ".tiff", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", P.media_type(F.concat(F.lit("/k/"), F.col("p_partkey").cast("string"), end)).alias("media_type"))


@query(
    """SELECT p_partkey, p_size::DOUBLE AS duration, CASE p_partkey % 3 WHEN 0 THEN 30000 / 1001.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE ELSE 24.0::DOUBLE END AS fps, p_partkey % 2 = 0 AS has_embedded_subs,
 CASE WHEN p_partkey % 4 = 0 THEN 'film ' || p_partkey ELSE p_name END AS title FROM part WHERE p_partkey % 4 <> 0 OR true"""
)
def probe_metadata(spark, d):
    k = F.col("p_partkey")
    rate = F.when(k % 3 == 0, '"r_frame_rate":"30000/1001"').when(k % 3 == 1, '"r_frame_rate":"0/0","avg_frame_rate":"25/1"').otherwise('"r_frame_rate":"1/0","avg_frame_rate":"24"')
    subs = F.when(k % 2 == 0, ',{"codec_type":"subtitle"}').otherwise("")
    title = F.when(k % 4 == 0, F.lit(" ")).otherwise(F.col("p_name"))
    text = F.concat(F.lit('{"streams":[{"codec_type":"audio","r_frame_rate":"9/1"},{"codec_type":"video",'), rate, F.lit("}"), subs, F.lit('],"format":{"duration":"'), F.col("p_size").cast("string"), F.lit('","tags":{"title":"'), title, F.lit('"}}}'))
    probed = table(spark, d, "part").select(k.cast("string").alias("film_id"), F.concat(F.lit("/films/film "), k.cast("string"), F.lit(".mkv")).alias("path"), text.alias("metadata"))
    return film_source.describe(probed, "/assets").select(F.col("film_id").cast("long").alias("p_partkey"), "duration", "fps", "has_embedded_subs", "title")


@query(
    """WITH l AS (SELECT event_id, [user_id, user_id + 1, user_id + 2] AS shown, CASE WHEN event_id % 4 = 0 THEN user_id + event_id % 3 END AS chosen FROM events),
 s AS (SELECT unnest(shown) AS u FROM l), n AS (SELECT u, count(*) AS shown FROM s GROUP BY u), c AS (SELECT chosen AS u, count(*) AS chosen FROM l WHERE chosen IS NOT NULL GROUP BY chosen)
 SELECT u::VARCHAR AS unit_id, n.shown, coalesce(c.chosen, 0) AS chosen, round(coalesce(c.chosen, 0) / n.shown::DOUBLE, 9) AS rate FROM n LEFT JOIN c USING (u)"""
)
def click_rates(spark, d):
    u = F.col("user_id")
    log = table(spark, d, "events").select(F.transform(F.array(u, u + 1, u + 2), lambda x: x.cast("string")).alias("shown"), F.when(F.col("event_id") % 4 == 0, (u + F.col("event_id") % 3).cast("string")).alias("chosen"))
    return boards.click_rates(log).withColumn("rate", F.round("rate", 9))


@query(
    """WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER w > INTERVAL 30 MINUTE)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, session"""
)
def session_windows(spark, d):
    return sessions(table(spark, d, "events")).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
