"""Further named queries: probing and subtitles with stand-ins for outside programs, stores and their versions, annotation, motion, clips, the index.

They are added to those of ``catalog``, each with its DuckDB SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.catalog import BATCH_SQL, BM25_SQL, FILES_SQL, JOBS_SQL, TALK_SQL, UNITS_SQL, files_and_films, jobs, queries_of, query, query_texts, table, talk, unit_vectors
from shotloom.config import Weights
from shotloom.functions import text as X
from shotloom.operators import annotate, fusion, lexical_index, library, media, scenes, search, shots, vector_index
from shotloom.plans import hybrid, models
from shotloom.schemas import FILMS_TABLE, UNITS
from shotloom.sources import films as film_source
from shotloom.sources import subtitles
from shotloom.sources.store import Store, Table, last_by_key, merge
from shotloom.streaming import incremental
from shotloom.streaming import jobs as jobs_stream


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and every executor share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/shotloom-{uuid.uuid4().hex}"


# --- files, metadata, subtitles ---


def film_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("/films/film "), F.col("p_partkey").cast("string"), F.lit(".mkv")).alias("path"))


@query(
    """WITH f AS (SELECT p_partkey, '/films/film ' || p_partkey || '.mkv' AS path FROM part)
 SELECT sha256(path) AS film_id, path, '/assets/' || sha256(path) AS asset_dir, (length(path) * 10)::DOUBLE AS duration, 25.0::DOUBLE AS fps, length(path) % 2 = 0 AS has_embedded_subs, 'film ' || p_partkey AS title FROM f"""
)
def probe_files(spark, d):
    """Paths to films through a hasher and a prober where the files are."""
    import hashlib

    probed = film_source.probe_files(film_paths(spark, d), lambda p: hashlib.sha256(p.encode()).hexdigest(), lambda p: film_source.metadata(len(p) * 10.0, "25/1", len(p) % 2 == 0))
    return film_source.describe(probed, "/assets").select("film_id", "path", "asset_dir", "duration", "fps", "has_embedded_subs", "title")


@query(
    """WITH f AS (SELECT n_nationkey, '/films/' || lower(n_name) || '.mkv' AS path FROM nation)
 SELECT n_nationkey::VARCHAR AS film_id, 0 AS pos, 1.0::DOUBLE AS "start", 2.5::DOUBLE AS "end", 'Line of ' || path AS text FROM f WHERE n_nationkey % 2 = 0
 UNION ALL SELECT n_nationkey::VARCHAR, 0, 0.5::DOUBLE, 1.5::DOUBLE, 'heard in ' || path FROM f WHERE n_nationkey % 2 = 1"""
)
def dialogue_with_fallback(spark, d):
    """Embedded subtitles, else recognised speech; blank lines of it are dropped."""
    films = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("film_id"), F.concat(F.lit("/films/"), F.lower("n_name"), F.lit(".mkv")).alias("path"), (F.col("n_nationkey") % 2 == 0).alias("has_embedded_subs"))
    return subtitles.lines(films, lambda p: f"1\n00:00:01,000 --> 00:00:02,500\n<i>Line of {p}</i>\n", lambda p: [(0.5, 1.5, f" heard in {p} "), (2.0, 3.0, "  ")])


@query(f'WITH {TALK_SQL} SELECT film_id::VARCHAR AS film_id, pos, "start", "end", text FROM talk')
def dialogue_json(spark, d):
    """Dialogue lines written as JSON by film, and read again."""
    folder = scratch(spark)
    subtitles.write_json(talk(spark, d).withColumn("film_id", F.col("film_id").cast("string")), folder)
    return subtitles.read_json(spark, folder).select("film_id", "pos", "start", "end", "text")


# --- stores ---


@query(f"SELECT 'units' AS name, 0::BIGINT AS n, {len(UNITS)} AS columns UNION ALL SELECT 'films', count(*), {len(FILMS_TABLE)} FROM customer")
def created_tables(spark, d):
    """The two tables of a store: creating them again changes neither their columns nor the films that one of them has."""
    store = Store(spark, scratch(spark)).create()
    store.films.upsert(_films(spark, d))
    store.create()
    rows = [spark.range(1).select(F.lit(name).alias("name"), F.lit(t.count()).cast("long").alias("n"), F.lit(len(t.read().columns)).alias("columns")) for name, t in (("units", store.units), ("films", store.films))]
    return rows[0].unionByName(rows[1])


def _films(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select(k.alias("film_id"), F.col("c_name").alias("title"), F.concat(F.lit("/films/"), k).alias("path"), F.col("c_custkey").cast("double").alias("duration"))


@query(
    """SELECT c_custkey::VARCHAR AS film_id, CASE WHEN c_custkey % 3 = 0 THEN 'again ' || c_name ELSE c_name END AS title, '/films/' || c_custkey AS path, c_custkey::DOUBLE AS duration FROM customer
 UNION ALL SELECT 's' || s_suppkey, s_name, '/new/' || s_suppkey, 1.0::DOUBLE FROM supplier"""
)
def upsert_films(spark, d):
    again = _films(spark, d).where("duration % 3 = 0").withColumn("title", F.concat(F.lit("again "), F.col("title")))
    k = F.col("s_suppkey").cast("string")
    new = table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("film_id"), F.col("s_name").alias("title"), F.concat(F.lit("/new/"), k).alias("path"), F.lit(1.0).alias("duration"))
    return merge(_films(spark, d), last_by_key(again.unionByName(new), "film_id", "title"), "film_id")


@query("SELECT c_custkey::VARCHAR AS film_id, c_name AS title, '/films/' || c_custkey AS path, c_custkey::DOUBLE AS duration FROM customer WHERE c_custkey = 7")
def film_lookup(spark, d):
    """One film by its key, from the files that have room for it."""
    kept = Table(spark, scratch(spark), "films", FILMS_TABLE, "film_id").create()
    kept.upsert(_films(spark, d))
    return kept.lookup("7").select("film_id", "title", "path", "duration")


@query(
    """SELECT c_custkey::VARCHAR AS film_id, CASE WHEN c_custkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS change, c_name AS before, CASE WHEN c_custkey % 5 <> 0 THEN 'again ' || c_name END AS after FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0
 UNION ALL SELECT 's' || s_suppkey, 'added', NULL, s_name FROM supplier"""
)
def version_changes(spark, d):
    """Films that were added, changed and removed between two versions, after further writes, a compaction and the expiry of the first version."""
    films, kept = _films(spark, d), Table(spark, scratch(spark), "films", FILMS_TABLE, "film_id", 8).create()
    old = kept.upsert(films)
    k = F.col("s_suppkey").cast("string")
    new = table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("film_id"), F.col("s_name").alias("title"), F.concat(F.lit("/new/"), k).alias("path"), F.lit(1.0).alias("duration"))
    kept.upsert(films.where("duration % 3 = 0").withColumn("title", F.concat(F.lit("again "), F.col("title"))).unionByName(new), "title")
    kept.remove(films.where("duration % 5 = 0").select("film_id"))
    kept.upsert(films.where("duration % 7 = 0 AND duration % 3 <> 0 AND duration % 5 <> 0"))  # as they were
    last = kept.compact(files=2, share=0.1) or kept.current()
    kept.expire(len(kept.versions()) - old)
    return kept.changes(old, last).select("film_id", "change", F.col("before.title").alias("before"), F.col("after.title").alias("after"))


@query(
    """SELECT 'version 1' AS state, c_custkey::VARCHAR AS film_id, c_name AS title FROM customer UNION ALL
 SELECT 'version 2', c_custkey::VARCHAR, CASE WHEN c_custkey % 3 = 0 THEN 'again ' || c_name ELSE c_name END FROM customer UNION ALL SELECT 'rolled back', c_custkey::VARCHAR, c_name FROM customer"""
)
def version_rollback(spark, d):
    """A table's versions after an upsert, and what is read after a rollback."""
    kept = Table(spark, scratch(spark), "films", FILMS_TABLE, "film_id").create()
    first = kept.upsert(_films(spark, d), "title")
    second = kept.upsert(_films(spark, d).where("duration % 3 = 0").withColumn("title", F.concat(F.lit("again "), F.col("title"))), "title")
    kept.rollback(first)
    states = (("version 1", kept.read(first)), ("version 2", kept.read(second)), ("rolled back", kept.read()))
    rows = [df.select(F.lit(name).alias("state"), "film_id", "title") for name, df in states]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    f"""WITH {FILES_SQL}, {JOBS_SQL}, last AS (SELECT path, arg_max(status, pos) AS status FROM jobs GROUP BY path)
 SELECT count(*) FILTER (WHERE films.path IS NOT NULL AND last.status IS DISTINCT FROM 'running' AND last.status IS DISTINCT FROM 'error') + count(*) FILTER (WHERE films.path IS NOT NULL AND last.status = 'error') AS indexed
 FROM files f LEFT JOIN films USING (path) LEFT JOIN last USING (path) WHERE NOT ends_with(f.path, '.txt')"""
)
def indexed_count(spark, d):
    files, films = files_and_films(spark, d)
    return library.indexed_count(library.status(files, films), jobs(spark, d))


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS "key", event_type AS stage, epoch_us(ts) // 1000 AS at_ms, (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) AS passed FROM events),
 o AS (SELECT *, coalesce(at_ms - lag(at_ms) OVER w > 1800000, true)::INT AS fresh, lead(at_ms) OVER w AS until FROM e WHERE at_ms <= passed WINDOW w AS (PARTITION BY "key" ORDER BY at_ms, stage)),
 j AS (SELECT *, sum(fresh) OVER (PARTITION BY "key" ORDER BY at_ms, stage ROWS UNBOUNDED PRECEDING) AS job FROM o),
 n AS (SELECT *, row_number() OVER (PARTITION BY "key", job ORDER BY at_ms, stage) AS n FROM j)
 SELECT "key", 'stage' AS kind, stage, at_ms, (until - at_ms) / 1000 AS seconds, n FROM n WHERE until - at_ms <= 1800000
 UNION ALL SELECT "key", 'job', NULL, min(at_ms), (max(at_ms) - min(at_ms)) / 1000, count(*) FROM n GROUP BY "key", job, passed HAVING passed > max(at_ms) + 1800000"""
)
def job_stages(spark, d):
    """Events as a stream of files, of which each user's are a job: stage times and ended jobs up to the watermark, an hour before the last event.

    The files arrive in four parts by time. The stream runs after each, and takes all its files as one batch: a part's files lie side by side in time, so one of them alone
    would move the watermark past events of the others.
    """
    events, folder = table(spark, d, "events").select("user_id", "event_type", "ts"), scratch(spark)
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.25, 0.5, 0.75])).first()[0] or []
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for low, high in zip([None, *cuts], [*cuts, None]):
        own = (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
        events.where(own).write.mode("append").parquet(f"{folder}/events")
        stream = incremental.files(spark, f"{folder}/events", events.schema, per_trigger=1 << 30)
        jobs_table = jobs_stream.follow(spark, stream, folder)
    return jobs_table.read().drop("id")


# --- labels, media, representatives ---


@query("SELECT event_id, CASE WHEN event_id % 5000 < 3 THEN (greatest(event_id % 5000 - 2, 0)) || 's' WHEN (event_id % 5000 - 2) // 60 > 0 THEN ((event_id % 5000 - 2) // 60) || 'm ' || ((event_id % 5000 - 2) % 60) || 's' ELSE ((event_id % 5000 - 2) % 60) || 's' END AS label FROM events")
def elapsed_label(spark, d):
    return table(spark, d, "events").select("event_id", X.elapsed_label((F.col("event_id") % 5000 - 2).cast("double") + 0.5).alias("label"))


@query(f"WITH {UNITS_SQL} SELECT unit_id, greatest(0.0::DOUBLE, t_start - 1) AS play_at FROM units")
def play_position(spark, d):
    return unit_vectors(spark, d).select("unit_id", media.play_position(F.col("t_start")).alias("play_at"))


@query(
    f"""WITH {UNITS_SQL} SELECT unit_id, greatest(0.0::DOUBLE, t_start - 0.25) AS clip_start, least(15000.0::DOUBLE, t_end + 0.25) AS clip_end,
 least(t_start + 3 / (unit_id % 3 * 12 + 0.5::DOUBLE), (t_start + t_end) / 2) AS inner_start, greatest(t_end - 3 / (unit_id % 3 * 12 + 0.5::DOUBLE), (t_start + t_end) / 2) AS inner_end FROM units"""
)
def clip_bounds(spark, d):
    clip = media.clip_bounds(F.col("t_start"), F.col("t_end"), F.lit(15000.0))
    inner = media.inward_bounds(F.col("t_start"), F.col("t_end"), F.col("unit_id") % 3 * 12 + F.lit(0.5))
    return unit_vectors(spark, d).select("unit_id", clip["start"].alias("clip_start"), clip["end"].alias("clip_end"), inner["start"].alias("inner_start"), inner["end"].alias("inner_end"))


@query(f"WITH {UNITS_SQL} SELECT unit_id, film_id FROM units WHERE unit_id % 3 <> 1 AND film_id IN (2, 3, 5)")
def representative_filter(spark, d):
    marked = unit_vectors(spark, d).withColumn("is_representative", F.col("unit_id") % 3 != 1)
    return search.filtered(marked, {"film_id": [2, 3, 5], "label": None}).select("unit_id", "film_id")


# --- annotation ---


@query(
    """SELECT vec_id AS unit_id, least(vec_id % 6, 3)::INT AS n, array_to_string(list_transform(range(least(vec_id % 6, 3)), lambda i: '/k/' || vec_id || '_' || i || (CASE WHEN i % 2 = 0 THEN '.webp' ELSE '.png' END)), ' ') AS images,
 array_to_string(list_transform(range(least(vec_id % 6, 3)), lambda i: CASE WHEN i % 2 = 0 THEN 'image/webp' ELSE 'image/png' END), ' ') AS media_types FROM embeddings"""
)
def caption_requests(spark, d):
    """What a captioner gets: the first three keyframes and their media types."""
    k = F.col("unit_id").cast("string")
    every = F.transform(F.slice(F.sequence(F.lit(0), F.lit(5)), F.lit(1), (F.col("unit_id") % 6).cast("int")), lambda i: F.concat(F.lit("/k/"), k, F.lit("_"), i.cast("string"), F.when(i % 2 == 0, ".webp").otherwise(".png")))
    asked = annotate.requests(unit_vectors(spark, d).withColumn("keyframe_paths", every))
    return asked.select("unit_id", F.size("images").alias("n"), F.array_join("images", " ").alias("images"), F.array_join("media_types", " ").alias("media_types"))


@query(
    """SELECT item_id::VARCHAR AS shot_id, CASE WHEN item_id % 4 = 0 THEN '' ELSE 'A view of ' || item_id || '.' END AS caption, CASE WHEN item_id % 4 = 0 THEN '' ELSE 'calm|dark' END AS mood,
 CASE WHEN item_id % 4 = 0 THEN '' ELSE 'A view of ' || item_id || '. said ' || item_id END AS searchable_text, CASE WHEN item_id % 4 = 0 THEN 'ValueError: no answer' END AS annotation_error FROM benchmark"""
)
def failed_captions(spark, d):
    """A captioner that fails on some shots: their rows stay, with empty texts and the error."""

    def captioner(images: list[str], dialogue: list[str]) -> str:
        n = int(dialogue[0].split()[1])
        if n % 4 == 0:
            raise ValueError("no answer")
        return f"A view of {n}.\nMood: calm, dark"

    k = F.col("item_id").cast("string")
    asked = table(spark, d, "benchmark").select(k.alias("shot_id"), F.array(F.concat(F.lit("/k/"), k)).alias("keyframe_paths"), F.array(F.concat(F.lit("said "), k)).alias("dialogue"))
    return annotate.parse(annotate.call(asked, captioner)).select("shot_id", "caption", F.array_join("mood", "|").alias("mood"), "searchable_text", "annotation_error")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN lang END AS setting, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 4)::INT END AS people, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 = 0 END AS is_bw,
 CASE WHEN doc_id % 5 <> 0 THEN 'red|' || lang END AS colors, CASE WHEN doc_id % 3 <> 0 THEN 'scene of ' || (doc_id % 3) END AS scene_narrative FROM documents"""
)
def structured_annotation(spark, d):
    """Answers in the ontology's JSON, null where they don't parse, with their scenes' narratives."""
    lang = F.coalesce(F.to_json(F.struct(F.col("lang").alias("setting"), (F.col("doc_id") % 4).cast("int").alias("people"), (F.col("doc_id") % 2 == 0).alias("is_bw"), F.array(F.lit("red"), F.col("lang")).alias("colors"))), F.lit(""))
    raw = F.when(F.col("doc_id") % 5 == 0, F.lit("{not json")).otherwise(lang)
    parsed = annotate.parse_structured(table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("scene_id"), raw.alias("raw")))
    told = spark.range(1, 3).select(F.col("id").alias("scene_id"), F.concat(F.lit("scene of "), F.col("id").cast("string")).alias("narrative"))
    out = annotate.inherit_scene(parsed, told)
    return out.select("doc_id", "annotation.setting", "annotation.people", "annotation.is_bw", F.array_join("annotation.colors", "|").alias("colors"), "scene_narrative")


@query(
    """WITH v AS (SELECT vec_id, (vec_id % 20)::INT AS film_id, (vec_id // 20)::INT AS pos, embedding::DOUBLE[] AS v FROM embeddings),
 f AS (SELECT *, coalesce((list_cosine_similarity(v, lag(v) OVER w) > 0.02 AND pos % 7 <> 0)::INT, 0) AS near FROM v WINDOW w AS (PARTITION BY film_id ORDER BY pos)),
 r AS (SELECT *, sum(1 - near) OVER (PARTITION BY film_id ORDER BY pos) AS run FROM f)
 SELECT film_id, (run - 1)::INT AS pos, min(pos) * 6.0::DOUBLE + min(pos) // 7 * 2 AS t_start, max(pos) * 6.0::DOUBLE + max(pos) // 7 * 2 + 5.5 AS t_end FROM r GROUP BY film_id, run"""
)
def content_flash_merge(spark, d):
    """Neighbouring shots that follow at once and look alike become one; every seventh starts late."""
    pos = F.floor(F.col("vec_id") / 20).cast("int")
    start = pos * 6.0 + F.floor(pos / 7) * 2
    rows = table(spark, d, "embeddings").select((F.col("vec_id") % 20).cast("int").alias("film_id"), pos.alias("pos"), start.alias("t_start"), (start + 5.5).alias("t_end"), F.col("embedding").alias("vec"))
    return shots.flash_merge_by_content(rows, 1.0, 0.02)


@query(
    """WITH f AS (SELECT l_orderkey AS shot_id, l_linenumber AS frame, l_quantity::DOUBLE - 25.3 AS dx, (l_suppkey % 9)::DOUBLE - 4.1 AS dy FROM lineitem),
 n AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, (floor((atan2(dy, dx) + pi()) / (2 * pi()) * 8))::INT % 8 AS dir FROM f),
 g AS (SELECT shot_id, frame, avg(dx) AS gx, avg(dy) AS gy, avg(len) AS mean FROM n GROUP BY shot_id, frame),
 h AS (SELECT shot_id, list_transform(range(8), lambda k: len(list_filter(list(dir), lambda x: x = k))) AS h FROM n GROUP BY shot_id),
 j AS (SELECT *, sqrt((gx - lag(gx) OVER w) ** 2 + (gy - lag(gy) OVER w) ** 2) AS jerk FROM g WINDOW w AS (PARTITION BY shot_id ORDER BY frame))
 SELECT shot_id, round(avg(mean), 6) AS flow_mean, array_to_string(any_value(h), ' ') AS directions, round(avg(sqrt(gx * gx + gy * gy)) / avg(mean), 6) AS global_ratio, round(coalesce(avg(jerk), 0), 6) AS shakiness FROM j JOIN h USING (shot_id) GROUP BY shot_id"""
)
def motion_features(spark, d):
    flows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("shot_id"), F.col("l_linenumber").alias("frame"), (F.col("l_quantity").cast("double") - 25.3).alias("dx"), ((F.col("l_suppkey") % 9).cast("double") - 4.1).alias("dy"))
    found = scenes.motion(flows)
    r = lambda c: F.round(c, 6).alias(c)
    return found.select("shot_id", r("flow_mean"), F.array_join(F.transform("direction_histogram", lambda x: x.cast("string")), " ").alias("directions"), r("global_ratio"), r("shakiness"))


# --- models, the index, three channels ---


@query("SELECT vec_id AS unit_id, 32 AS size, 1.0::DOUBLE AS length FROM embeddings")
def image_embedding_stub(spark, d):
    """The image encoder's stand-in: vectors of its dimension and of length 1."""
    paths = unit_vectors(spark, d).select("unit_id", F.concat(F.lit("/k/"), F.col("unit_id").cast("string")).alias("path"))
    vec = models.embed(paths, models.path_hash(32), 32, "path", "img_vec")
    return vec.select("unit_id", F.size("img_vec").alias("size"), F.round(F.sqrt(F.aggregate("img_vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4).alias("length"))


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM lex WHERE rank <= 10")
def bm25_index_top10(spark, d):
    """The stored index of two segments, searched by bounds of its blocks: what scoring every row gives."""
    folder, docs = scratch(spark), table(spark, d, "documents")
    lexical_index.add(docs.where("doc_id % 2 = 0"), folder)
    lexical_index.add(docs.where("doc_id % 2 <> 0"), folder)
    return lexical_index.search(spark, folder, query_texts(spark, d), 10)


@query()
def ann_recall(spark, d):
    """The stored product-quantised index over all units: its recall of the exact ten nearest for the stated query set, and what a search reads of it."""
    units, asked, folder = unit_vectors(spark, d), queries_of(spark, d), scratch(spark)
    index = vector_index.ProductIndex.fit(units, lists=64, spill=3)
    index.write(units, folder)
    found = index.search(spark, folder, asked, 10, probes=16)
    exact = search.top_k_batch(units, asked, 10)
    hits = exact.join(found.select("query_id", "unit_id", F.lit(1.0).alias("hit")), ["query_id", "unit_id"], "left")
    recall = hits.agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
    return recall.select("queries", "recall", F.lit(len(index.centroids)).alias("lists"), F.lit(min(16, len(index.centroids))).alias("lists_read"))


@query(
    f"""WITH {UNITS_SQL}, {BATCH_SQL.format(k=50).replace("FROM units, q", "FROM units, q WHERE unit_id IN (SELECT doc_id FROM documents)")}, {BM25_SQL},
 turned AS (SELECT unit_id, list_transform(range(64), lambda i: v[64 - i] * (i % 3 + 1)) AS v FROM units WHERE unit_id IN (SELECT doc_id FROM documents)),
 di AS (SELECT query_id, unit_id, round(1.0 - list_cosine_similarity(v, qv), 6) AS distance FROM turned, q),
 img AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, unit_id)::INT AS rank FROM di QUALIFY rank <= 50),
 parts AS (SELECT query_id, unit_id, 0.4::DOUBLE / (60 + rank) AS img, 0.0::DOUBLE AS lex, 0.0::DOUBLE AS txt FROM img
  UNION ALL SELECT query_id, doc_id, 0.0::DOUBLE, 0.2::DOUBLE / (60 + rank), 0.0::DOUBLE FROM lex WHERE rank <= 50 UNION ALL SELECT query_id, unit_id, 0.0::DOUBLE, 0.0::DOUBLE, 0.4::DOUBLE / (60 + rank) FROM found),
 fused AS (SELECT query_id, unit_id, max(img) + max(lex) + max(txt) AS score FROM parts GROUP BY query_id, unit_id),
 s AS (SELECT query_id, unit_id, round(score * (1.0 + 0.05::DOUBLE * coalesce(quality, 0)), 9) AS score FROM fused LEFT JOIN labels ON doc_id = unit_id)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id)::INT AS rank FROM s"""
)
def three_channel_search(spark, d):
    """Text vectors, image vectors and words, fused and weighted by the curation prior. The plan's parts, with documents as the units' texts."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("txt_vec", 63 - i).cast("double") * (i % 3 + 1))
    curated = table(spark, d, "labels").select(F.col("doc_id").alias("unit_id"), "quality")
    captions = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("caption"), F.lit(None).cast("string").alias("searchable_text"))
    units = captions.join(unit_vectors(spark, d).withColumn("img_vec", turned), "unit_id", "left").join(curated, "unit_id", "left")
    asked = queries_of(spark, d).join(query_texts(spark, d), "query_id", "full")
    weight = fusion.prior(quality=(0.05, F.col("quality").cast("double")))
    return hybrid.hybrid(units, asked, Weights(0.4, 0.4, 0.2), weight, 50)
