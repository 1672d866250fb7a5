import hashlib
import time

import pytest
from pyspark.sql import functions as F

from shotloom import cli, config, doctor
from shotloom.api import Engine, NotFound, Rejected
from shotloom.functions import paths as P
from shotloom.operators import boards, library
from shotloom.plans import hybrid, models
from shotloom.plans.ingest import Stages
from shotloom.schemas import UNITS, conform, of_dimension, with_json_lists
from shotloom.sources import films, gold, ranges
from shotloom.sources.store import Store, Table
from shotloom.streaming import incremental

CONFIG = """
paths: {{films_dir: {films}, assets_dir: {assets}}}
models: {{visual_encoder: pe_core_l14, text_encoder: t, annotator: a, router: r}}
thresholds: {{shot_dedup_cosine: 0.12, scene_visual_sim: 0.75, scene_dialogue_gap: 2.5, scene_max_duration: 300, subsegment_min_duration: 20}}
retrieval: {{weights: {{img: 0.4, txt: 0.4, lex: 0.2}}, diversity: {{max_per_scene: 2, max_per_film: 4}}, rerank_enabled: false}}
scoring: {{duration_weight: 0.05, motion_weight: 0.05, frame_worthiness_weight: 0.10}}
"""


def settings(tmp_path):
    (tmp_path / "films").mkdir(exist_ok=True)
    path = tmp_path / "config.yaml"
    path.write_text(CONFIG.format(films=tmp_path / "films", assets=tmp_path / "assets"))
    return path


def test_config(tmp_path, monkeypatch):
    path = settings(tmp_path)
    c = config.load(path)
    assert (c.models.whisper, c.thresholds.flash_min_duration, c.thresholds.keyframe_short_shot_s, c.retrieval.weights.img) == ("large-v3", 0.5, 2.0, 0.4)
    monkeypatch.setenv(config.ENVIRONMENT, str(path))
    assert config.load() == c
    monkeypatch.delenv(config.ENVIRONMENT)
    monkeypatch.chdir(tmp_path)
    assert config.load() == c and c.digest("models") != c.digest("thresholds")
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yaml")
    path.write_text(path.read_text().replace("annotator: a, ", ""))
    with pytest.raises(KeyError, match="annotator"):
        config.load(path)


def test_metadata(spark):
    rows = [
        ("a", '{"format":{"duration":"30.0","tags":{"TITLE":" T "}},"streams":[{"codec_type":"video","r_frame_rate":"30/1"},{"codec_type":"subtitle"}]}'),
        ("b", '{"format":{"tags":{}},"streams":[{"codec_type":"audio","duration":"9"},{"codec_type":"video","r_frame_rate":"0/0","avg_frame_rate":"30000/1001","duration":"12.5"}]}'),
        ("c", '{"format":{},"streams":[{"codec_type":"video","r_frame_rate":"1/0","avg_frame_rate":""},{"codec_type":"video","r_frame_rate":"x","avg_frame_rate":"25"}]}'),
    ]
    df = spark.createDataFrame([(i, f"/films/my.{i}.mkv", m) for i, m in rows], "film_id string, path string, metadata string")
    got = {r["film_id"]: r for r in films.describe(df, "/assets/", strict=False).collect()}
    assert (got["a"]["duration"], got["a"]["fps"], got["a"]["has_embedded_subs"], got["a"]["title"], got["a"]["asset_dir"]) == (30.0, 30.0, True, "T", "/assets/a")
    assert (got["b"]["duration"], got["b"]["fps"], got["b"]["has_embedded_subs"], got["b"]["title"]) == (12.5, 30000 / 1001, False, "my.b")
    assert got["c"]["duration"] is None and got["c"]["fps"] == 25.0
    with pytest.raises(Exception, match="no duration"):
        films.describe(df, "/assets").collect()


def test_content_hash(tmp_path, monkeypatch):
    monkeypatch.setattr(films, "EDGE", 4)
    small, large = tmp_path / "s", tmp_path / "l"
    small.write_bytes(b"12345678")
    large.write_bytes(b"1234-middle-5678")
    assert films.content_hash(str(small)) == films.content_hash(str(large)) == hashlib.sha256(b"12345678").hexdigest()


def test_scan_and_library(spark, tmp_path):
    for name in ("B.MKV", "a.mp4", "c.txt", "d.webm"):
        (tmp_path / name).write_bytes(b"x" * 10)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.mkv").write_bytes(b"x")
    listed = films.scan(spark, str(tmp_path))
    indexed = spark.createDataFrame([(str(tmp_path / "a.mp4"),)] * 2, "path string")
    rows = library.status(listed, indexed).collect()
    assert [(r["filename"], r["status"], r["size_gb"]) for r in rows] == [("a.mp4", "indexed", 0.0), ("B.MKV", "not_indexed", 0.0), ("d.webm", "not_indexed", 0.0)]
    assert films.scan(spark, str(tmp_path / "none")).count() == 0


def test_jobs(spark):
    jobs = spark.createDataFrame([(0, "/a", "done", 100.0), (1, "/a", "running", None), (2, "/b", "error", 399.0), (3, "/c", "done", 401.0)], "pos int, path string, status string, finished_at double")
    assert {r["pos"] for r in library.prune(jobs, 700.0).collect()} == {1, 3}
    assert {r["path"]: r["status"] for r in library.latest_jobs(jobs).collect()} == {"/a": "running", "/b": "error", "/c": "done"}
    lib = spark.createDataFrame([("/a", "indexed"), ("/b", "indexed"), ("/c", "not_indexed"), ("/d", "indexed")], "path string, status string")
    assert {r["path"]: r["shown"] for r in library.display(lib, jobs).collect()} == {"/a": "running", "/b": "error", "/c": "not_indexed", "/d": "indexed"}
    assert library.indexed_count(lib, jobs).first()[0] == 2
    assert [r["path"] for r in library.conflicts(spark.createDataFrame([("/a",), ("/b",)], "path string"), jobs).collect()] == ["/a"]


@pytest.mark.parametrize(("header", "want"), [("bytes=0-999", (0, 999)), ("bytes=100-", (100, 999)), ("bytes=-500", (500, 999)), ("bytes=-", (0, 999)), (" bytes=5-9999 ", (5, 999)), ("totally-bogus", None), ("bytes=9-2", None), ("bytes=1000-", None)])
def test_ranges(spark, header, want):
    got = spark.createDataFrame([(header,)], "h string").select(P.byte_range(F.col("h"), F.lit(1000)).alias("r")).first()["r"]
    assert (got and tuple(got)) == want
    if want:
        assert ranges.parse(header, 1000) == want
    else:
        with pytest.raises(ranges.Unsatisfiable):
            ranges.parse(header, 1000)


def test_paths(spark):
    row = spark.range(1).select(P.suffix(F.lit("/x/.hidden")), P.suffix(F.lit("/x/a.b.MKV")), P.stem(F.lit("/x/a.b.mkv")), P.media_type(F.lit("k.PNG")), P.media_type(F.lit("k")), P.video_type(F.lit("a.odd")), F.size(P.chunk_spans(F.lit(0).cast("long"), F.lit(2500000).cast("long")))).first()
    assert tuple(row) == ("", ".mkv", "a.b", "image/png", "image/jpeg", "application/octet-stream", 3)


def test_table_versions(spark, tmp_path):
    table = Table(spark, str(tmp_path), "t", spark.createDataFrame([], "k string, g string, v int").schema, "k").create().create()
    assert table.count() == 0 and table.versions() == [0]
    table.upsert(spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "k string, g string, v int"))
    table.upsert(spark.createDataFrame([("b", "x", 3), ("b", "x", 4), ("c", "y", 5)], "k string, g string, v int"), "v")
    table.upsert(spark.createDataFrame([("c", "y", 5)], "k string, g string, v int"))
    assert sorted(map(tuple, table.read().collect())) == [("a", "x", 1), ("b", "x", 4), ("c", "y", 5)]
    table.replace(spark.createDataFrame([("d", "x", 9)], "k string, g string, v int"), "g")
    assert sorted(map(tuple, table.read().collect())) == [("c", "y", 5), ("d", "x", 9)]
    assert table.lookup("d").first()["v"] == 9 and table.lookup("zz").first() is None
    table.rollback(1)
    assert sorted(r["k"] for r in table.read().collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        table.rollback(99)
    plan = table.lookup("a")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,a)]" in plan


def test_schema_checks(spark):
    with pytest.raises(ValueError, match="columns missing"):
        conform(spark.createDataFrame([("x",)], "unit_id string"), UNITS)
    with pytest.raises(Exception, match="vector size"):
        spark.range(1).select(of_dimension(F.array(F.lit(1.0)), 2)).collect()


def engine(spark, tmp_path):
    c = config.load(settings(tmp_path))

    def detector(found):
        return found.select("film_id", F.posexplode(F.array(F.struct(F.lit(0).alias("a"), F.lit(239).alias("e")), F.struct(F.lit(240).alias("a"), F.lit(1439).alias("e")))).alias("pos", "x")).select("film_id", "pos", F.col("x.a").alias("start_frame"), F.col("x.e").alias("end_frame"))

    srt = "1\n00:00:01,000 --> 00:00:03,000\nthe pianist leaves\n\n2\n00:00:30,000 --> 00:00:33,000\nrain over harbour\n"
    stages = Stages(detector, prober=lambda p: films.metadata(60.0, "24/1", True, "Test"), extractor=lambda p: srt, captioner=lambda images, said: (_ for _ in ()).throw(RuntimeError("off")) if not said else f"A view of {said[0].split()[-1]}\nMood: calm")
    return Engine(spark, c, stages)


def test_ingest_search_and_serve(spark, tmp_path):
    e = engine(spark, tmp_path)
    film = tmp_path / "films" / "One.mkv"
    film.write_bytes(b"0123456789")
    done = e.run([str(film)]).first()
    units = e.store.units.read()
    assert (done["title"], done["duration"], units.count()) == ("Test", 60.0, 4)
    first = units.orderBy("t_start").first()
    assert (first["t_start"], first["t_end"], first["dialogue"], first["caption"]) == (0.0, 10.0, ["the pianist leaves"], "A view of leaves") and len(first["img_vec"]) == 1024
    silent = units.orderBy(F.desc("t_start")).first()
    assert silent["caption"] == "" and silent["searchable_text"] == "" and not any(silent["txt_vec"])
    e.run([str(film)])
    assert e.store.units.count() == 4 and e.store.films.count() == 1
    rows = e.search("  harbour rain ").orderBy("rank").collect()
    assert rows[0]["caption"] == "A view of harbour" and rows[0]["keyframe_url"] == f"/media/keyframe/{rows[0]['unit_id']}/0" and len(rows) == 2
    assert e.search("   ").count() == 0
    unit = e.unit(rows[0]["unit_id"])
    assert unit["film_id"] == done["film_id"] and e.more_like(unit["unit_id"]).count() == 3
    with pytest.raises(NotFound):
        e.unit("none")
    video = e.video(done["film_id"], "bytes=2-4")
    assert (video["status"], b"".join(video["chunks"]), video["headers"]["Content-Range"], video["media_type"]) == (206, b"234", "bytes 2-4/10", "video/x-matroska")
    assert e.video(done["film_id"])["status"] == 200
    with pytest.raises(NotFound):
        e.video("none")
    with pytest.raises(NotFound):
        e.keyframe(unit["unit_id"], 0)
    folder = tmp_path / "assets" / done["film_id"] / "keyframes"
    folder.mkdir(parents=True)
    (folder / f"{unit['unit_id']}_0.webp").write_bytes(b"w")
    assert e.keyframe(unit["unit_id"], 0)[1] == "image/webp"
    assert [(r["filename"], r["status"]) for r in e.library().collect()] == [("One.mkv", "indexed")]
    kind = "id string, query string, intent string, acceptable array<struct<film_id:string,t_start:double,t_end:double>>"
    asked = spark.createDataFrame([("a", "harbour rain", "vibe", [(done["film_id"], unit["t_start"], unit["t_end"])]), ("b", "x", "plot", [])], kind)
    assert tuple(e.evaluate(asked).first()) == (1, 1, 1.0, 1.0, 1.0)
    queries = models.embed(spark.createDataFrame([(1, "harbour rain")], "query_id int, query string"), e.encode, 1024, "query", "query_vec")
    found = hybrid.hybrid(units.withColumn("scene_id", F.lit("s")), queries, prior=F.lit(1.0))
    assert found.where("rank = 1").first()["unit_id"] == unit["unit_id"]
    assert hybrid.diversified(units.withColumn("scene_id", F.lit("s")), found).count() == 2
    assert with_json_lists(units).orderBy("t_start").first()["dialogue"] == '["the pianist leaves"]'


def test_jobs_of_the_engine(spark, tmp_path):
    e = engine(spark, tmp_path)
    with pytest.raises(Rejected) as refused:
        e.ingest(str(tmp_path / "none.mkv"))
    assert refused.value.status == 400
    film = tmp_path / "films" / "Two.mkv"
    film.write_bytes(b"abc")
    job = e.ingest(str(film))
    with pytest.raises(Rejected) as refused:
        e.ingest(str(film))
    assert refused.value.status == 409 and job["status"] == "running"
    for _ in range(240):
        if e.jobs().first()["status"] != "running":
            break
        time.sleep(0.5)
    row = e.jobs().first()
    assert (row["status"], row["error"]) == ("done", None) and e.store.units.count() == 4
    assert e.jobs(now=time.time() + 301).count() == 0


def test_cached_stages(spark, tmp_path):
    from shotloom.plans.ingest import Ingest

    e = engine(spark, tmp_path)
    film = tmp_path / "films" / "Three.mkv"
    film.write_bytes(b"abcd")
    files = spark.createDataFrame([(str(film),)], "path string")
    for want in (False, True):
        run = Ingest(spark, e.config, e.stages)
        run.run(files, e.store)
        cached = {r["stage"]: r["cached"] for r in run.stage_log().collect()}
        assert {cached[s] for s in ("dialogue", "shots", "images", "annotations")} == {want} and cached["units"] is False


def test_a_new_film_computes_one_film(spark, tmp_path):
    from shotloom.plans.ingest import Ingest

    e = engine(spark, tmp_path)
    names = []
    for k, made in ((1, 1), (2, 1), (5, 3), (5, 0)):
        for n in range(len(names), k):
            film = tmp_path / "films" / f"F{n}.mkv"
            film.write_bytes(b"film %d" % n)
            names.append(str(film))
        run = Ingest(spark, e.config, e.stages)
        films = run.run(spark.createDataFrame([(n,) for n in names], "path string"), e.store)
        log = {r["stage"]: r["films"] for r in run.stage_log().collect()}
        assert [log[s] for s in ("dialogue", "shots", "images", "annotations")] == [made] * 4
        assert films.count() == k and e.store.units.count() == 4 * k == e.store.units.read().select("unit_id").distinct().count()
    # rows of a run that isn't in the ledger don't count
    stage = next((tmp_path / "assets" / "stages" / "shots").iterdir())
    whole = spark.read.parquet(str(stage / "rows"))
    whole.where("run = (SELECT 'x')").drop("run").write.parquet(str(stage / "rows" / "run=rfailed"))
    one = Ingest(spark, e.config, e.stages)
    one.run(spark.createDataFrame([(names[0],)], "path string"), e.store)
    assert e.store.units.count() == 20 and {r["films"] for r in one.stage_log().where("stage <> 'units'").collect()} == {0}


def test_models(spark):
    assert models.dimension("pe_core_l14") == 1024 and models.dimension("siglip2_so400m") == 1152
    with pytest.raises(ValueError):
        models.dimension("other")
    df = spark.createDataFrame([("Red house red",), (None,), ("",)], "t string")
    own = models.bag_of_words(16)
    got = df.select(models.text_vector(F.col("t"), 16)).collect()
    assert [r[0] for r in got] == own(["Red house red", None, ""]).tolist()
    with pytest.raises(Exception, match="dimensions"):
        models.embed(df, own, 8, "t", "v").collect()
    calls = []
    assert models.once("m", lambda: calls.append(1) or 5) == models.once("m", lambda: calls.append(1) or 5) == 5 and len(calls) == 1


def test_gold(spark, tmp_path):
    path = tmp_path / "g.yaml"
    path.write_text("- {id: a, query: q, intent: vibe, acceptable: [{film_id: f, t_start: 1, t_end: 2}]}\n- {id: b, query: r}\n")
    rows = gold.read_gold(spark, path).collect()
    assert rows[0]["acceptable"][0]["t_end"] == 2.0 and rows[1]["acceptable"] is None
    path.write_text("")
    assert gold.read_gold(spark, path).collect() == []


def test_streaming_upsert_and_sessions(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v int").schema
    table = Table(spark, str(tmp_path), "t", schema, "k").create()
    source = str(tmp_path / "in")
    for rows in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.into_table(incremental.files(spark, source, schema), table, str(tmp_path / "check")).awaitTermination(60)
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 3), ("c", 4)]
    events = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 00:29:59'), (1, timestamp'2024-01-01 01:00:00') AS t(user_id, ts)")
    assert sorted(r["n"] for r in incremental.sessions(events).collect()) == [1, 2]


def test_boards(spark):
    log = spark.createDataFrame([("q", ["a", "b"], "b", 1.0), ("q", ["a"], None, 2.0)], boards.LOG)
    assert {r["unit_id"]: (r["shown"], r["chosen"], r["rate"]) for r in boards.click_rates(log).collect()} == {"a": (2, 0, 0.0), "b": (1, 1, 1.0)}
    assert tuple(boards.chosen_ranks(log).first()) == (2, 1)
    saved = spark.createDataFrame([("x", "a", 1.0, None), ("x", "gone", 2.0, None)], boards.BOARD)
    assert boards.contents(saved, spark.createDataFrame([("a", "cap")], "unit_id string, caption string")).count() == 2


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    path = settings(tmp_path)
    film = tmp_path / "films" / "Four.mkv"
    film.write_bytes(b"abcde")
    own = engine(spark, tmp_path)
    assert cli.main(["--config", str(path), "ingest", str(film)], lambda c: own) == 0
    queries = tmp_path / "gold.yaml"
    queries.write_text("- {id: a, query: q, intent: vibe, acceptable: [{film_id: REPLACE_WITH_FILM_ID, t_start: 1, t_end: 2}]}\n")
    assert cli.main(["--config", str(path), "eval", "--queries", str(queries)], lambda c: own) == 0
    assert "evaluated 0, skipped 1, hit@5 not available" in capsys.readouterr().out
    assert cli.main(["--config", str(path), "eval", "--queries", str(tmp_path / "none")], lambda c: own) == 1
    monkeypatch.setattr(doctor, "checks", lambda a=None: [("java", True, "x"), ("ffmpeg", False, "not found"), ("later", True, "")])
    assert cli.main(["doctor"]) == 1 and "later" not in capsys.readouterr().out
    assert any(name == "assets" and passed for name, passed, _ in __import__("importlib").reload(doctor).checks(str(tmp_path / "new")))
