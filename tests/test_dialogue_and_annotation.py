import pytest
from pyspark.sql import functions as F

from shotloom.functions import text as X
from shotloom.operators import annotate, dialogue
from shotloom.sources import subtitles

SIMPLE = "1\n00:00:01,000 --> 00:00:03,500\nHello world\n\n2\n00:00:05,000 --> 00:00:07,000\nFoo bar\nbaz\n"


def parse(spark, srt):
    rows = dialogue.parse_srt(spark.createDataFrame([("f", srt)], "film_id string, srt string")).orderBy("pos").collect()
    return [(r["start"], r["end"], r["text"]) for r in rows]


@pytest.mark.parametrize(
    ("srt", "want"),
    [
        (SIMPLE, [(1.0, 3.5, "Hello world"), (5.0, 7.0, "Foo bar baz")]),
        (SIMPLE.replace("\n", "\r\n"), [(1.0, 3.5, "Hello world"), (5.0, 7.0, "Foo bar baz")]),
        ("1\n00:00:01,000 --> 00:00:02,000\n<i>Italic text</i>\n\n2\n00:00:03,000 --> 00:00:04,000\n<b>Bold</b> and <font color=\"red\">red</font>", [(1.0, 2.0, "Italic text"), (3.0, 4.0, "Bold and red")]),
        ("1\n00:00:01,000 --> 00:00:02,000\nHello &amp; world\n\n2\n00:00:03,000 --> 00:00:04,000\n&lt;not a tag&gt;", [(1.0, 2.0, "Hello & world"), (3.0, 4.0, "<not a tag>")]),
        ("no time here\n\n\n2\n01:02:03,456 --> 01:02:04,000 X1:0\nlast\n\n3\n00:00:01,000 --> 00:00:02,000\n<i></i>\n\n4\n0:00:01,000 --> 00:00:02,000\nbad", [(3723.456, 3724.0, "last")]),
        ("", []),
    ],
)
def test_srt(spark, srt, want):
    assert parse(spark, srt) == want


def test_timestamps(spark):
    rows = spark.createDataFrame([("00:00:00,000",), ("00:00:01,500",), ("01:02:03,456",), ("1:2:3,4",), ("00:00:01.500",)], "t string")
    assert [r[0] for r in rows.select(X.srt_seconds(F.col("t"))).collect()] == [0.0, 1.5, 3723.456, None, None]


def test_overlap_and_searchable_text(spark):
    lines = spark.createDataFrame([("f", k, float(a), float(e), t) for k, (a, e, t) in enumerate([(12, 15, "in"), (8, 11, "early"), (19, 22, "late"), (2, 9, "before"), (21, 25, "after"), (9, 10, "touch"), (0, 99, "spans")])], subtitles.LINES)
    shots = spark.createDataFrame([("f", "s1", 10.0, 20.0), ("f", "s2", 200.0, 210.0), ("g", "s3", 10.0, 20.0)], "film_id string, shot_id string, t_start double, t_end double")
    for bucket in (None, 7.0):
        got = {r["shot_id"]: r["dialogue"] for r in dialogue.overlap(shots, lines, bucket).collect()}
        assert got == {"s1": ["in", "early", "late", "spans"], "s2": [], "s3": []}
    plan = dialogue.overlap(shots, lines)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    text = dialogue.overlap(shots, lines).select("shot_id", X.searchable(F.lit("A caption"), F.col("dialogue")).alias("t"))
    assert {r["shot_id"]: r["t"] for r in text.collect()} == {"s1": "A caption in early late spans", "s2": "A caption", "s3": "A caption"}


@pytest.mark.parametrize(
    ("raw", "caption", "mood"),
    [
        ("A dark and stormy shot.\nMood: dark, stormy, dramatic", "A dark and stormy shot.", ["dark", "stormy", "dramatic"]),
        ("One line.\n\n  Two line.  \nMood:  happy ,  bright ,  light ", "One line. Two line.", ["happy", "bright", "light"]),
        ("No mood here", "No mood here", []),
        ("Mood: a\nText\nMood: b, ,c\nmood: kept", "Text mood: kept", ["b", "c"]),
        ("", "", []),
        (None, "", []),
    ],
)
def test_caption_and_mood(spark, raw, caption, mood):
    row = spark.createDataFrame([(raw,)], "raw string").select(X.caption_and_mood(F.col("raw")).alias("x")).first()["x"]
    assert (row["caption"], row["mood"]) == (caption, mood)


def test_failed_calls_are_rows(spark):
    def captioner(images, said):
        if not images:
            raise RuntimeError("no image")
        return f"{len(images)} images, {len(said)} lines\nMood: calm"

    df = spark.createDataFrame([("a", ["1", "2", "3", "4"], ["x"]), ("b", [], ["y"])], "shot_id string, keyframe_paths array<string>, dialogue array<string>")
    got = {r["shot_id"]: r for r in annotate.parse(annotate.call(df, captioner)).collect()}
    assert (got["a"]["caption"], got["a"]["mood"], got["a"]["searchable_text"]) == ("3 images, 1 lines", ["calm"], "3 images, 1 lines x")
    assert (got["b"]["caption"], got["b"]["mood"], got["b"]["searchable_text"]) == ("", [], "") and "no image" in got["b"]["annotation_error"]
    asked = annotate.requests(df).where("shot_id = 'a'").first()
    assert len(asked["images"]) == 3 and asked["media_types"] == ["image/jpeg"] * 3


def test_structured_annotation(spark):
    df = spark.createDataFrame([('{"caption": "c", "is_bw": true, "mood": ["m"]}',), ("not json",)], "raw string")
    rows = [r["annotation"] for r in annotate.parse_structured(df).collect()]
    assert rows[0]["is_bw"] is True and rows[0]["mood"] == ["m"] and rows[1]["caption"] is None


def test_lines_of_films_by_route_and_json_round_trip(spark, tmp_path):
    films = spark.createDataFrame([("a", "/a.mkv", True), ("b", "/b.mkv", False)], "film_id string, path string, has_embedded_subs boolean")
    got = subtitles.lines(films, lambda p: SIMPLE, lambda p: [(0.0, 1.0, "  Hello whisper "), (1.0, 2.0, "  "), (2.0, 3.0, "again")]).orderBy("film_id", "pos")
    assert [(r["film_id"], r["text"]) for r in got.collect()] == [("a", "Hello world"), ("a", "Foo bar baz"), ("b", "Hello whisper"), ("b", "again")]
    subtitles.write_json(got, str(tmp_path / "lines"))
    assert sorted(map(tuple, subtitles.read_json(spark, str(tmp_path / "lines")).select("film_id", "pos", "start", "end", "text").collect())) == sorted(map(tuple, got.collect()))
    (tmp_path / "srt").mkdir()
    (tmp_path / "srt" / "my.film.srt").write_text(SIMPLE)
    read = subtitles.read_srt(spark, str(tmp_path / "srt"))
    assert read.first()["film_id"] == "my.film" and dialogue.parse_srt(read).count() == 2


def test_json_of_many_films_is_few_files(spark, tmp_path):
    lines = spark.range(900).selectExpr("CASE WHEN id % 300 > 1 THEN CAST(id % 300 AS STRING) WHEN id % 300 = 1 THEN '' END AS film_id", "CAST(id / 300 AS INT) AS pos", "0.5D AS start", "id / 7 AS end", "concat('l', id) AS text")
    subtitles.write_json(lines, str(tmp_path / "lines"))
    assert len(list((tmp_path / "lines").rglob("*.json"))) <= 8  # 300 and more when each film had a folder
    read = subtitles.read_json(spark, str(tmp_path / "lines")).select(*lines.columns).collect()
    assert sorted(map(repr, map(tuple, read))) == sorted(map(repr, map(tuple, lines.collect())))


def test_labels(spark):
    row = spark.range(1).select(X.time_label(F.lit(59.9)), X.time_label(F.lit(3661)), X.elapsed_label(F.lit(-3)), X.elapsed_label(F.lit(125.5)), X.film_label(F.lit("yi_yi-McQueen")), X.strip(F.lit("  x\t"))).first()
    assert tuple(row) == ("0:59", "1:01:01", "0s", "2m 5s", "Yi Yi McQueen", "x")
