import math
import random

import pytest
from pyspark.sql import functions as F

from shotloom.operators import media, shots


def sequential(spans, flash, longest, short, film="f"):
    """The rule read one shot after another: (id, start, end, parent, keyframes)."""
    kept = []
    for a, e in spans:
        if kept and e - a < flash:
            kept[-1][1] = e
        else:
            kept.append([a, e])
    out, slot = [], 0
    frames = lambda a, e: [a + (e - a) / 2] if e - a < short else [a + (e - a) * q for q in (0.25, 0.5, 0.75)]
    for a, e in kept:
        name = f"{film}_{slot:04d}"
        slot += 1
        if e - a > longest:
            n = math.ceil((e - a) / longest)
            step = (e - a) / n
            for k in range(n):
                x, y = a + k * step, e if k == n - 1 else a + (k + 1) * step
                out.append((f"{film}_{slot:04d}", x, y, name, frames(x, y)))
                slot += 1
        else:
            out.append((name, a, e, None, frames(a, e)))
    return out


def run(spark, spans, flash=0.5, longest=20.0, short=2.0, film="f"):
    df = spark.createDataFrame([(film, k, float(a), float(e)) for k, (a, e) in enumerate(spans)], "film_id string, pos int, t_start double, t_end double")
    rows = shots.segment(shots.flash_merge(df, flash), longest, short).orderBy("shot_id").collect()
    return [(r["shot_id"], r["t_start"], r["t_end"], r["parent_shot_id"], list(r["keyframe_times"])) for r in rows]


def merged(spark, spans, flash=0.5):
    df = spark.createDataFrame([("f", k, float(a), float(e)) for k, (a, e) in enumerate(spans)], "film_id string, pos int, t_start double, t_end double")
    return [(r["t_start"], r["t_end"]) for r in shots.flash_merge(df, flash).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("spans", "want"),
    [
        ([(0, 5), (5, 10)], [(0, 5), (5, 10)]),
        ([(0, 5), (5, 5.3), (5.3, 10)], [(0, 5.3), (5.3, 10)]),
        ([(0, 5), (5, 5.5), (5.5, 10)], [(0, 5), (5, 5.5), (5.5, 10)]),
        ([(0, 0.3), (0.3, 5)], [(0, 0.3), (0.3, 5)]),
        ([(0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 5)], [(0, 0.7), (0.7, 5)]),
        ([], []),
    ],
)
def test_flash_merge(spark, spans, want):
    assert merged(spark, spans) == want


@pytest.mark.parametrize(("span", "want"), [((0, 30), [(0, 15), (15, 30)]), ((0, 40), [(0, 20), (20, 40)]), ((0, 20), [(0, 20)])])
def test_equal_split(spark, span, want):
    rows = run(spark, [span])
    assert [(a, e) for _, a, e, _, _ in rows] == want
    assert all((p == "f_0000") == (len(want) > 1) for *_, p, _ in rows)
    assert [r[0] for r in rows] == (["f_0001", "f_0002"] if len(want) > 1 else ["f_0000"])


def test_split_is_contiguous(spark):
    rows = run(spark, [(5, 75)])
    assert rows[0][1] == 5 and rows[-1][2] == 75 and all(x[2] == y[1] for x, y in zip(rows, rows[1:]))


@pytest.mark.parametrize(("span", "want"), [((0, 1), [0.5]), ((0, 2), [0.5, 1.0, 1.5]), ((10, 20), [12.5, 15.0, 17.5]), ((5, 5.5), [5.25])])
def test_keyframes(spark, span, want):
    assert run(spark, [span], flash=0.1)[0][4] == want


def test_windows_equal_the_sequential_rule(spark):
    rng = random.Random(4)
    films, rows = {}, []
    for f in range(30):
        t, spans = 0.0, []
        for _ in range(rng.randrange(1, 30)):
            d = rng.choice([0.1, 0.3, 0.5, 2.0, 20.0, 40.0, rng.uniform(0.01, 60)])
            spans.append((t, t + d))
            t += d
        films[f"film{f}"] = spans
        rows += [(f"film{f}", k, a, e) for k, (a, e) in enumerate(spans)]
    df = spark.createDataFrame(rows, "film_id string, pos int, t_start double, t_end double")
    got = {}
    for r in shots.segment(shots.flash_merge(df), 20.0, 2.0).collect():
        got.setdefault(r["film_id"], []).append((r["shot_id"], r["t_start"], r["t_end"], r["parent_shot_id"], list(r["keyframe_times"])))
    assert {f: sorted(v) for f, v in got.items()} == {f: sorted(sequential(s, 0.5, 20.0, 2.0, f)) for f, s in films.items()}


def test_frames_to_time(spark):
    cuts = spark.createDataFrame([("f", 0, 0, 99), ("f", 1, 100, 99), ("f", 2, 100, 400)], "film_id string, pos int, start_frame int, end_frame int")
    films = spark.createDataFrame([("f", 10.0, 30.0)], "film_id string, fps double, duration double")
    rows = shots.frame_to_time(cuts, F.lit(10.0), F.lit(30.0)).orderBy("pos").collect()
    assert [(r["t_start"], r["t_end"]) for r in rows] == [(0.0, 10.0), (10.0, 30.0)]
    made = shots.from_cuts(cuts, films).collect()
    assert len(made) == 2 and all(r["parent_shot_id"] is None for r in made)


def test_ids_grow_beyond_four_digits(spark):
    assert spark.range(1).select(F.format_string("%s_%04d", F.lit("f"), F.lit(12345))).first()[0] == "f_12345"


def test_cut_runs(spark):
    frames = spark.createDataFrame([("f", k, p) for k, p in enumerate([0.1, 0.9, 0.1, 0.1, 0.8, 0.7])], "film_id string, frame int, p double")
    assert [(r["start_frame"], r["end_frame"]) for r in shots.cut_runs(frames).orderBy("pos").collect()] == [(0, 1), (2, 4), (5, 5)]


def test_media_plan(spark):
    rows = [("f", "f_0000", 0.0, 1.0, [0.02]), ("f", "f_0001", 0.0, 30.0, [7.5, 15.0, 22.5]), ("f", "f_0002", 10.0, 12.0, [10.5])]
    df = spark.createDataFrame(rows, "film_id string, shot_id string, t_start double, t_end double, keyframe_times array<double>")
    seeks = {(r["shot_id"], r["n"]): r["seek"] for r in media.keyframe_plan(df).collect()}
    assert seeks[("f_0000", 0)] == 0.1 and seeks[("f_0001", 1)] == 15.0 and len(seeks) == 5
    bounds = {r["shot_id"]: (r["preview_seek"], r["preview_dur"]) for r in df.withColumns(media.preview_bounds(F.col("t_start"), F.col("t_end"))).collect()}
    assert bounds == {"f_0000": (0.0, 1.0), "f_0001": (13.0, 4.0), "f_0002": (10.0, 2.0)}
    assert media.keyframe_plan(df.limit(0)).collect() == []
    line = media.commands(media.keyframe_plan(df).withColumn("path", F.lit("/a.mkv")), "path", F.lit("/assets/f")).where("shot_id = 'f_0001' and n = 2").first()["command"]
    assert line[0] == "ffmpeg" and line.index("-ss") < line.index("-i") and line[-1] == "/assets/f/keyframes/f_0001_2.webp"
    clip = df.select("shot_id", media.clip_bounds(F.col("t_start"), F.col("t_end"), F.lit(30.0)).alias("c"), media.inward_bounds(F.col("t_start"), F.col("t_end"), F.lit(24.0)).alias("i")).where("shot_id = 'f_0001'").first()
    assert tuple(clip["c"]) == (0.0, 30.0) and tuple(clip["i"]) == (0.125, 29.875)


def test_content_splits_and_merges(spark):
    v = {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    seconds = spark.createDataFrame([("s", k, v[x]) for k, x in enumerate("aabba")], "shot_id string, second int, vec array<double>")
    assert [(r["t_start"], r["t_end"]) for r in shots.split_by_content(seconds).orderBy("part").collect()] == [(0, 2), (2, 4), (4, 5)]
    near = spark.createDataFrame([("f", 0, 0.0, 5.0, v["a"]), ("f", 1, 5.2, 6.0, v["a"]), ("f", 2, 6.0, 9.0, v["b"])], "film_id string, pos int, t_start double, t_end double, vec array<double>")
    assert [(r["t_start"], r["t_end"]) for r in shots.flash_merge_by_content(near).orderBy("pos").collect()] == [(0.0, 6.0), (6.0, 9.0)]
