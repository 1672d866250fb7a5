import random

import numpy as np
import pytest

from shotloom.operators import dialogue, intervals


def brute(left, right):
    return sorted((k, i, j) for k, a, b, i in left for l, c, d, j in right if k is not None and k == l and None not in (a, b, c, d) and a < d and c < b)


def intervals_of(rng, n, span, offset):
    rows = []
    for k in range(n):
        film = "long" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        a = rng.choice([float(rng.randrange(span)), rng.random() * span, 5.0])
        b = rng.choice([a + rng.random() * 3, a, a + rng.random() * span, a - rng.random() * 4, None if rng.random() < 0.05 else a + 1])
        rows.append((film, a, b, offset + k))
    return rows


@pytest.mark.parametrize("rows", [7, 40, 10**6])
def test_pairs_equal_all_pairs(spark, rows):
    rng = random.Random(rows)
    left, right = intervals_of(rng, 90, 60, 0), intervals_of(rng, 110, 60, 1000)
    schema = "film_id string, start double, end double, n long"
    got = intervals.pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), rows=rows).select("film_id", "left.n", "right.n").collect()
    assert sorted(map(tuple, got)) == brute(left, right)


def test_long_films_are_cut_evenly(spark):
    starts = spark.range(20_000).selectExpr("'f' AS film_id", "pow(id / 20000.0, 6) * 3600 AS start")  # most start early
    cuts = intervals.boundaries(starts, "film_id", "start", 1000).first()["cuts"]
    assert 10 <= len(cuts) <= 20 and cuts == sorted(cuts)
    s = np.sort(np.array([r["start"] for r in starts.collect()]))
    sizes = np.diff(np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]]))
    assert sizes.max() < 8000  # the first of 1,024 steps alone has about 6,300 starts
    assert intervals.boundaries(starts.limit(500), "film_id", "start", 1000).count() == 0
    same = spark.range(5000).selectExpr("'f' AS film_id", "1.0D AS start")
    assert intervals.boundaries(same, "film_id", "start", 1000).count() == 0


def test_dialogue_by_sweep_equals_the_join(spark):
    rng = random.Random(3)
    shots = spark.createDataFrame([(f"f{k % 2}", f"s{k:03d}", k * 2.0, k * 2.0 + 2.0) for k in range(120)], "film_id string, shot_id string, t_start double, t_end double")
    lines = spark.createDataFrame([(f"f{k % 2}", k, t := rng.randrange(240) * 1.0, t + rng.random() * 9, f"l{k}") for k in range(150)], "film_id string, pos int, start double, end double, text string")
    want = sorted(map(tuple, dialogue.overlap(shots, lines).select("shot_id", "dialogue").collect()))
    assert sorted(map(tuple, dialogue.overlap(shots, lines, rows=30).select("shot_id", "dialogue").collect())) == want


def test_empty(spark):
    none = spark.createDataFrame([], "film_id string, start double, end double, n long")
    assert intervals.pairs(none, none).collect() == []


@pytest.mark.parametrize("rows", [7, 40, 10**6])
def test_totals_equal_those_of_all_pairs(spark, rows):
    rng = random.Random(rows + 1)
    left, right = intervals_of(rng, 90, 60, 0), intervals_of(rng, 110, 60, 1000)
    left += [(k, a, b, i) for k, a, b, i in left[:5]]  # ids that occur twice add up
    want: dict = {}
    for k, i, j in brute(left, right):
        want.setdefault((k, i), []).append(j)
    schema = "film_id string, start double, end double, {} long"
    got = intervals.totals(spark.createDataFrame(left, schema.format("i")), spark.createDataFrame(right, schema.format("j")), "i", "j", rows=rows).collect()
    assert sorted(map(tuple, got)) == sorted((k, i, len(js), sum(js)) for (k, i), js in want.items())


def test_totals_make_no_pairs(spark):
    """3,000 by 3,000 intervals that all meet are 9,000,000 pairs; the sweep in Python had to make each."""
    left, right = (spark.range(3000).selectExpr("'f' AS film_id", "id / 1000 AS start", "id / 1000 + 100 AS end", f"id AS {n}") for n in ("i", "j"))
    found = intervals.totals(left, right, "i", "j", rows=100)
    plan = found._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "InPandas" not in plan and "Cartesian" not in plan
    assert [tuple(r) for r in found.selectExpr("count(*)", "min(n)", "max(n)", "min(total)", "max(total)").collect()] == [(3000, 3000, 3000, 4498500, 4498500)]
