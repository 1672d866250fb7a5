import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.functions import vectors as V
from shotloom.operators import evaluation, fusion, lexical, lexical_index, pooling, router, scenes, search, vector_index

UNITS = "unit_id string, film_id string, txt_vec array<float>, is_representative boolean, label int"


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(2)
    rows = [(f"u{k:03d}", f"f{k % 5}", rng.normal(size=16).astype(np.float32).tolist() if k else [0.0] * 16, k % 7 != 0, k % 3) for k in range(200)]
    return spark.createDataFrame(rows, UNITS).repartition(4).cache()


def nearest(units, query, k):
    rows = []
    for r in units.collect():
        v = np.array(r["txt_vec"], float)
        if np.linalg.norm(v):
            rows.append((round(1 - float(v @ query / np.linalg.norm(v) / np.linalg.norm(query)), 6), r["unit_id"]))
    return [i for _, i in sorted(rows)[:k]]


def test_top_k_is_exact_and_plans_a_partial_top(spark, units):
    query = np.arange(16) - 5.0
    found = search.top_k(search.filtered(units), query.tolist(), 10)
    assert [r["unit_id"] for r in found.orderBy("rank").collect()] == nearest(units.where("is_representative"), query, 10)
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()


def test_batch_equals_single(spark, units):
    rng = np.random.default_rng(3)
    queries = [(f"q{k}", rng.normal(size=16).tolist()) for k in range(5)] + [("zero", [0.0] * 16), ("null", None)]
    got = search.top_k_batch(units, spark.createDataFrame(queries, "query_id string, query_vec array<double>"), 7).collect()
    for q, v in queries[:5]:
        assert [r["unit_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == nearest(units, np.array(v), 7)
    assert {r["query_id"] for r in got} == {q for q, _ in queries[:5]}


def test_filters_come_before_the_ranking(spark, units):
    query = np.ones(16)
    want = nearest(units.where("is_representative and label = 1 and film_id in ('f1', 'f2')"), query, 5)
    got = search.top_k(search.filtered(units, {"label": 1, "film_id": ["f1", "f2"], "time": None}), query.tolist(), 5)
    assert [r["unit_id"] for r in got.orderBy("rank").collect()] == want


def test_more_like_this_leaves_itself_out(spark, units):
    vector = np.array(units.where("unit_id = 'u007'").first()["txt_vec"], float)
    want = nearest(units.where("unit_id <> 'u007'"), vector, 5)
    assert [r["unit_id"] for r in search.like_unit(units, "u007", 5, "txt_vec").orderBy("rank").collect()] == want
    assert search.like_unit(units, "absent", 5, "txt_vec").count() == 0


@pytest.mark.parametrize("kind, spill", [("clusters", 1), ("noise", 3)])
def test_product_index(spark, tmp_path, kind, spill):
    """Recall of at least 0.9 of the ten nearest from a quarter of the lists, whose partitions alone are read; ties and equal units included."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) if kind == "clusters" else np.zeros((12, 16))
    rows = [(f"u{k:04d}", (centres[k % 12] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(1200)]
    rows += [("copy", rows[0][1]), ("zero", [0.0] * 16), ("none", None)]
    units = spark.createDataFrame(rows, "unit_id string, txt_vec array<float>").repartition(5)
    asked = spark.createDataFrame([(k, rows[k][1]) for k in range(0, 1200, 40)] + [(5000, [0.0] * 16)], "query_id long, query_vec array<float>")
    index = vector_index.ProductIndex.fit(units, lists=16, subspaces=4, codes=64, spill=spill)
    index.write(units, str(tmp_path))
    found = index.search(spark, str(tmp_path), asked, 10, probes=4, rerank=150)
    got, exact = ({(r["query_id"], r["unit_id"]): r["distance"] for r in df.collect()} for df in (found, search.top_k_batch(units, asked, 10)))
    assert len(exact) == 300 and len(set(got) & set(exact)) >= 270
    assert all(abs(got[x] - exact[x]) < 2e-6 for x in set(got) & set(exact)) and (0, "copy") in got and not any(u in ("zero", "none") for _, u in got)
    one = index.search(spark, str(tmp_path), asked.limit(1), 10, probes=4)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "list#" in plan and "IN" in plan
    stored = spark.read.parquet(str(tmp_path / "codes"))
    assert stored.selectExpr("sum(size(ids))").first()[0] == 1201 * spill and stored.selectExpr("max(length(codes) / size(ids))").first()[0] == 4


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [[round(x, 6) for x in r[0]] for r in df.select(V.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in df.select(V.cosine(F.col("v"), V.literal([6, 8]))).collect()] == [1.0, None]


def test_pooling(spark):
    df = spark.createDataFrame([("s", [1.0, 0.0]), ("s", [0.0, 1.0]), ("z", [0.0, 0.0])], "shot_id string, vec array<float>")
    got = {r["shot_id"]: [round(x, 6) for x in r["img_vec"]] for r in pooling.shot_vector(df, "shot_id").collect()}
    assert got == {"s": [0.707107, 0.707107], "z": [0.0, 0.0]}
    with pytest.raises(Exception, match="no keyframes"):
        spark.range(1).select(pooling.require_frames(F.array().cast("array<double>"))).collect()


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "Red house, red door"), (2, "blue house"), (3, None), (4, "green")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "RED red house")], "query_id long, query string")
    got = lexical.bm25(docs, queries).orderBy("rank").collect()
    n, mean = 4, 7 / 4
    weight = lambda tf, df, size: np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, round(weight(2, 1, 4) + weight(1, 2, 4), 6)), (2, round(weight(1, 2, 2), 6))]


def test_bm25_reads_the_corpus_once_and_joins_many_terms_alike(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    queries = spark.createDataFrame([(1, "a bb c"), (2, "h zz"), (3, ""), (4, None)], "query_id long, query string")
    found = lexical.bm25(docs, queries, None)
    got = sorted(map(tuple, found.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
    assert {r[0] for r in got} == {1, 2}
    monkeypatch.setattr(lexical, "TERMS", 1)
    assert sorted(map(tuple, lexical.bm25(docs, queries, None).collect())) == got
    assert lexical.bm25(docs.where("doc_id < 0"), queries).collect() == []


def test_bm25_of_few_queries_keeps_the_best_in_each_task(spark, tmp_path, monkeypatch):
    """No row for each pair of query and document is shuffled or summed up by the engine; ties, ids of any type and ids that occur twice give the same."""
    rng = random.Random(4)
    rows = [(f"d{k:03d}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for k in range(400)] + [("none", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    queries = spark.createDataFrame([(1, "a b c"), (2, "h zz"), (3, ""), (4, None), (5, "a"), (6, "qq")], "query_id int, query string")
    ranked = lambda docs, k: sorted(map(tuple, lexical.bm25(docs, queries, k).collect()))
    for own in (docs, docs.unionByName(docs.where("doc_id < 'd050'"))):
        every = ranked(own, None)
        for cells in (1 << 21, 60):
            monkeypatch.setattr(lexical, "CELLS", cells)
            assert ranked(own, 7) == [r for r in every if r[3] <= 7]
    found = lexical.bm25(docs, queries, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") <= 1
    assert ranked(docs.where("false"), 7) == []


def test_fusion_and_prior(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, unit_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, unit_id string, rank int")
    got = {r["unit_id"]: r["score"] for r in fusion.fuse({"a": a, "b": b}, {"a": 0.4, "b": 0.2}).collect()}
    assert got == {"x": 0.4 / 61, "y": 0.4 / 62 + 0.2 / 61}
    assert spark.range(1).select(fusion.prior(d=(0.05, F.lit(1.0)), m=(0.1, F.lit(None).cast("double")))).first()[0] == 1.05


def test_diversify_equals_the_greedy_pass(spark):
    rng = random.Random(5)
    rows = [(1, k, f"f{s // 4}", f"s{s}", k + 1) for k, s in enumerate(rng.randrange(40) for _ in range(300))]
    scenes_, films, want = {}, {}, []
    for _, unit, film, scene, rank in rows:
        if scenes_.get(scene, 0) < 2 and films.get(film, 0) < 4 and len(want) < 30:
            scenes_[scene] = scenes_.get(scene, 0) + 1
            films[film] = films.get(film, 0) + 1
            want.append(unit)
    df = spark.createDataFrame(rows, "query_id int, unit_id int, film_id string, scene_id string, rank int")
    assert [r["unit_id"] for r in fusion.diversify(df).orderBy("place").collect()] == want


def test_router_falls_back(spark):
    df = spark.createDataFrame([("quiet night", None), ("x", "not json"), ("y", '{"intent": "vibe", "lex": 0.5}'), ("z", '{"intent": "odd"}')], "query string, route string")
    got = {r["query"]: r for r in router.parse(df).collect()}
    assert [got[q]["intent"] for q in ("quiet night", "x", "y", "z")] == ["hybrid", "hybrid", "vibe", "hybrid"]
    assert got["y"]["weights"]["lex"] == 0.5 and got["y"]["weights"]["img"] == 0.4 and got["x"]["rewrites"] == ["x"]
    ruled = router.parse(spark.createDataFrame([("a quiet night in black and white",)], "query string").withColumn("route", router.by_rules(F.col("query")))).first()
    assert ruled["filters"]["time_of_day"] == "night" and ruled["filters"]["is_bw"] is True


@pytest.mark.parametrize(
    ("result", "hit"),
    [(("film_abc", 100.0, 120.0), True), (("film_abc", 97.0, 124.0), True), (("film_xyz", 100.0, 120.0), False), (("film_abc", 90.0, 120.0), False), (("film_abc", 100.0, 130.0), False), (("film_abc", 95.0, 125.0), True), (("film_abc", 110.0, 111.0), True)],
)
def test_hits(spark, result, hit):
    row = spark.createDataFrame([(*result, [("film_abc", 100.0, 120.0)])], "film_id string, t_start double, t_end double, acceptable array<struct<film_id:string,t_start:double,t_end:double>>")
    assert row.select(evaluation.is_hit(F.col("film_id"), F.col("t_start"), F.col("t_end"), F.col("acceptable"))).first()[0] is hit


def test_metrics(spark):
    kind = "id string, query string, intent string, acceptable array<struct<film_id:string,t_start:double,t_end:double>>"
    fake = [(evaluation.PLACEHOLDER, 0.0, 1.0)]
    gold = spark.createDataFrame([("a", "q", "vibe", [("f", 100.0, 120.0)]), ("b", "q", "plot", [("f", 500.0, 520.0)]), ("c", "q", "plot", fake), ("d", "q", None, []), ("e", "q", "vibe", None)], kind)
    found = spark.createDataFrame([("a", k, "f", 100.0 if k == 6 else 900.0, 120.0 if k == 6 else 910.0) for k in range(1, 11)], "id string, rank int, film_id string, t_start double, t_end double")
    assert tuple(evaluation.metrics(gold, found).first()) == (2, 3, 0.0, 0.5, 1 / 12)
    assert evaluation.metrics(gold, found, k5=6).first()["hit@5"] == 0.5
    assert tuple(evaluation.metrics(gold.where("id = 'c'"), found).first()) == (0, 1, None, None, None)
    by = {r["intent"]: (r["evaluated"], r["hit@10"]) for r in evaluation.by_intent(gold, found).collect()}
    assert by == {"vibe": (1, 1.0), "plot": (1, 0.0), None: (2, 0.5)}


def test_capped_scenes_equal_the_loop(spark):
    rng = random.Random(8)
    rows, want = [], []
    for film in ("a", "b"):
        t, scene, since = 0.0, -1, 0.0
        for pos in range(60):
            d, linked = rng.uniform(5, 90), rng.random() < 0.8
            if scene >= 0 and linked and t + d - since <= 300:
                pass
            else:
                scene, since = scene + 1, t
            rows.append((film, pos, t, t + d, linked))
            want.append((film, pos, scene))
            t += d
    df = spark.createDataFrame(rows, "film_id string, pos int, t_start double, t_end double, linked boolean")
    assert sorted(map(tuple, scenes.group(df).collect())) == sorted(want)


def test_takes_in_blocks_equal_those_at_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, "f", "s", [float(y) for y in rng.normal(size=3)], 0.0, float(k % 7)) for k in range(150)]
    df = spark.createDataFrame(rows, "unit_id long, film_id string, scene_id string, vec array<float>, t_start double, t_end double")
    whole = sorted(map(tuple, scenes.cluster(df, 0.02).collect()))
    near = lambda a, b: 1 - np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) <= 0.02
    close = [[j for j in range(150) if near(rows[i][3], rows[j][3])] for i in range(150)]
    label = list(range(150))
    while (new := [min(label[j] for j in close[i]) for i in range(150)]) != label:
        label = new
    assert [r[3] for r in whole] == label and len(set(label)) > 3
    monkeypatch.setattr(scenes, "BLOCK", 7)
    assert sorted(map(tuple, scenes.cluster(df, 0.02).collect())) == whole


def test_takes_and_scores(spark):
    v = lambda *x: [float(y) for y in x]
    rows = [("a", "f", "s", v(1, 0), 0.0, 5.0), ("b", "f", "s", v(1, 0.1), 5.0, 12.0), ("c", "f", "s", v(1, 0.55), 12.0, 19.0), ("d", "f", "s", v(0, 1), 19.0, 20.0), ("e", "f", "t", v(1, 0), 20.0, 21.0), ("z", "f", "t", v(0, 0), 21.0, 22.0)]
    df = spark.createDataFrame(rows, "unit_id string, film_id string, scene_id string, vec array<float>, t_start double, t_end double")
    got = {r["unit_id"]: (r["cluster_id"], r["is_representative"]) for r in scenes.cluster(df).collect()}
    assert got == {"a": ("a", False), "b": ("a", True), "c": ("a", False), "d": ("d", True), "e": ("e", True), "z": ("z", True)}
    assert {tuple(r)[:2] for r in scenes.other_takes(scenes.cluster(df)).collect()} == {("b", "a"), ("b", "c")}
    scored = scenes.scores(df.withColumn("d", F.col("t_end") - F.col("t_start")), duration="d")
    assert {r["unit_id"]: r["duration_score"] for r in scored.collect()}["d"] == 0.0


def test_motion(spark):
    flows = spark.createDataFrame([("s", k, 1.0, 0.0) for k in range(4)] + [("s", k, 1.0, 0.0) for k in range(4)], "shot_id string, frame int, dx double, dy double")
    row = scenes.motion(flows).first()
    assert row["flow_mean"] == 1.0 and row["global_ratio"] == 1.0 and row["shakiness"] == 0.0 and sum(row["direction_histogram"]) == 8


def test_more_queries_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    units = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(60, 5)))], "unit_id long, txt_vec array<double>")
    asked = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(11, 5)))], "query_id long, query_vec array<double>").repartition(3)
    whole = search.top_k_batch(units, asked, 4).collect()
    monkeypatch.setattr(search, "BATCH", 3)
    assert sorted(search.top_k_batch(units, asked, 4).collect()) == sorted(whole) and len(whole) == 44


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_and_slots_equal_a_plain_search(spark, monkeypatch, kind):
    """Ties, equal vectors, zero and null vectors, with queries and units in several blocks and slots."""
    rng = np.random.default_rng(9)
    vectors = rng.integers(-1, 2, (90, 3)).astype(float)
    name = (lambda k: k) if kind == "long" else (lambda k: f"u{k:03d}")
    units = [(name(k), None if k % 17 == 3 else v.tolist()) for k, v in enumerate(vectors)]
    asked = [(name(k), [0.0, 0.0, 0.0] if k == 5 else v.tolist()) for k, v in enumerate(rng.integers(-1, 2, (20, 3)).astype(float))] + [(name(99), None)]
    want = []
    for q, v in asked:
        near = []
        for u, w in units:
            if v is not None and w is not None and any(v) and any(w):
                near.append((round(1 - float(np.dot(np.array(w) / np.linalg.norm(w), np.array(v) / np.linalg.norm(v))), 6) + 0.0, u))
        want += [(q, u, d, k + 1) for k, (d, u) in enumerate(sorted(near)[:7])]
    frames = spark.createDataFrame(units, f"unit_id {kind}, txt_vec array<float>").repartition(4), spark.createDataFrame(asked, f"query_id {kind}, query_vec array<double>")
    for batch, slot in ((4096, 1 << 20), (6, 1 << 20), (6, 20)):
        monkeypatch.setattr(search, "BATCH", batch)
        monkeypatch.setattr(search, "SLOT", slot)
        assert sorted(tuple(r) for r in search.top_k_batch(*frames, 7).collect()) == sorted(want)


def test_bootstrap_interval_equals_a_loop(spark):
    import hashlib

    rng = random.Random(3)
    rows = [(k, rng.choice(["vibe", "plot", None]), float(rng.random() < 0.4), float(rng.random() < 0.6)) for k in range(60)]
    got = {r["intent"]: tuple(r)[1:] for r in evaluation.bootstrap(spark.createDataFrame(rows, "id long, intent string, base double, other double").repartition(3), 100, 0.9).collect()}
    for intent in ("vibe", "plot", None):
        own = [r for r in rows if intent is None or r[1] == intent]
        means = []
        for b in range(100):
            w = [sum(int(hashlib.md5(f"{r[0]}:{b}".encode()).hexdigest()[:8], 16) / 2**32 >= p for p in evaluation.POISSON) for r in own]
            if sum(w):
                means.append(sum(x * (r[3] - r[2]) for x, r in zip(w, own)) / sum(w))
        means.sort()
        n, delta, low, high = got[intent]
        assert n == len(own) and abs(delta - sum(r[3] - r[2] for r in own) / len(own)) < 1e-9
        assert abs(low - means[4]) < 1e-9 and abs(high - means[94]) < 1e-9 and low <= delta <= high
    assert set(got) == {"vibe", "plot", None}


def test_lexical_index_equals_scoring_every_row(spark, tmp_path, monkeypatch):
    """Two segments of several shards and blocks; a merged index gives the same, and blocks that can't matter aren't decoded."""
    monkeypatch.setattr(lexical_index, "BLOCK", 8)
    monkeypatch.setattr(lexical_index, "SHARD", 150)
    rng = random.Random(4)
    words = ["the"] * 30 + ["of"] * 10 + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for k in range(600)] + [(1000, None), (1001, ""), (1002, "the the the the w5"), (1003, docs_ := "w1 w2 w3"), (1004, docs_)]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the w5"), (2, "W1, w2 w3"), (3, "the of the"), (4, "absent"), (5, None), (6, "w7 absent")], "query_id int, query string")
    index, merged = str(tmp_path / "index"), str(tmp_path / "merged")
    lexical_index.add(corpus.where("doc_id < 300"), index)
    lexical_index.add(corpus.where("doc_id >= 300"), index)
    lexical_index.merge(spark, index, merged)
    want = sorted(map(tuple, lexical.bm25(corpus, asked, 5).select("query_id", "doc_id", "score", "rank").collect()))
    assert len(want) >= 20
    for path in (index, merged):
        assert sorted(map(tuple, lexical_index.search(spark, path, asked, 5).collect())) == want
    blocks, decoded = lexical_index.scan(spark, merged, asked, 5).where("score is null and query_id in (1, 3)").agg(F.sum("blocks"), F.sum("decoded")).first()
    assert decoded < blocks


def test_lexical_index_sends_a_shards_blocks_once_for_many_queries(spark, tmp_path, monkeypatch):
    """A group for each query and shard (12,000 here) would take minutes; parts of queries and slices of a shard's tokens give the same rows."""
    monkeypatch.setattr(lexical_index, "SHARD", 50)
    monkeypatch.setattr(lexical_index, "BLOCK", 8)
    monkeypatch.setattr(lexical_index, "QUERIES", 150)
    monkeypatch.setattr(lexical_index, "TOKENS", 300)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    corpus = spark.createDataFrame([(k, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for k in range(2000)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(rng.sample(words, 12))) for q in range(300)], "query_id int, query string")
    index = str(tmp_path / "index")
    lexical_index.add(corpus, index)
    began = time.perf_counter()
    got = sorted(map(tuple, lexical_index.search(spark, index, asked, 5).collect()))
    assert time.perf_counter() - began < 30
    assert got == sorted(map(tuple, lexical.bm25(corpus, asked, 5).select("query_id", "doc_id", "score", "rank").collect()))


def test_links_by_keyframes_dialogue_and_sound(spark):
    v = {"a": [1.0, 0.0], "b": [0.95, 0.3], "c": [0.0, 1.0], "d": [0.6, 0.8]}
    rows = [("f", 0, ["a"], None, None, "a"), ("f", 1, ["a", "b"], None, None, "a"), ("f", 2, ["b", "c"], None, None, "c"), ("f", 3, ["d"], 10.0, 12.0, "c"), ("f", 4, ["c"], 14.0, 15.0, "a"), ("f", 5, ["a"], None, None, "a"), ("f", 6, [], 16.0, 17.0, "b")]
    df = spark.createDataFrame([(f, p, [v[x] for x in k], s, e, v[a]) for f, p, k, s, e, a in rows], "film_id string, pos int, vecs array<array<double>>, speech_start double, speech_end double, audio_vec array<double>")
    got = {r["pos"]: r["linked"] for r in scenes.links(df).collect()}
    # 1 looks alike; of 2 one pair of keyframes differs and sounds don't go on; 3 sounds alike and isn't far apart; 4 goes on talking; 5 sounds alike but is a silent cut; 6 has no keyframes but sounds alike
    assert got == {0: False, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True}
