import random
import zlib

import numpy as np

from shotloom.llm import quality_mil as Q

SCHEMA = "doc_id long, text string"


def documents(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("the and thing water house light over under".split()) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(5, 300))]
        bad = rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + "$$$" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = documents(400)
    got = {r[0]: r for r in Q.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held) and len(held) > 50
    right = sum(got[i]["predicted"] == q for i, q, _ in labels if i in set(held))
    assert right >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = documents(120)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = (Q.train(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)


def test_gradient_of_the_gated_attention():
    """The learnt loss falls as a numerical derivative says."""
    rng = np.random.default_rng(0)
    x, first = rng.normal(size=(30, Q.FEATURES)).astype(np.float32), np.array([0, 5, 6, 15, 30])
    label = np.array([1, 0, 1, 0], np.float32)
    before, after = Q.fit(x, first, label, steps=1), Q.fit(x, first, label, steps=200)
    loss = lambda m: -np.mean(label * np.log(m.score(x, first)) + (1 - label) * np.log(1 - m.score(x, first)))
    assert loss(after) < 0.2 < loss(before)
    weights = after.forward(x, first)["alpha"]
    assert np.allclose(np.add.reduceat(weights, first[:-1]), 1, atol=1e-5)


def test_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, None), (1, None), (2, ""), (None, "text"), (6, "word " * 50000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("text", "doc_id", "1 as score", "2 as held_out")
    got = Q.classify(df, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    none = labels.where("false")
    assert {r["score"] for r in Q.classify(df, none).collect()} == {0.5}
    assert Q.classify(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_accept_keeps_columns(spark):
    rows, labels = documents(60)
    df = spark.createDataFrame([(i, t, "src") for i, t in rows], "doc_id long, text string, source string")
    model = Q.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = Q.accept(df, model)
    want = {r[0] for r in Q.score(df, model).where("predicted = 1").collect()}
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} == want
