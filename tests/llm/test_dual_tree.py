import hashlib
import math

import numpy as np
import pytest

from shotloom.llm import dual_tree as D


def lloyd(rows, k=8, size=64, rounds=10):
    """Plain Lloyd in Python's integers: (vec_id, cluster, distance, cluster_inertia, inertia, sha)."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    hashed = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in hashed[:k]]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    near = lambda v: min((apart(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds if centres else 0):
        own = [near(v)[1] for _, v in kept]
        centres = [[sum(col) // len(col) for col in zip(*group)] if (group := [v for (_, v), o in zip(kept, own) if o == j]) else c for j, c in enumerate(centres)]
    if not centres:
        return []
    found = [(i, *reversed(near(v))) for i, v in kept]
    part = {j: sum(d for _, o, d in found if o == j) for j in range(k)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, o, d, part[o], sum(part.values()), sha[o]) for i, o, d in found), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "'x' AS id", "1 AS cluster").repartition(3)
    return sorted((tuple(r) for r in D.cluster(df, **options).collect()), key=str)


def test_equals_plain_lloyd(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) + i % 5).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i + 300, rows[7][1]) for i in range(100)] + [(5, rows[9][1]), (None, rows[2][1]), (None, rows[7][1])]
    rows += [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [float("nan")] * 64), (904, [float("-inf")] * 64), (905, [0.0] * 64), (906, [])]
    assert run(spark, rows) == lloyd(rows)


def test_few_vectors_ties_and_empty_clusters(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(40)]  # many equal vectors and distances
    assert run(spark, grid, size=2) == lloyd(grid, size=2)
    assert run(spark, grid[:3], size=2) == lloyd(grid[:3], size=2)
    assert run(spark, [(1, [0.0, 1.0, 2.0])], size=2) == []
    assert D.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_out_of_range_vectors_are_left_out(spark):
    rows = [(1, [0.5, 1.0]), (2, [1e30, 0.0]), (3, [131071.5, 0.0]), (4, [131072.0, 0.0])]
    assert [r[0] for r in run(spark, rows, size=2)] == [1, 3]


@pytest.mark.parametrize("scale", [2, 60, 100_000])
def test_trees_hold_their_invariants_and_find_the_nearest(scale):
    rng = np.random.default_rng(scale)
    for trial in range(60):
        n, k, dim = (int(rng.integers(1, m)) for m in (400, 9, 8))
        p = rng.integers(-scale, scale, (n, dim))
        p = p[rng.integers(0, n, n)] if trial % 2 else p
        c = p[rng.integers(0, n, k)] if trial % 4 < 2 else rng.integers(-scale, scale, (k, dim))
        order, own, tree = D.ordered(p)
        assert sorted(order) == list(range(n))
        for a, b, f, last, r in zip(*(tree[x] for x in ("start", "end", "first", "last", "radius"))):
            assert D.squared(own[a:b], own[a]).max() <= r * r * (1 + 1e-9)
            if f < last:
                assert [x for j in range(f, last) for x in range(tree["start"][j], tree["end"][j])] == list(range(a, b))
                heads = own[tree["start"][f:last]]
                assert min(D.squared(heads[i + 1 :], heads[i]).min() for i in range(len(heads) - 1)) > 0
        whole, at, best = D.nearest(own, tree, D.Centroids(c))
        got = np.full(n, -1)
        for a, b, j in whole:
            got[a:b] = j
        got[at] = best
        assert (got == ((own[:, None] - c[None]) ** 2).sum(-1).argmin(1)).all()


def test_separate_clusters_are_decided_by_nodes():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (8, 64))
    points = np.repeat(centres, 250, 0) + rng.integers(-40, 40, (2000, 64))
    _, own, tree = D.ordered(points)
    found = {}
    whole, at, _ = D.nearest(own, tree, D.Centroids(centres), found)
    assert sum(b - a for a, b, _ in whole) + len(at) == 2000 and found.get("compared", 0) < 2000 and found["nodes"] < 2000
