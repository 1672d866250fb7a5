import random

import numpy as np
import pytest

from shotloom.llm import minhash as M
from shotloom.llm._words import U64, mix
from tests.llm.test_ngram_join import SCHEMA, brute, families


@pytest.mark.parametrize("options", [{}, {"few_members": 2, "floor": 5, "rounds": 3, "passes": 2}])
def test_equals_brute_force(spark, options):
    rows = families(1, 40, 150, [0, 1, 2, 3, 4, 5], 0) + families(2, 30, 60, [0, 1, 2], 100) + families(3, 25, 12, [0, 1], 200) + families(4, 30, 400, [6, 9, 12], 300)
    rows += [(500 + k, t) for k, t in enumerate(["", None, "one", "One", "two words", "two  WORDS", "a b c", "É b c", "é b c", "a b c d e f g h i", "a b c d e f g h j"])]
    rows += [(7, rows[3][1]), (7, "quite another text of one id"), (None, rows[5][1]), (None, "alone without an id"), (None, "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "'x' AS bits").repartition(3)
    got = sorted((tuple(r) for r in M.near_duplicates(df, **options).collect()), key=str)
    keyed = brute([((k, i), t) for k, (i, t) in enumerate(rows)], 3, 85)
    groups = {}
    for (k, i), (n, root) in keyed.items():
        groups.setdefault(root, []).append((k, i, n))
    want = []
    for members in groups.values():
        least = min((i for _, i, _ in members if i is not None), default=None)
        for _, i, n in members:
            own = i if n == 0 else least
            want.append((i, n, own, i == own))
    assert got == sorted(want, key=str)


def elements(n, start=0):
    return np.unique(mix(np.arange(start, start + n, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(1)))


def test_registers_follow_the_least_number():
    r = M.registers(elements(5000))
    assert r.min() > 0 and r.max() < 1 << 9
    assert (M.registers(elements(10000)) >> M.MANTISSA >= r >> M.MANTISSA).all()  # more elements, more leading zeros
    assert (M.registers(np.zeros(0, U64)) == 0).all() and (M.registers(elements(3)) > 0).sum() <= 3
    assert ((M.packed(r).reshape(-1, 1) >> np.arange(M.BAND) * M.LANE & (1 << 9) - 1).ravel() == r).all()


def test_estimates_and_differences_of_sketches(spark):
    rows = []
    for n, shared in ((1000, 900), (1000, 500), (3000, 0), (40, 36), (100_000, 80_000)):
        a, b = elements(n), np.unique(np.concatenate([elements(shared), elements(n - shared, 10**6)]))
        rows.append((n, len(a), len(b), M.HyperMinHash.sketch(a).tolist(), M.HyperMinHash.sketch(b).tolist(), int((M.registers(a) != M.registers(b)).sum()), shared / (2 * n - shared)))
    df = spark.createDataFrame(rows, "n long, an long, bn long, abits array<long>, bbits array<long>, d int, j double")
    apart, _, found = M.similarity(M.counts(M._registers("abits"), M._registers("bbits")), "an", "bn")
    for r in df.select("*", apart.alias("apart"), found.alias("found"), M.HyperMinHash(85).close().alias("close")).collect():
        assert r["apart"] == r["d"] and abs(r["found"] - r["j"]) < 0.16 and r["d"] <= 2 * r["n"] * (1 - r["j"])
        assert r["close"] or r["j"] < 0.85
        assert not r["close"] or r["j"] > 0.3


def test_linked_sets_share_a_band():
    """Sets of all sizes at the threshold have a band with elements in common."""
    rng = random.Random(6)
    for _ in range(400):
        n = rng.choice([7, 8, 12, 20, 45, 90, 300, 2000])
        own = elements(n, rng.randrange(1 << 30))
        away = (15 * n) // 100
        other = own[rng.randrange(away + 1) :] if rng.random() < 0.5 else np.unique(np.concatenate([own, elements(n * 15 // 85, 1 << 40)]))
        a, b = (M.packed(M.registers(x)) for x in (own, other))
        assert ((a == b) & (a != 0)).any()


def test_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
