import random

from shotloom.llm import packing as N

SCHEMA = "doc_id long, text string"


def test_best_fit_places_every_piece_without_overlap():
    rng = random.Random(3)
    lengths = sorted((rng.choice([1, 5, 30, 200, rng.randrange(1, 65)]) % 64 + 1 for _ in range(500)), reverse=True)
    bins, offsets, capacities = N.best_fit(lengths, (16, 32, 64), 2)
    used = {}
    for n, b, o in sorted(zip(lengths, bins, offsets), key=lambda x: (x[1], x[2])):
        assert o == used.get(b, 0)
        used[b] = o + n
    assert all(used[b] <= c and min(x for x in (16, 32, 64) if x >= used[b]) == c for b, c in enumerate(capacities))
    assert sum(used.values()) == sum(lengths) and sum(capacities) <= 1.1 * sum(lengths)


def test_opens_the_least_cost_size_and_downsizes():
    assert N.best_fit([20], (16, 32, 64), 2)[2] == [32]
    assert N.best_fit([30, 30], (16, 32, 64), 2)[2] == [64]
    assert N.best_fit([], (16, 32), 2) == ([], [], [])


def plain_packer(lengths, sizes, overhead):
    """The rules by plain loops: bins as [room, last touched, words]."""
    bins, where, rest, clock = [], [], list(lengths), 0
    for n in lengths:
        rest.remove(n)
        clock += 1
        fits = [b for b in range(len(bins)) if bins[b][0] >= n]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0], -bins[b][1]))
        else:
            costs = []
            for c in sorted(sizes):
                if c >= n:
                    room = c - n
                    for m in sorted(rest, reverse=True):
                        room -= m if m <= room else 0
                    costs.append(((c + overhead) / (c - room), c))
            b = len(bins)
            bins.append([min(costs)[1], 0, 0])
        where.append((b, bins[b][2]))
        bins[b] = [bins[b][0] - n, clock, bins[b][2] + n]
    return [b for b, _ in where], [o for _, o in where], [min(c for c in sizes if c >= words) for _, _, words in bins]


def test_equals_a_plain_packer():
    rng = random.Random(8)
    for turn in range(60):
        sizes = tuple(sorted(rng.sample([8, 12, 16, 24, 32, 50, 64], rng.randrange(1, 4))))
        lengths = sorted((rng.randrange(1, sizes[-1] + 1) if rng.random() < 0.5 else rng.choice([1, 3, sizes[-1]]) for _ in range(rng.randrange(0, 90))), reverse=True)
        assert N.best_fit(lengths, sizes, turn % 4) == plain_packer(lengths, sizes, turn % 4)


def test_shards_equal_a_plain_packer(spark):
    """The query form: each shard's pieces in the stated order, with ties, null ids, repeated rows and texts that are cut."""
    rng = random.Random(9)
    rows = [(rng.choice([None, k, k]), " ".join("w" * rng.randrange(1, 3) for _ in range(rng.choice([3, 7, rng.randrange(0, 90)])))) for k in range(120)] + [(500, "a b c")] * 3
    placed = [r.asDict() for r in N.pack(spark.createDataFrame(rows, SCHEMA), (8, 16, 32), 2, shard=40).collect()]
    own = [r for r in placed if r["bin"] is not None]
    assert len({r["shard"] for r in own}) > 2
    for shard in {r["shard"] for r in own}:
        mine = sorted((r for r in own if r["shard"] == shard), key=lambda r: -r["n_words"])
        got = sorted((r["n_words"], r["bin"], r["position"], r["capacity"]) for r in mine)
        bins, offsets, capacities = plain_packer([r["n_words"] for r in mine], (8, 16, 32), 2)
        assert got == sorted((r["n_words"], b, o, capacities[b]) for r, b, o in zip(mine, bins, offsets))
    want = sorted(len((t or "").split()) for _, t in rows)
    assert sum(r["n_words"] for r in placed) == sum(want)


def test_whole_documents(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, ""), (3, None), (None, "x y"), (4, " ".join(["w"] * 150)), (5, "\t \n")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("text", "doc_id", "9 as bin", "8 as n_words")
    placed = N.pack(df, (16, 64), 2, shard=2).collect()
    words = {}
    for r in placed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert words == {1: 6, 2: 0, 3: 0, None: 2, 4: 150, 5: 0}
    assert all(r["bin"] is None for r in placed if r["n_words"] == 0) and all(r["capacity"] in (16, 64) for r in placed if r["n_words"])
    spans = {}
    for r in placed:
        if r["bin"] is not None:
            spans.setdefault((r["shard"], r["bin"], r["capacity"]), []).append((r["position"], r["n_words"]))
    for (_, _, capacity), own in spans.items():
        at = 0
        for position, n in sorted(own):
            assert position == at
            at += n
        assert at <= capacity
    assert N.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_assembled_sequences_hold_the_words(spark):
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(k * 7 % 40))) for k in range(1, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    sequences = N.assemble(df, N.pack(df, (8, 16), 1)).collect()
    assert sorted(w for s in sequences for w in s["text"].split()) == sorted(w for _, t in rows for w in t.split())
    assert all(len(s["text"].split()) == s["n_words"] <= s["capacity"] for s in sequences)
