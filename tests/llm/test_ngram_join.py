import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from shotloom.llm import ngram_join as N

SCHEMA = "doc_id long, text string"


def shingles(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, width=3, percent=90):
    """doc_id -> (set size, least reachable id)."""
    sets = {i: shingles(t, width) for i, t in rows}
    above = {i: i for i in sets}

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    inverted = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in inverted[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                above[b] = a
        for s in sets[i]:
            inverted[s].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def families(seed, members, length, edits, start=0):
    """Copies of one text, each with its own changed words."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(length)]
    rows = []
    for m in range(members):
        words = base[:]
        for k in rng.sample(range(length), rng.choice(edits)):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((start + m, " ".join(words)))
    return rows


@pytest.mark.parametrize("options", [{}, {"few_members": 2, "floor": 5, "rounds": 3, "passes": 2}, {"enum": N.PartEnum(90, 2, 1), "rounds": 1}, {"enum": N.PartEnum(90, 4, 2)}, {"percent": 80, "width": 5, "few_members": 3}])
def test_equals_brute_force_on_families_around_the_threshold(spark, options):
    rows = families(1, 40, 150, [0, 1, 2, 3, 4], 0) + families(2, 30, 60, [0, 1, 2], 100) + families(3, 25, 12, [0, 1], 200) + families(4, 30, 400, [4, 6, 8], 300)
    rows += [(500 + k, t) for k, t in enumerate(["", None, "one", "One", "two words", "two  WORDS", "a b c", "É b c", "é b c"])]
    width, percent = options.get("width", 3), options.get("percent", 90)
    got = {r[0]: (r[1], r[2]) for r in N.link(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute(rows, width, percent)


def met(spark, folder, sets, percent):
    """The pairs that share an element of their prefixes; the first set is the centre."""
    pack = zstandard.ZstdCompressor().compress
    classes = spark.createDataFrame([(k, pack(" ".join(sorted(s)).encode())) for k, s in enumerate(sets)], "node long, packed binary")
    stars = spark.createDataFrame([(0, k) for k in range(1, len(sets))], "a long, b long")
    holders = defaultdict(set)
    for centre, element, node in N._prefixes(stars, classes, 1, percent, folder).collect():
        holders[element].add(node)
    return {(a, b) for nodes in holders.values() for a in nodes for b in nodes if a < b}


def test_prefixes_where_only_some_sets_list_what_the_centre_has(spark, tmp_path):
    centre = {f"c{k}" for k in range(20)}
    x = {f"c{k}" for k in range(7, 20)} | {"a0", "a1", "a2"}
    y = x | {f"b{k}" for k in range(4)}
    assert (1, 2) in met(spark, str(tmp_path / "hand"), [centre, x, y], 80)
    rng = random.Random(3)
    for turn, percent in enumerate((80, 80, 90)):
        size = 40 if percent == 90 else 20
        sets = [{f"c{k}" for k in range(size)}]
        for f in range(12):  # removed parts over k, added parts around the number of places
            away, base = rng.sample(range(size), rng.randrange(4, 9)), {f"f{f}-{k}" for k in range(rng.randrange(1, 5))}
            for m in range(5):
                out = away[: len(away) - rng.randrange(2)]
                sets.append({f"c{k}" for k in range(size) if k not in out} | base | {f"f{f}-{m}-{k}" for k in range(rng.randrange(5))})
        linked = {(a, b) for a in range(1, len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        star = {a for a in range(1, len(sets)) if 100 * len(sets[a] & sets[0]) >= percent * len(sets[a] | sets[0])}
        linked = {(a, b) for a, b in linked if not {a, b} <= star}  # both in the centre's component
        assert linked and linked <= met(spark, str(tmp_path / f"t{turn}"), sets, percent)


@pytest.mark.parametrize("seed, percent", [(1, 90), (3, 80)])
def test_hubs_and_sets_unlike_them_equal_brute_force_with_default_parameters(spark, seed, percent):
    """Sets around hubs: some lack much of the hub, some hold little of it, and pairs among them lie around the threshold."""
    rng = random.Random(seed)
    rows = []
    for hub in range(3):
        size = rng.choice([20, 60, 110])
        base = [f"h{hub}-{k}" for k in range(size)]
        rows.append(base)
        for f in range(8):
            gone = set(rng.sample(base, rng.randrange(1, size * 2 // 3)))
            own = [f"f{hub}-{f}-{k}" for k in range(rng.randrange(0, size // 3))]
            for m in range(4):
                kept = [w for w in base if w not in gone or rng.random() < 0.1]
                rows.append([w for w in kept + own if rng.random() > 0.03] + [f"m{hub}-{f}-{m}-{k}" for k in range(rng.randrange(4))])
    rows = [(1000 + k, " ".join(rng.sample(r, len(r)))) for k, r in enumerate(rng.sample(rows, len(rows)))]
    want = brute(rows, 1, percent)
    assert 3 < len({c for _, c in want.values()}) < len(rows) - 10
    for options in ({}, {"few_members": 1}):
        got = {r[0]: (r[1], r[2]) for r in N.link(spark.createDataFrame(rows, SCHEMA), width=1, percent=percent, **options).select("doc_id", "n_shingles", "component_id").collect()}
        assert got == want


def test_signatures_meet_for_all_linked_sets():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        for parts, level in ((2, 1), (3, 1), (4, 2)):
            enum = N.PartEnum(percent, parts, level)
            for size in (6, 9, 14, 30, 75, 200):
                for _ in range(20):
                    a = np.unique(rng.integers(1, 1 << 60, size).astype(np.uint64))
                    most = 2 * len(a) * (100 - percent) // (100 + percent)
                    out = int(rng.integers(0, most // 2 + 1))
                    b = np.unique(np.concatenate([a[out:], rng.integers(1, 1 << 60, int(rng.integers(0, most - out + 1))).astype(np.uint64)]))
                    if N.linked(a, b, percent) and len(np.setxor1d(a, b)):
                        assert len(np.intersect1d(enum.signatures(a), enum.signatures(b)))
                        assert sum(int(x).bit_count() for x in (N.sketch(a) ^ N.sketch(b)).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_unlinked_copies_form_few_pairs(spark, monkeypatch):
    """A group of copies that all lie just beyond the threshold isn't compared in all pairs."""
    rows = families(7, 80, 200, [5], 0)
    compared = []
    verified = N._verified

    def count(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(N, "_verified", count)
    for few in (2, 4096):
        got = {r[0]: r[2] for r in N.link(spark.createDataFrame(rows, SCHEMA), few_members=few).collect()}
        assert got == {i: c for i, (_, c) in brute(rows).items()}
    assert compared[1] < 80 < 80 * 79 / 2, compared


def test_repeated_rows_null_ids_and_further_columns(spark):
    text = " ".join(f"t{k}" for k in range(40))
    rows = [(5, text, 1), (5, text, 2), (None, text, 3), (3, text + " end", 4), (9, "other words here now", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sign int").selectExpr("sign", "text", "doc_id", "sign as h1")
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in N.link(df).collect())
    assert got == [(-1, 3), (3, 3), (5, 3), (5, 3), (9, 9)]


def test_a_null_id_joins_what_it_links(spark):
    """Its text links two others that don't link, and their component has the least id."""
    base = [f"t{k}" for k in range(100)]
    rows = [(7, " ".join(["x0", "x1", *base[:-1]])), (None, " ".join(base)), (4, " ".join([*base[1:], "y0", "y1"])), (None, "nothing else like it")]
    got = {(r["doc_id"], r["component_id"]) for r in N.link(spark.createDataFrame(rows, SCHEMA), percent=94).collect()}
    assert got == {(None, None), (None, 4), (4, 4), (7, 4)}


def test_representatives_of_rows_that_share_an_id(spark):
    words = " ".join(f"t{k}" for k in range(40))
    rows = [(5, words, 2), (5, words.upper(), 1), (5, "another text with the same id", 3), (6, words, 4), (None, words, 5), (8, None, 6), (8, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ long")
    kept = sorted(N.representatives(df, 5, percent=80).collect(), key=lambda r: r["n_"])
    assert [r["n_"] for r in kept] == [1, 3, 5, 6, 7] and kept[0].asDict() == {"doc_id": 5, "text": words.upper(), "n_": 1}


def test_empty_table(spark):
    assert N.link(spark.createDataFrame([], SCHEMA)).collect() == []


def test_representatives_keep_one_of_each_group(spark):
    rows = families(11, 12, 80, [0, 1], 10) + [(1, ""), (2, None), (3, "alone in the world of words")]
    kept = N.representatives(spark.createDataFrame(rows, SCHEMA), width=5, percent=80)
    want = {i for i, (n, c) in brute(rows, 5, 80).items() if n == 0 or i == c}
    assert {r[0] for r in kept.collect()} == want and kept.columns == ["doc_id", "text"]


def test_passes_share_the_signatures_and_no_pass_makes_them_all():
    enum, rng = N.PartEnum(80), np.random.default_rng(5)
    for n in (3, 40, 700, 5000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        whole, parts = np.unique(enum.signatures(s)), [np.unique(enum.signatures(s, p)) for p in (0, 1)]
        assert np.array_equal(np.unique(np.concatenate(parts)), whole)
        assert n < 40 or max(map(len, parts)) < 0.7 * len(whole)


def test_signed_is_the_same_in_any_number_of_passes(spark):
    rows = [(k, f"a b{k % 7} c d{k} e f{k % 3} " * 9) for k in range(40)]
    classes = N.sets(spark.createDataFrame(rows, SCHEMA), 3, True).selectExpr("doc_id AS node", "packed")
    want = sorted(map(tuple, N.PartEnum(80).signed(classes, 3).collect()))
    for passes in (2, 3, 4):
        parts = [list(map(tuple, N.PartEnum(80).signed(classes, 3, passes, turn).collect())) for turn in range(passes)]
        assert sorted(sum(parts, [])) == want and max(map(len, parts)) < 2 * len(want) / passes


def test_texts_without_a_partner_are_not_shuffled(spark):
    rows = spark.range(20_000).selectExpr("id * 8589934592 + id AS node", "'text' AS packed")
    wanted = rows.where("node % 50 = 0").select("node")
    found = {r["node"] for r in N._among(rows, wanted).collect()}
    need = {r["node"] for r in wanted.collect()}
    assert need <= found and len(found) < len(need) + 100
    assert N._among(rows, wanted).columns == ["node", "packed"] and N._among(rows, wanted.where("false")).collect() == []


def test_long_sketches_keep_linked_sets_and_part_unlike_ones():
    rng = np.random.default_rng(9)
    draw = lambda n: np.unique(rng.integers(1, 1 << 60, n).astype(np.uint64))
    read = lambda s: np.frombuffer(N.parities(s), np.uint64)
    for percent in (80, 90):
        for size in (1, 5, 60, 130, 1000, 2040, 5000, 30_000):
            for _ in range(10):
                a = draw(size)
                gone = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
                b = np.unique(np.concatenate([a[gone:], draw(int(rng.integers(0, gone + 2)))]))
                if N.linked(a, b, percent):
                    assert N.may_link(read(a), read(b), percent) and N.may_link(read(b), read(a), percent)
                unlike = np.unique(np.concatenate([a[: len(a) // 2], draw(size - len(a) // 2)]))
                assert size < 1000 or not N.may_link(read(a), read(unlike), percent)


def test_long_texts_that_share_frequent_words_move_no_texts(spark, monkeypatch):
    """The number of pairs of unlike long sets with a frequent element in common grows with the square of the input."""
    rng = random.Random(8)
    often = [f"often{k}" for k in range(40)]
    rows = [(i, " ".join(rng.sample([*often, *(f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(1700, 1900)))], 1700))) for i in range(60)]
    rows += [(100 + i, t + " more words") for i, t in rows[:5]]
    compared = []
    verified = N._verified

    def count(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(N, "_verified", count)
    got = {r[0]: r[2] for r in N.link(spark.createDataFrame(rows, SCHEMA), width=1, percent=80).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 1, 80).items()} and compared[1] <= 5, compared


@pytest.mark.parametrize("few", [2, 4096])
def test_pairs_compared_in_slices_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(N, "LEAST_BYTES", 1)
    monkeypatch.setattr(N, "RUN", 8)
    rows = families(21, 40, 150, [0, 1, 3, 5], 0) + families(22, 30, 60, [0, 1, 2], 100) + families(23, 30, 400, [4, 6, 8], 300)
    got = {r[0]: r[2] for r in N.link(spark.createDataFrame(rows, SCHEMA), few_members=few).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}
