import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shotloom.llm import substring_dedup as N
from shotloom.llm._words import U64, Words, windows

SCHEMA = "doc_id long, text string"


def brute(rows, size=50):
    first, out = {}, {}
    for i, text in sorted(rows):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        covered, new = set(), []
        for p in range(len(words) - size + 1):
            window = tuple(words[p : p + size])
            if window in first:
                covered.update(range(p, p + size))
            else:
                new.append(window)
        for window in new:
            first[window] = i
        kept = " ".join(w for p, w in enumerate(words) if p not in covered)
        out[i] = (len(words), len(covered), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 130)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(0, 90))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    rows += [(200, "a b " * 60), (201, "a b " * 60 + "c"), (202, "a b " * 24), (203, ""), (204, None), (205, "É " * 70), (206, "é " * 70)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    got = {r[0]: tuple(r)[1:] for r in N.dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows)


def test_applied_to_texts(spark):
    rows = corpus(2)
    want = brute(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, starts string").select("starts", "text", "doc_id")
    for r in N.without_repeats(df).collect():
        words, removed, kept = want[r["doc_id"]]
        original = dict(rows)[r["doc_id"]]
        assert r["text"] == original if not removed else hashlib.sha256(r["text"].encode()).hexdigest() == kept


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = " ".join(f"t{k}" for k in range(80))
    rows = [(4, long), (4, long), (9, long), (None, long), (4, "other " + long)]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in N.dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 80, 0), (4, 80, 0), (4, 80, 0), (4, 81, 0), (9, 80, 80)]
    assert N.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_longest_repeats_double_until_none_survive(spark):
    rows = corpus(3) + [(300 + k, " ".join(f"p{j}" for j in range(k, 430 + k))) for k in range(2)]
    got = {r["doc_id"]: r["longest"] for r in N.longest_repeats(spark.createDataFrame(rows, SCHEMA), 50, 800).collect()}
    want = {i: max([n for n in (50, 100, 200, 400, 800) if brute(rows, n)[i][1]], default=0) for i, _ in rows}
    assert got == want and {0, 50, 100, 400} <= set(got.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 12))
def test_chosen_windows_follow_content(values, span):
    """Each run of ``span`` windows holds a chosen one, and being chosen depends on the neighbourhood alone."""
    h = np.array(values, U64)
    found = set(N.chosen(h, span).tolist())
    want = {p for s in range(len(values) - span + 1) for p in range(s, s + span) if values[p] == min(values[s : s + span])}
    assert found == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n\té", max_size=20), min_size=1, max_size=5))
def test_words_are_split_and_hashed_alike(texts):
    w = Words([t.encode() for t in texts])
    alone = [re.findall("[^\x20\x09-\x0d]+", t) for t in texts]
    assert [int(b - a) for a, b in zip(w.first, w.first[1:])] == list(map(len, alone))
    flat = [x for ws in alone for x in ws]
    assert len(set(flat)) == len(set(w.hash.tolist())) and all((a == b) == (x == y) for a, x in zip(flat, w.hash.tolist()) for b, y in zip(flat, w.hash.tolist()))
    assert len(windows(w.hash, 3)) == max(0, len(flat) - 2)
