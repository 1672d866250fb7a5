"""Words and sequences that differ are told apart, those that hashes modulo a power of two confuse among them."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shotloom.llm import ngram_join, quality_rules, substring_dedup
from shotloom.llm._words import Words, windows


def thue_morse(n, a, b):
    return [b if k.bit_count() & 1 else a for k in range(n)], [a if k.bit_count() & 1 else b for k in range(n)]


T, U = ("".join(x) for x in thue_morse(1024, "x", "y"))


@given(st.lists(st.text("ab \x00é\t", max_size=40), max_size=6))
@settings(deadline=None, max_examples=200)
def test_hashes_are_equal_where_words_are(texts):
    raw = [t.encode() for t in texts]
    w, flat = Words(raw), [x for t in raw for x in t.split()]
    assert [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end)] == flat
    assert list(np.diff(w.first)) == [len(t.split()) for t in raw]
    for values in (w.hash, w.more):
        assert len(set(values.tolist())) == len(set(flat)) and len({(x, y) for x, y in zip(flat, values.tolist())}) == len(set(flat))


def test_words_of_all_lengths_and_cases():
    words = [bytes([65 + k % 26]) * n for n in range(1, 40) for k in range(3)] + [T.encode(), U.encode(), b"a\0", b"a\0\0"]
    w = Words([b" ".join(words)])
    assert len(set(w.hash.tolist())) == len(set(w.more.tolist())) == len(set(words))
    assert (Words([b" ".join(words)], lower=True).hash == Words([b" ".join(words).lower()]).hash).all()


def test_long_windows_of_interchanged_words():
    for n in (1024, 2048):
        a, b = (Words([" ".join(x).encode()]) for x in thue_morse(n, "one", "two"))
        for size in (50, n // 2, n):
            x, y = windows(a.hash, size), windows(b.hash, size)
            own = [tuple(w.hash[k : k + size].tolist()) for w in (a, b) for k in range(n - size + 1)]
            assert len(set(own)) == len(set(x.tolist()) | set(y.tolist()))


def test_operators_tell_such_texts_apart(spark):
    words = [f"w{k}" for k in range(59)]
    pair = spark.createDataFrame([(1, " ".join([*words[:30], T, *words[30:]])), (2, " ".join([*words[:30], U, *words[30:]]))], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.dedup(pair).collect()] == [0, 0]
    rows = [(1, f"{T} a {T} b"), (2, f"{U} a {U} b")]
    assert sorted(r["component_id"] for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 2]
    once = spark.createDataFrame([(1, f"a b c d e f g {T} a b c d e f g {U}")], "doc_id long, text string")
    assert quality_rules.measure(once).first()["n_repeat_words"] == 0
    a, b = (" ".join(x) for x in thue_morse(2048, "one", "two"))
    long = substring_dedup.longest_repeats(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), longest=3200)
    assert {r["doc_id"]: r["longest"] for r in long.collect()}[2] < 1600
