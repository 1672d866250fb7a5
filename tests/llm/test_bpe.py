import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shotloom.llm import bpe

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def path():
    return tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both(path):
    ranks = bpe.load_ranks(path)
    return bpe.SegmentBPE(ranks, tokenizers.PATTERN, memory=20_000), tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n\t'sé漢🎬0", max_size=80))
def test_equals_the_published_library(both, text):
    own, published = both
    assert own.encode(text) == published.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_long_pieces_and_both_tree_forms(both):
    own, published = both
    for text in ("a" * 5000, "é漢" * 700, "thereinafter" * 90, "x<|endoftext|>y", " " * 300 + "a", "0123456789" * 50):
        assert own.encode(text) == published.encode_ordinary(text)
    for piece in (b"internationalization", b" understanding", "überraschung".encode()):
        assert own.merge_long(piece) == own.merge_batch([piece], 32)[0]


def test_query_form(spark, path, both):
    texts = [None, "", "Hello, world's end", "two  spaces\n and lines ", "x" * 3000]
    rows = [*enumerate(texts), (2, texts[2]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "1 as ids", "doc_id", "2 as n_tokens")
    got = bpe.encode_decode(df, path, tokenizers.PATTERN, keep_ids=True).collect()
    want = []
    for i, t in rows:
        ids = both[1].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), path, tokenizers.PATTERN).collect() == []


def test_memory_of_the_memos_is_bounded(path):
    """Texts without units of their own, long pieces and many different words leave no more behind than the bound and one call's short entries."""
    ranks = bpe.load_ranks(path)
    own = bpe.SegmentBPE(ranks, tokenizers.PATTERN, memory=200_000)
    for k in range(0, 100_000, 500):
        texts = [f"a{j}  b{j} c" for j in range(k, k + 500)]
        for t, units in zip(texts, own.encode_units(texts)):
            assert own.decode_units(units) == t.encode()
        assert own.held <= 200_000 + 500 * 4 * (bpe.ENTRY + 60)
    own.encode("x" * 50_000 + " " + "y z" * 20_000)
    own.encode("some words " + "q" * 9_000 + " " + "r" * 9_000)
    for memo in (own.cache, own.units, own.decoded):
        assert all(len(a) + len(b) <= bpe.MEMORISED for a, b in memo.items())
        assert sum(len(a) + len(b) + bpe.ENTRY for a, b in memo.items()) <= own.held + bpe.ENTRY


def test_decoding_takes_no_room_from_the_memos(path):
    """Runs of ids were memorised too, which emptied the memos of pieces and units sooner."""
    own = bpe.SegmentBPE(bpe.load_ranks(path), tokenizers.PATTERN)
    texts = [f"word{j} and {j} more" for j in range(300)] + ["", " "]
    found = own.encode_units(texts)
    held = own.held
    assert [own.decode_units(u) for u in found] == [t.encode() for t in texts]
    assert own.held == held
