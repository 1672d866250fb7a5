import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shotloom.llm import token_align as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "plain words and more", "<|endoftext|> and <s> </s> <unk>", "  two  spaces \n\t tabs", "naïve café – “quoted” 漢字 🎉", "x", " ", "ﬁ ligature   hard", "a" * 500, "don't I'll we've", "0\x00\x01", "é", "12345 67,890"]


def brute(texts):
    """The contract, token by token."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in plain]
    back = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(others)}
    docs, count = [], Counter()
    for t in texts:
        rows = None
        if t:
            one, two = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            bytes_a = [bytes(back[c] for c in a.id_to_token(n)) for n in one]
            bytes_b = [bytes([int(p[3:5], 16)]) if len(p := b.id_to_piece(n)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for n in two]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                ends = [np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b)]
                shared = sorted(set(ends[0]) & set(ends[1]))
                links = [(one[ends[0].index(e)], two[ends[1].index(e)]) for e in shared]
                groups, low = [], 0
                for e in shared:
                    groups.append("|".join(",".join(str(n) for n, at in zip(ids, own) if low < at <= e) for ids, own in ((one, ends[0]), (two, ends[1]))))
                    low = e
                rows = len(one), len(two), groups, links
                count.update(links)
        docs.append(rows)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for rows in docs:
        if rows is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = rows
        out.append((n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [T.HOT, 3, 0])
def test_equals_the_contract_token_by_token(spark, hot, monkeypatch):
    monkeypatch.setattr(T, "HOT", hot)
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["the", "of", "Harbour", "unbelievably", "x1", "é", "naïveté,", "co-op", "\n"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += texts[-5:]
    rows = spark.createDataFrame([(k % 50 if k % 7 else None, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, row string, pairs int").repartition(3)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = Counter((r["doc_id"], *(r[n] for n in names)) for r in T.alignment(rows, A, B).collect())
    assert got == Counter((k % 50 if k % 7 else None, *x) for k, x in enumerate(brute(texts)))


def test_pieces_of_a_long_text_give_the_tokens_of_the_whole(monkeypatch):
    both = T.Tokenizers(A, B)
    assert both.splits
    rng = random.Random(5)
    words = ["the", "Harbour", "don't", "12", "  ", "\n", "é", "漢字", "end.", "(a)", "x_y", "A", "<s>"]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(20)] + ["a" * 5000, " " * 300 + "b c"]
    monkeypatch.setattr(T, "CHUNK", 10**9)
    whole = both.encode(texts)
    monkeypatch.setattr(T, "CHUNK", 40)
    assert sum(len(both.chunks(t)) for t in texts) > 200
    assert both.encode(texts) == whole and all(both.spell(t.encode(), *x) for t, x in zip(texts, whole, strict=True))
    one = [both.align([x])[0] for x in whole]
    assert [(x, y.tolist()) for x, y in both.align(whole)] == [(x, y.tolist()) for x, y in one]


def test_ranks_encode_like_the_tokenizer_itself():
    both = T.Tokenizers(A, B)
    assert both.fast is not None
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    rng = random.Random(7)
    letters = "aAbz .,'  \n\t\r\x0b\x1c\x85\xa0\u2003\u3000éß漢ಠ🎉٣½ªǅ\u0301\u200b0123-_/<|>sdmtlver"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(4000)] + [t for t in ODD if t]
    assert [both.fast.encode_ordinary(t) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_index_finds_all_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        a, b = (np.append(np.sort(rng.permutation(np.arange(1, n))[: rng.integers(0, n)]), n) for _ in range(2))
        first, last = T.stab(a, b)
        s = lambda e: np.concatenate([[0], e[:-1]])
        for k in range(len(a)):
            meets = [j for j in range(len(b)) if s(b)[j] < a[k] and b[j] > s(a)[k]]
            assert [first[k], last[k]] == [meets[0], meets[-1]]
        p, q = T.boundaries(a, b)
        assert a[p].tolist() == b[q].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_empty_table(spark):
    assert T.alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
