import re
from collections import Counter

from shotloom.llm import quality_rules as Q

SCHEMA = "doc_id long, text string"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", "one", "a b c d e f g h " * 5, "same\nsame\nsame \n\n \nother", "# é🎬 $ | < >", "word " * 40, "x1 x2 x3 x4 x5 x6 x7 x8 y x1 x2 x3 x4 x5 x6 x7 x8", " ".join(f"w{k}" for k in range(30000)), "A" * 100 + " " + "LOUD! " * 30]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (3, TEXTS[3])], SCHEMA).selectExpr("text", "doc_id", "0 as failures", "1 as n_words")
    rows = Q.apply_policy(Q.ledger(Q.measure(df)), "v2").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        n, chars, symbols, dup, repeats = want = brute(TEXTS[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and not (r["base_failed"] and r["kept"])


def test_policies_and_ablation_agree_with_the_bits(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (50, " ".join(f"fine{k}" for k in range(25)))], SCHEMA)
    ledger = Q.ledger(Q.measure(df))
    rows = ledger.collect()
    assert {r["doc_id"] for r in Q.apply_policy(ledger, "v2").where("kept").collect()} == {r["doc_id"] for r in rows if not r["failures"] & Q.mask(Q.POLICIES["v2"])} == {8, 50}
    got = {r["rule"]: (r["fails"], r["only_by_it"]) for r in Q.ablation(ledger, "v2").collect()}
    whole = Q.mask(Q.POLICIES["v2"])
    for name in Q.POLICIES["v2"]:
        bit = Q.mask((name,))
        assert got[name] == (sum(bool(r["failures"] & bit) for r in rows), sum(r["failures"] & whole == bit for r in rows))


def test_empty_table(spark):
    empty = Q.ledger(Q.measure(spark.createDataFrame([], SCHEMA)))
    assert empty.collect() == [] and {r["fails"] for r in Q.ablation(empty, "v1").collect()} == {0}
