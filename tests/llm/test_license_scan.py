from shotloom.llm import license_scan as L

SCHEMA = "doc_id long, text string"


def test_exact_and_changed_wording():
    s = L.Scanner()
    text = "🎬 foo Licensed under the Apache Licence Version 2.0 baz.\nReleased under the MIT License. And released  under the mit license"
    found = L.find(text, [s])
    assert [x[2] for x in found] == ["Apache-2.0", "MIT", "MIT"]
    assert [text[a:e] for a, e, *_ in found] == ["Licensed under the Apache Licence Version 2.0", "Released under the MIT License.", "released  under the mit license"]
    assert "license>licence" in found[0][5] and found[1][4] == 1.0 and all(x[3] > 0 for x in found)


def test_every_template_finds_itself_in_prose():
    s = L.Scanner()
    for name, wording in L.TEMPLATES.items():
        found = L.find(f"The shot begins at dusk near the river. {wording} Then the music stops and they leave.", [s])
        assert [x[2] for x in found] == [name], (name, found)


def test_whole_texts_with_changed_words_and_short_notices_beside_them():
    both = [L.Scanner(L.TEXTS), L.Scanner()]
    for name, wording in L.TEXTS.items():
        words = wording.split()
        words[len(words) // 2] = "CHANGED"
        text = f"Released under the MIT License. Some words of the file stand here before it begins. {' '.join(words)} And so it goes on.\n" + wording
        found = L.find(text, both)
        assert [x[2] for x in found] == ["MIT", name, name], (name, [x[:3] for x in found])
        assert "CHANGED".lower() in found[1][5] and found[2][4] == 1.0 and text[found[2][0] : found[2][1]].startswith(words[0])


def brute(text, templates, cover=0.8):
    """All templates at all places by counting words in order: the spans of those that are there whole."""
    words = [L.plain(w) for w in text.split()]
    out = set()
    for name, wording in templates.items():
        want = [L.plain(w) for w in wording.split()]
        out |= {(k, k + len(want), name) for k in range(len(words) - len(want) + 1) if words[k : k + len(want)] == want}
    return {x for x in out if not any(y[0] <= x[0] and x[1] <= y[1] and y != x and y[1] - y[0] > x[1] - x[0] for y in out)}


def test_exact_notices_equal_brute_force():
    import random

    rng = random.Random(4)
    s = L.Scanner()
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            parts += [f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 60))] + L.TEMPLATES[rng.choice(list(L.TEMPLATES))].split()
        text = " ".join(parts)
        starts = [0]
        for w in text.split():
            starts.append(starts[-1] + len(w) + 1)
        got = {(starts.index(a), name) for a, e, name, _, share, _ in L.find(text, [s]) if share == 1.0}
        assert got >= {(a, name) for a, _, name in brute(text, L.TEMPLATES)}


def test_cues_without_a_license_find_nothing():
    s = L.Scanner()
    assert L.find("He lost his driving license and asked permission to leave.", [s]) == []
    assert L.find("", [s]) == []


def test_ranking_by_savings():
    s = L.Scanner()
    words = [L.plain(w) for w in L.TEMPLATES["GPL-3.0"].split()]
    saved = s.savings(words)
    assert saved[0][1] == "GPL-3.0" and saved == sorted(saved, key=lambda x: (-x[0], x[1]))


def test_short_license_beside_parts_of_longer_ones():
    part = {n: " ".join(w[: int(len(w) * 0.6)]) for n, w in ((n, t.split()) for n, t in L.TEMPLATES.items())}
    text = f"{part['GPL-header']} and so on. {part['Apache-2.0-header']} and others. Released under the MIT License. {part['MIT-grant']} it says."
    s = L.Scanner()
    assert "MIT" in {x[2] for x in L.find(text, [s])}


def test_words_of_a_template_far_off_do_not_hide_a_match():
    wording = L.TEMPLATES["CC0-1.0"].split()
    near = " ".join(w if k % 5 != 4 or k > 15 else "x" for k, w in enumerate(wording))
    text = " ".join(wording[:8]) + " filler" * 45 + " " + near
    found = L.Scanner().confirm([L.plain(w) for w in text.split()], "CC0-1.0")
    assert found and found[1:3] == (53, 53 + len(wording))


def test_cue_over_line_ends(spark):
    text = "All rights\n  reserved. No part of this work may be reproduced without asking."
    assert [r["license"] for r in L.scan(spark.createDataFrame([(1, text)], SCHEMA)).collect()] == ["Proprietary"]


def test_query_form(spark):
    text = "Released under the MIT License."
    long = "plain words here " * 50000 + text
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, long), (None, text), (5, "nothing")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("text", "doc_id", "1 as license", "2 as start")
    got = sorted(((r["doc_id"] or 0), r["license"], r["start"], r["end"]) for r in L.scan(df).collect())
    assert got == [(0, "MIT", 0, 31), (1, "MIT", 0, 31), (1, "MIT", 0, 31), (4, "MIT", len(long) - 31, len(long))]
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_texts_are_found_whatever_word_is_replaced():
    own = [L.Scanner(L.TEXTS), L.Scanner()]
    for name, wording in L.TEXTS.items():
        words = [L.plain(w) for w in wording.split()]
        often = sorted(set(words), key=lambda w: (-words.count(w), w))[:12] + ["warranty", "warranties", "without"]
        for gone in often:
            if words.count(gone) > 0.15 * len(words):
                continue
            text = "Before it. " + " ".join("zzz" if L.plain(w).startswith(gone[:6]) else w for w in wording.split()) + " After it."
            assert name in [x[2] for x in L.find(text, own)], (name, gone)


def test_what_is_not_possible_is_not_searched():
    s = L.Scanner(L.TEXTS)
    words = [L.plain(w) for w in L.TEXTS["MIT-text"].split()]
    assert s.possible(words[::-1]) and s.possible(words + ["x"] * 5000) and not s.possible(words[: len(words) // 2]) and not s.possible([])
