import hashlib
import random
import re

import corpus_pipeline as C
from shotloom.llm import packing, quality_mil, secret_scan
from shotloom.llm._words import read

from tests.llm.test_ngram_join import brute as linked
from tests.llm.test_substring_dedup import brute as repeated

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(tmp_path, spark):
    """Clean texts, junk, near copies, a passage that many share, and secrets."""
    rng = random.Random(12)
    word = lambda: f"{rng.choice('the an on re st nd er ha'.split())}{rng.choice('ing tion er ly ed'.split())}{rng.randrange(400)}"
    passage = " ".join(word() for _ in range(70))
    rows, labels = [], []
    for i in range(160):
        words = [word() + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(60, 160))]
        bad = i % 6 == 5
        if bad:
            words = [w + "$$$" if i % 12 == 5 else w.upper() + "!!" for w in words]
        text = " ".join(words)
        if i % 10 == 0:
            text = f"{text}\n{passage}"
        if i % 15 == 1:
            text += f" token = {hashlib.sha1(str(i).encode()).hexdigest()} end"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), 0))
    for k in range(4):
        words = rows[2][1].split()
        words[7 * k] = f"changed{k}"
        rows.append((300 + k, " ".join(words), "en", "s", 1))
    rows += [(400, rows[4][1], "en", "s", 1), (401, None, None, None, None), (402, "", "de", "s", 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows, {i for i, q, _ in labels if not q}


def test_each_stage_against_brute_force(spark, tmp_path):
    rows, junk = corpus(tmp_path, spark)
    sf_dir, stages = str(tmp_path), dict(C.STAGES)
    docs = read(spark, sf_dir, "documents")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    kept = stages["quality"](spark, docs, sf_dir).persist()
    want = {r["doc_id"] for r in quality_mil.classify(docs, read(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and set(texts(kept)) == want and not want & junk and {i for i in range(160)} - junk <= want

    single = stages["near_duplicates"](spark, kept, sf_dir).persist()
    own = texts(kept)
    groups = linked(list(own.items()), 5, 80)
    assert single.columns == docs.columns and set(texts(single)) == {i for i, (n, c) in groups.items() if n == 0 or i == c}
    assert not {300, 301, 302, 303, 400} & set(texts(single))

    cut = stages["repeats"](spark, single, sf_dir).persist()
    before, after = texts(single), texts(cut)
    assert cut.columns == docs.columns and set(after) == set(before)
    for i, (_, removed, digest) in repeated(list(before.items())).items():
        assert hashlib.sha256(after[i].encode()).hexdigest() == digest if removed else after[i] == before[i]
    assert all(r["n_chars"] == len(r["text"]) for r in cut.where("text is not null").collect())

    clean = stages["secrets"](spark, cut, sf_dir).persist()
    found = texts(clean)
    assert clean.columns == docs.columns and set(found) == set(after)
    assert not any(re.search(secret_scan.HEX_LONG, t or "") for t in found.values()) and all(found[i] == t for i, t in after.items() if not t or "token" not in t)

    placed = stages["packed"](spark, clean, sf_dir).collect()
    words = {}
    for r in placed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["n_words"]
    assert words == {i: len((t or "").split()) for i, t in found.items()}
    assert {r["capacity"] for r in placed} <= {None, *packing.CAPACITIES}

    assert sorted(map(str, C.run(spark, sf_dir).collect())) == sorted(map(str, placed))


def test_stages_are_five_and_without_sql():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "repeats", "secrets", "packed"] and C.ORACLE_SQL is None


def test_nulls_repeated_ids_clashing_columns_and_empty_tables(spark, tmp_path):
    """Null ids and texts, one id with two texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"word{k} and" for k in range(60))
    rows = [(1, long), (1, long), (1, "another text under the same id " + " ".join(f"other{k}" for k in range(60))), (None, long), (None, None), (2, None), (3, ""), (4, long + " more"), (4, "token = 0123456789abcdef0123456789abcdef here")]
    names = ["k1_", "h1", "hit", "starts", "base", "rest", "found", "n", "times_", "bin", "score"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, "en", None, 1, *names) for i, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, now = dict(C.STAGES), docs
    for name in ("quality", "near_duplicates", "repeats", "secrets"):
        now = stages[name](spark, now, str(tmp_path))
        assert now.columns == docs.columns
    now = now.persist()
    got = sorted(((r["doc_id"] or -1), r["text"] or "") for r in now.collect())
    assert [i for i, _ in got] == [-1, -1, 1, 1, 2, 3, 4] and got[-1][1] == "token = [SECRET] here".replace("token = ", "")
    assert all([r[n] for n in names] == names for r in now.collect())
    assert stages["packed"](spark, now, str(tmp_path)).where("doc_id = 2").first()["n_words"] == 0
    empty = docs.where("false")
    for name, stage in C.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name


def test_a_stage_table_goes_when_the_next_is_written(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    there = []

    def stage(_, docs, __):
        there.append(sorted(p.name for p in (tmp_path / "shared").glob("*")))
        return docs

    monkeypatch.setattr(C, "shared_folder", lambda _: str(tmp_path / "shared"))
    monkeypatch.setattr(C, "STAGES", [(n, stage) for n in "abcd"])
    assert sorted(map(tuple, C.run(spark, str(tmp_path)).collect())) == [(1, "a"), (2, "b")]
    assert there == [[], ["a"], ["b"], ["c"]] and [p.name for p in (tmp_path / "shared").glob("*")] == ["d"]


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    import time
    from pathlib import Path

    from shotloom.llm._words import CLEANUP, settle

    folders = [Path(f.toString()) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for f in folders for p in f.rglob("shuffle_*.data")}
    there, before = files(), spark.conf.get(CLEANUP, None)
    written = settle(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), str(tmp_path), "counts")
    end = time.time() + 5
    while files() - there and time.time() < end:  # they are deleted in the background
        time.sleep(0.1)
    assert not files() - there and spark.conf.get(CLEANUP, None) == before
    assert written.count() == 7
