"""Manifest tables against a dictionary, what they write, and what versions share."""

import os
import random

import pytest

from shotloom.sources.store import Table, last_by_key
from shotloom.streaming import incremental

SCHEMA = "k string, g string, v int, name string"


def rows(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def held(table, version=None):
    return {r["k"]: tuple(r) for r in table.read(version).collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def test_random_writes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(2)
    table = Table(spark, str(tmp_path), "t", spark.createDataFrame([], SCHEMA).schema, "k", 3).create()
    assert table.create().versions() == [0] and held(table) == {} and table.count() == 0
    now, history = {}, {0: {}}
    for step in range(7):
        items = [(f"k{rng.randrange(30)}", f"g{rng.randrange(4)}", rng.randrange(10**6), "n" * rng.randrange(3)) for _ in range(12)]
        if step in (2, 5):
            fresh = {x[0]: x for x in items if x[1] == "g1"}
            version = table.replace(rows(spark, list(fresh.values())), "g")
            now = {k: x for k, x in now.items() if x[1] != "g1" or not fresh} | fresh
        elif step == 4:
            gone = [k for k in now][:5] + ["none"]
            version = table.remove(spark.createDataFrame([(k,) for k in gone], "k string"))
            now = {k: x for k, x in now.items() if k not in gone}
        else:
            version = table.upsert(rows(spark, items), "v")
            now = now | {k: max((x for x in items if x[0] == k), key=lambda x: x[2]) for k in {x[0] for x in items}}
        history[version] = dict(now)
        assert held(table) == now and table.count() == len(now)
    last = table.compact(files=1, share=0.0)
    assert held(table) == now and table.count() == len(now)
    assert table.manifest().where("kind = 'data'").count() <= 3 and table.manifest().where("kind = 'deleted'").count() == 0
    assert table.compact() is None
    some = sorted(now)[3]
    assert tuple(table.lookup(some).first()) == now[some] and table.lookup("zz").first() is None
    for old in history:
        assert held(table, old) == history[old]
    first = min(v for v in history if v)
    found = {r["k"]: (r["change"], r["before"] and tuple(r["before"]), r["after"] and tuple(r["after"])) for r in table.changes(first, last).collect()}
    a, b = history[first], now
    assert found == {k: ("added" if k not in a else "removed" if k not in b else "changed", a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    table.rollback(first)
    assert first not in table.expire(2) and held(table) == a and held(table, last) == now  # the current one stays
    assert table.versions() == sorted({first, *sorted(history)[-1:], last} & set(table.versions()) | {first, last})


def test_bytes_follow_the_batch(spark, tmp_path):
    table = Table(spark, str(tmp_path), "t", spark.createDataFrame([], SCHEMA).schema, "k", 4).create()
    big = spark.range(100_000).selectExpr("lpad(id, 8, '0') AS k", "'g' AS g", "int(id) AS v", "sha2(string(id), 256) AS name")
    table.upsert(big)
    before = size(tmp_path)
    small = rows(spark, [(f"{k:08d}", "h", -1, "new") for k in range(500, 520)])
    table.upsert(small)
    written = size(tmp_path) - before
    assert before > 5_000_000 and written < 40_000
    assert table.count() == 100_000 and table.read().where("v = -1").count() == 20
    scan = table.lookup("00000510")._jdf.queryExecution().executedPlan().toString()
    assert table.lookup("00000510").first()["name"] == "new" and "EqualTo(k,00000510)" in scan
    v = table.current()
    assert table.changes(v - 1, v).groupBy("change").count().collect() == [("changed", 20)]
    dropped = table.expire(1)
    assert dropped == [0, 1] and size(tmp_path) > before  # the old rows' files are still listed
    table.compact(files=1)
    table.expire(1)
    assert size(tmp_path) < before * 1.2 and table.read().where("v = -1").count() == 20


def test_order_is_demanded_and_ties_are_defined(spark, tmp_path):
    table = Table(spark, str(tmp_path), "t", spark.createDataFrame([], SCHEMA).schema, "k").create()
    twice = rows(spark, [("a", "x", 1, "p"), ("a", "x", 1, "q"), ("b", "y", 2, None)])
    with pytest.raises(Exception, match="no order"):
        table.upsert(twice)
    assert table.versions() == [0] and held(table) == {}
    table.upsert(twice, "v")
    assert held(table)["a"] == ("a", "x", 1, "q")
    assert last_by_key(twice, "k", "v").count() == 2


def test_a_second_writer_fails_and_changes_nothing(spark, tmp_path):
    table = Table(spark, str(tmp_path), "t", spark.createDataFrame([], SCHEMA).schema, "k").create()
    manifest, after = table._base()
    table.upsert(rows(spark, [("a", "x", 1, "p")]))
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(manifest, after)
    assert set(held(table)) == {"a"}


def test_repeated_batches_change_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = Table(spark, str(tmp_path), "t", schema, "k").create()
    one = rows(spark, [("a", "x", 1, "p")])
    version = table.upsert(one, batch=("s", 4))
    assert table.upsert(rows(spark, [("a", "x", 9, "p")]), batch=("s", 4)) == version == table.upsert(one, batch=("s", 3))
    assert table.upsert(rows(spark, [("a", "x", 9, "p")]), batch=("other", 0)) > version and held(table)["a"][2] == 9
    source = str(tmp_path / "in")
    for items in ([("a", "x", 1, ""), ("b", "x", 2, "")], [("b", "x", 3, ""), ("b", "x", 4, ""), ("c", "y", 5, "")]):
        rows(spark, items).coalesce(1).write.mode("append").parquet(source)
        incremental.into_table(incremental.files(spark, source, schema), table, str(tmp_path / "check"), order="v").awaitTermination(60)
    assert {k: x[2] for k, x in held(table).items()} == {"a": 1, "b": 4, "c": 5}
    at = table.current()
    incremental.into_table(incremental.files(spark, source, schema), table, str(tmp_path / "check"), order="v").awaitTermination(60)
    assert table.current() == at
