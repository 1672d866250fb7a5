import random

from shotloom.streaming import incremental, jobs

SCHEMA = "user_id long, event_type string, ts timestamp"


def brute(events, gap, passed):
    """Stage and job rows of (user, stage, ms) up to the watermark."""
    out = []
    for user in {e[0] for e in events}:
        own = sorted((at, stage) for u, stage, at in events if u == user and at <= passed)
        job = []
        for at, stage in [*own, (None, None)]:
            if job and (at is None or at - job[-1][0] > gap):
                if at is not None or passed > job[-1][0] + gap:
                    out.append((str(user), "job", None, job[0][0], (job[-1][0] - job[0][0]) / 1000, len(job)))
                job = []
            elif job:
                out.append((str(user), "stage", job[-1][1], job[-1][0], (at - job[-1][0]) / 1000, len(job)))
            if at is not None:
                job.append((at, stage))
    return sorted(out, key=str)


def test_stages_in_any_order_within_the_delay(spark, tmp_path):
    rng = random.Random(1)
    base = 1_700_000_000_000
    events = [(rng.randrange(4), rng.choice("abc"), base + 1000 * k * 20 + rng.randrange(3) * 1000) for k in range(240)]
    events += events[:3]
    order = sorted(range(len(events)), key=lambda k: events[k][2] + rng.randrange(200_000))  # up to 200 s out of order
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    for k in range(0, len(order), 50):
        rows = [events[i] for i in order[k : k + 50]]
        spark.createDataFrame(rows, "user_id long, event_type string, ms long").selectExpr("user_id", "event_type", "timestamp_millis(ms) AS ts").coalesce(1).write.mode("append").parquet(source)
    schema = spark.createDataFrame([], SCHEMA).schema
    table = jobs.follow(spark, incremental.files(spark, source, schema, per_trigger=1), root, gap=90, late="400 seconds")
    passed = max(e[2] for e in events) - 400_000
    rows = lambda: sorted((tuple(r[c] for c in ("key", "kind", "stage", "at_ms", "seconds", "n")) for r in table.read().collect()), key=str)
    assert rows() == brute(events, 90_000, passed)
    at = table.current()
    jobs.follow(spark, incremental.files(spark, source, schema, per_trigger=1), root, gap=90, late="400 seconds")  # nothing new
    assert table.current() == at
    more = [(7, "z", max(e[2] for e in events) + 1_000_000)]  # the watermark passes all that was open
    spark.createDataFrame(more, "user_id long, event_type string, ms long").selectExpr("user_id", "event_type", "timestamp_millis(ms) AS ts").write.mode("append").parquet(source)
    jobs.follow(spark, incremental.files(spark, source, schema, per_trigger=1), root, gap=90, late="400 seconds")
    assert rows() == brute(events + more, 90_000, more[0][2] - 400_000)


def test_files_side_by_side_in_time_lose_nothing(spark, tmp_path):
    """Each file spans the whole time: taken one by one, the first would make the others' events late."""
    import duckdb

    from shotloom import catalog, catalog_ingest  # noqa: F401

    rows = spark.range(0, 3000, 1, 4).selectExpr("id AS event_id", "id % 7 AS user_id", "concat('e', id % 5) AS event_type", "timestamp_seconds(1700000000 + pmod(id * 7919, 3000) * 120)::timestamp_ntz AS ts")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    got = catalog.QUERIES["job_stages"](spark, str(tmp_path))
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
    want = con.execute(catalog.ORACLES["job_stages"])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    assert len(want) > 2500
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == sorted(map(repr, want))
