"""Jobs followed by keyed state: stage times and the end of jobs, from a stream of events in any order within the watermark's delay.

An event says that a job (``key``) enters a stage at a time. The stage before it ends then; a job ends when no event follows within ``gap``. State is kept by job: the events
that the watermark hasn't passed yet, and a summary of the job so far. A timer folds all events that the watermark has passed into the summary, in order, or ends the job
after the gap; then the next one is set, so a batch calls a job's state a few times, not for each event. So results don't depend on how events arrive, and state is bounded by the delay, not by the length of a job.

Rows: for each stage that ended (kind ``stage``) its name, start, seconds and number in its job; for each job that ended (kind ``job``) its start, seconds, and number of events. Events of one time go by their
stage's name. Events later than the watermark are dropped, as by every operator of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shotloom.sources.store import Table

OUT = "key string, kind string, stage string, at_ms long, seconds double, n long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobAges(StatefulProcessor):
    """Folds a job's events in order of time; see the module."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "at_ms long, stage string")
        self.job = handle.getValueState("job", "start long, last long, n long, stage string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r["at_ms"], r["stage"]) for r in rows]
        if new:
            self.ahead.appendList(new)
            self.handle.registerTimer(min(at for at, _ in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        events = sorted((x[0], x[1]) for x in self.ahead.get()) if self.ahead.exists() else []
        ready = [x for x in events if x[0] <= passed]
        before = job = tuple(self.job.get()) if self.job.exists() else None
        out = []
        for at, stage in ready:
            if job and at - job[1] > self.gap:
                out.append(self._ended(key[0], job))
                job = None
            if job:
                out.append(Row(key=key[0], kind="stage", stage=job[3], at_ms=job[1], seconds=(at - job[1]) / 1000, n=job[2]))
            job = (job[0], at, job[2] + 1, stage) if job else (at, at, 1, stage)
        if job and passed > job[1] + self.gap:
            out.append(self._ended(key[0], job))
            job = None
        left = events[len(ready) :]
        if ready and left:
            self.ahead.put(left)
        elif ready:
            self.ahead.clear()
        if job and job != before:
            self.job.update(job)
        elif before and not job:
            self.job.clear()
        if left or job:
            self.handle.registerTimer(min([at for at, _ in left[:1]] + [job[1] + self.gap + 1 for _ in range(bool(job))]))
        return iter(out)

    @staticmethod
    def _ended(key: str, job: tuple) -> Row:
        return Row(key=key, kind="job", stage=None, at_ms=job[0], seconds=(job[1] - job[0]) / 1000, n=job[2])

    def close(self) -> None:
        pass


def followed(events: DataFrame, gap: int = 1800, late: str = "1 hour", key: str = "user_id", stage: str = "event_type", time: str = "ts") -> DataFrame:
    """The rows (key, kind, stage, at_ms, seconds, n) of a stream of events, gap in seconds. The session needs the state store ``PROVIDER``."""
    at = F.col(time).cast("timestamp")
    timed = events.select(F.col(key).cast("string").alias("key"), F.col(stage).alias("stage"), at.alias("at"), F.unix_millis(at).alias("at_ms")).withWatermark("at", late)
    return timed.groupBy("key").transformWithState(JobAges(1000 * gap), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def follow(spark: SparkSession, events: DataFrame, root: str, gap: int = 1800, late: str = "1 hour", name: str = "jobs", partitions: int | None = None, **columns: str) -> Table:
    """Run over what there is now and upsert the rows into a table below root; a batch that is repeated after a failure changes nothing.

    The first run fixes the number of partitions of the state: by default as many as the cluster runs tasks at a time, since each is a state store that every batch opens.
    """
    id = F.concat_ws("/", "kind", "key", "at_ms", F.coalesce("stage", F.lit("")), "n", "seconds")
    table = Table(spark, root, name, spark.createDataFrame([], f"id string, {OUT}").schema, "id").create()
    dealt = partitions or min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": str(dealt)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:

        def batch(df: DataFrame, number: int) -> None:
            rows = df.withColumn("id", id).persist()  # what reads it again must not run the state again
            if not rows.isEmpty():
                table.upsert(rows, batch=(name, number))
            rows.unpersist()

        query = followed(events, gap, late, **columns).writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/{name}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return table
