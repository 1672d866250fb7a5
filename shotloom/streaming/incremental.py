"""Incremental ingest and session windows on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shotloom.sources.store import Table


def files(spark: SparkSession, folder: str, schema: StructType, format: str = "parquet", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(format).load(folder)


def into_table(stream: DataFrame, table: Table, checkpoint: str, by: str | None = None, transform: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = True, order: str | None = None) -> StreamingQuery:
    """Each batch is transformed and upserted (or replaces the groups of ``by``); of a batch's rows with one key the last by ``order`` counts.

    The table remembers the number of the stream's last batch, so one that is repeated after a failure changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = transform(df)
        if rows.isEmpty():
            return
        name = (checkpoint.rstrip("/"), number)
        table.replace(rows, by, name) if by else table.upsert(rows, order, name)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour", key: str = "user_id", time: str = "ts") -> DataFrame:
    """key, start, end, n: runs of events no farther apart than the gap; on a stream, closed by the watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if late and timed.isStreaming:
        timed = timed.withWatermark(time, late)
    grouped = timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
