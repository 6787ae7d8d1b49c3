"""The same plans over a stream of files: append as documents come, never twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def incremental(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs ``plan`` on the files that are new since the last run and appends the result to ``sink``.

    The checkpoint makes it resumable: a file is taken once, and a batch that fails is written again whole.
    """
    new = spark.readStream.schema(schema).parquet(source)
    return plan(new).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _once(rows: DataFrame, key: str, time: str | None, live: str) -> DataFrame:
    """Rows of a stream whose key hasn't come before."""
    return rows.dropDuplicates([key]) if time is None else rows.withWatermark(time, live).dropDuplicatesWithinWatermark([key])


def keyed(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "doc_id", time: str | None = None, live: str = "30 days") -> StreamingQuery:
    """Like ``incremental`` for a source of one row for each key: a row whose key has come before, in whatever batch, is skipped.

    plan: what is done with the rows that are new (maps, filters, explosions, joins with tables). The keys are in a state store,
    partitioned by the key as its shuffle is, so nothing that is written is read again. time: a timestamp column; a key is
    forgotten when the stream is ``live`` beyond its time, so the state holds the keys of that span only, and rows that far
    behind the stream are dropped. Without it all keys stay. Null is a key like others.
    """
    new = plan(_once(spark.readStream.schema(schema).parquet(source), key, time, live))
    return new.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_missing(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "doc_id", time: str | None = None, live: str = "30 days") -> StreamingQuery:
    """Like ``keyed`` for plans with joins or windows over one batch: a batch is a plain DataFrame of the source's rows, one for each new key.

    A batch goes to a folder of its own, which a repeated batch replaces whole, so a crash leaves no half-written keys behind.
    """
    new = _once(spark.readStream.schema(schema).parquet(source), key, time, live)

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Extension: events by type and tumbling window, with a watermark on a stream. ts: timestamp."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
