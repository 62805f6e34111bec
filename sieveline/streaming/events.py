"""Structured Streaming forms of the incremental jobs: they accept a streaming or a static frame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sieveline.functions.classify import status_rank
from sieveline.session import checkpoint_dir


def read_events(spark: SparkSession, path: str, schema=None, files_per_trigger: int = 100) -> DataFrame:
    """A stream over landed Parquet files; the checkpoint of the query is the cursor."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedupe(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """First occurrence of each key; state is dropped once the watermark has passed."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.dropDuplicatesWithinWatermark([key]) if events.isStreaming else e.dropDuplicates([key])


def windowed(events: DataFrame, by: list[str], size: str = "1 day", slide: str | None = None, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts and sums per group and window: tumbling, or sliding for rolling quotas."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return e.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, by: str, gap: str = "30 minutes", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Sessions of events closer than ``gap``."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def status_machine(events: DataFrame, key: str = "entity_id") -> DataFrame:
    """Current status per entity as events arrive: the highest rank seen so far, opt-outs above all.

    A running maximum per key is all the state; no event older than the best one is kept.
    """
    best = F.max_by("status", status_rank(F.col("status")))
    return events.groupBy(key).agg(best.alias("status"))


def _place(stream: DataFrame, path: str | None) -> str:
    return path or f"{checkpoint_dir(stream.sparkSession)}/{uuid.uuid4().hex}"


def land(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Process what has landed, then stop: the final rows as the Parquet table ``path``.parquet.

    The query's checkpoint stands beside it. A later call with the same ``path`` goes on where the last
    one was, whether that ended or was cut short; without a path the run is one of its own, in the shared folder.
    """
    path = _place(stream, path)
    stream.writeStream.format("parquet").option("path", f"{path}.parquet").option("checkpointLocation", f"{path}.state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}.parquet")


def latest(stream: DataFrame, key: str, path: str | None = None) -> DataFrame:
    """Process what has landed in update mode: each batch's changed rows land, the last one of a key counts.

    ``path`` as for ``land``: a batch that is repeated after a failure overwrites what it wrote.
    """
    path = _place(stream, path)

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}.parquet/batch={number}")

    stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{path}.state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    columns = stream.columns
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("__batch", LongType())])).parquet(f"{path}.parquet")
    return rows.groupBy(key).agg(*[F.max_by(c, "__batch").alias(c) for c in columns if c != key])
