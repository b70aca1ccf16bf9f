"""Observation streams: the batch rules of the observation tables on arriving data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailposture import dims
from mailposture.sources.observations import latest


def dedup_stream(obs_stream: DataFrame, ttl: str = "1 day") -> DataFrame:
    """First observation of every (kind, domain) within the time to live.

    State is kept per key only until the watermark passes its time to live, so it is bounded by the keys of that span.
    """
    timed = obs_stream.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return timed.withWatermark("observed_at", ttl).dropDuplicatesWithinWatermark(["kind", "domain"])


def fresh_stream(obs_stream: DataFrame, kind: str) -> DataFrame:
    """One kind of observation, repeated ones inside its own time to live dropped."""
    return dedup_stream(obs_stream.filter(F.col("kind") == kind), f"{dims.TTL_DAYS[kind]} days")


def upsert_stream(obs_stream: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch, reduced to its newest row per (kind, domain), to ``target/batch=…``.

    A batch costs what it brings, not the size of the table.  A batch that runs again after a failure overwrites its own
    folder, so every observation counts once.  :func:`current_state` reads the newest row per key by event time, so late
    rows lose; :func:`compact` merges old batches now and then.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        latest(batch).write.mode("overwrite").partitionBy("kind").parquet(f"{target}/batch={batch_id}")

    writer = obs_stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def current_state(spark: SparkSession, *targets: str) -> DataFrame:
    """Newest observation per (kind, domain) over compacted tables and batches; filters on ``kind`` prune folders."""
    frames = [spark.read.parquet(t) for t in targets]
    rows = frames[0].drop("batch")
    for frame in frames[1:]:
        rows = rows.unionByName(frame.drop("batch"))
    return latest(rows)


def compact(spark: SparkSession, target: str, *sources: str) -> None:
    """Write the current state over several tables as one table, for use in place of them."""
    current_state(spark, *sources).write.mode("overwrite").partitionBy("kind").parquet(target)
