"""Observation tables: what the collectors saw, append-only, with the time of each observation.

``obs(kind, domain, …, observed_at)``.  Stored partitioned by kind and day, so that freshness filters prune partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.skew import semi_join
from mailposture.sources.registries import read_json_map

#: Tasks that share a day of one kind when it is written.
WRITERS = 8


def ttl_days(kind: Column) -> Column:
    out = F.lit(1)
    for name, days in dims.TTL_DAYS.items():
        out = F.when(kind == name, days).otherwise(out)
    return out


def fresh(obs: DataFrame, now: Column, keys: DataFrame | None = None) -> DataFrame:
    """Observations younger than the time to live of their kind, of all or of the given domains.

    Where the table has its partition column ``day``, the plain bound holds for it too, so old partitions are not read.
    """
    longest = max(dims.TTL_DAYS.values())
    at = F.col("observed_at")
    # The first condition is one plain bound that reaches the files; the second is exact per kind.
    rows = obs.filter(at > F.timestamp_add("DAY", F.lit(-longest), now))
    if "day" in obs.columns:
        rows = rows.filter(F.col("day") >= F.to_date(F.timestamp_add("DAY", F.lit(-longest), now)))
    rows = rows.filter(at > F.timestamp_add("DAY", -ttl_days(F.col("kind")), now))
    return rows if keys is None else semi_join(rows, keys, ["domain"])


def latest(obs: DataFrame) -> DataFrame:
    """Newest observation per (kind, domain); failed head requests are not stored.

    The newest row wins by its own time, not by arrival, so rows that come late never replace newer ones.
    """
    rest = [c for c in obs.columns if c not in ("kind", "domain", "observed_at")]
    kept = obs.filter((F.col("kind") != "head") | F.col("accessible")) if "accessible" in obs.columns else obs
    newest = F.max(F.struct("observed_at", *rest)).alias("n")
    return kept.groupBy("kind", "domain").agg(newest).select("kind", "domain", "n.*")


def upsert_obs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Current state after new observations arrived."""
    return latest(existing.unionByName(new))


def read_obs_json(spark: SparkSession, path: str, ttl: int, now: Column) -> DataFrame:
    """Old cache file ``{domain: {emails, redirect, accessible, timestamp}}`` without expired entries.

    Entries whose time cannot be read are kept; a file that is not valid JSON yields no rows.
    """
    entry = "struct<emails:array<string>,redirect:string,accessible:boolean,timestamp:string>"
    rows = read_json_map(spark, path, entry, key="domain")
    at = F.try_to_timestamp("timestamp")
    age = (now.cast("double") - at.cast("double")) / 86400
    return rows.filter(at.isNull() | (age <= ttl)).select(
        "domain",
        F.coalesce("emails", F.array().cast("array<string>")).alias("emails"),
        "redirect",
        F.coalesce("accessible", F.lit(False)).alias("accessible"),
        at.alias("observed_at"),
    )


def write_obs(obs: DataFrame, path: str) -> None:
    """Append observations, partitioned by kind and day.

    Rows of one partition are written together, by up to ``WRITERS`` tasks, so a large day is not one task and a small one few files.
    """
    bucket = F.pmod(F.xxhash64("domain"), F.lit(WRITERS))
    obs.withColumn("day", F.to_date("observed_at")).repartition("kind", "day", bucket).write.mode("append").partitionBy("kind", "day").parquet(path)


def read_obs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
