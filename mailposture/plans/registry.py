"""Registry of the queries over the test tables: a Spark job and, where SQL can state it, the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailposture.plans.tables import Tables, with_views

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BODY: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``job(tables) -> DataFrame`` under ``name``."""

    def register(job: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in RUN:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return job(Tables(spark, sf_dir))

        RUN[name] = run
        if sql is not None:
            BODY[name] = sql
            SQL[name] = with_views(sql)
        return job

    return register


def r6(df: DataFrame) -> DataFrame:
    """All double columns rounded to 6 places, so that the order of summation does not show."""
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})
