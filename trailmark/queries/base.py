"""Registry of the queries, and the roles that the driver's tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under a name, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """events as a participant's series: (event_id, id, ts, event_type, value, k, zone)."""
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    zone = (F.floor(k / 50) * 100 + F.floor(F.least(F.col("value"), F.lit(149.0)) / 50)).cast("long")
    return e.select("event_id", F.col("user_id").alias("id"), "ts", "event_type", "value", k.alias("k"), zone.alias("zone"))


#: The same in SQL.
PTS = """pts AS (SELECT event_id, user_id AS id, ts, event_type, value, k,
  CAST(floor(k / 50.0) * 100 + floor(least(value, 149.0) / 50.0) AS BIGINT) AS zone
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""
#: A participant's rows in order.
BY = "OVER (PARTITION BY id ORDER BY ts, event_id)"
#: Time thresholds for events, which are hours apart.
GAP, MERGE, VISIT = 6 * 3600, 12 * 3600, 1800
