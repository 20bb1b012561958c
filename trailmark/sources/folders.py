"""Tables and files in the folder that driver and executors share, and on local or remote paths."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, one of our own on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file:///tmp/checkpoints").rstrip("/")


class Kept:
    """Written steps of an iterative operator: later steps read files, so lineage stays short."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Typed scan of CSV files with headers; only the named columns are parsed."""
    df = spark.read.schema(schema).csv(path, header=True, **options)
    return df.select(*columns) if columns else df


def append_csv(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Create or append CSV files, in folders by the given columns."""
    writer = df.write.mode("append").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def append_table(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Create or append Parquet files, one folder for each key."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_keys(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write the keys that df holds anew and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def not_done(df: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key the output does not have yet."""
    return df.join(done.select(*on).distinct(), list(on), "left_anti")


def jdbc_options(prefix: str = "DB") -> dict[str, str]:
    """Connection options from the environment: <prefix>_URL, _USER, _PASSWORD, _DRIVER."""
    names = {"url": "URL", "user": "USER", "password": "PASSWORD", "driver": "DRIVER"}
    return {k: os.environ[f"{prefix}_{v}"] for k, v in names.items() if f"{prefix}_{v}" in os.environ}


def read_query(spark: SparkSession, query: str, options: dict[str, str]) -> DataFrame:
    """A query that the database runs."""
    return spark.read.format("jdbc").options(**options).option("query", query).load()


def first_and_last(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The n first rows and the n last ones; a row that is both comes twice."""
    down = [F.desc(c) for c in order]
    return df.orderBy(*order).limit(n).unionByName(df.orderBy(*down).limit(n))
