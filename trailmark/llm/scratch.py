"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Used only where the session names no checkpoint folder (tests on one machine).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, one of our own on one machine, else an error."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


#: Murmur3 of 32 bits, by which Spark deals rows out: its multipliers, addend, and the seed Spark takes.
MURMUR_KEY, MURMUR_END, MURMUR_ADD, SPARK_SEED = (0xCC9E2D51, 0x1B873593), (0x85EBCA6B, 0xC2B2AE35), 0xE6546B64, 42
WORD = 0xFFFFFFFF


def hashes_to(number: Column) -> Column:
    """The int whose hash in Spark is number (from 0 to below 2 ** 31). Rows that are dealt out by it go to
    partition or bucket number % n of n, so consecutive numbers share no bucket before all have one."""
    inverse = lambda c: pow(c, -1, 1 << 32)
    # 32-bit product in halves, which overflows no long
    times = lambda x, c: (x.bitwiseAND(0xFFFF) * F.lit(c) + F.shiftleft((F.shiftright(x, 16) * F.lit(c)).bitwiseAND(0xFFFF), 16)).bitwiseAND(WORD)
    turned = lambda x, s: F.shiftright(x, s).bitwiseOR(F.shiftleft(x, 32 - s).bitwiseAND(WORD))
    steps = (
        lambda h: h.bitwiseXOR(F.shiftright(h, 16)),
        lambda h: times(h, inverse(MURMUR_END[1])),
        lambda h: h.bitwiseXOR(F.shiftright(h, 13)).bitwiseXOR(F.shiftright(h, 26)),
        lambda h: times(h, inverse(MURMUR_END[0])),
        lambda h: h.bitwiseXOR(F.shiftright(h, 16)).bitwiseXOR(F.lit(4).cast("long")),
        lambda h: times((h - F.lit(MURMUR_ADD)).bitwiseAND(WORD), inverse(5)),
        lambda h: turned(h, 13).bitwiseXOR(F.lit(SPARK_SEED).cast("long")),
        lambda h: times(h, inverse(MURMUR_KEY[1])),
        lambda h: turned(h, 15),
        lambda h: times(h, inverse(MURMUR_KEY[0])),
        lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h),
    )
    h = F.array(number.cast("long"))
    for step in steps:
        h = F.transform(h, step)
    return h[0].cast("int")


class Scratch:
    """Tables of one run under one folder. What is written there cuts lineage: a lost executor costs
    only the tasks that it ran, since every later step reads files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.tag = f"{name}_{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark)}/{self.tag}"
        self.tables: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Write df dealt out by key, so that later groupings by key read it without a shuffle."""
        table = f"{self.tag}_{name}"
        (
            df.repartition(buckets, key)
            .write.option("compression", "zstd")
            .option("path", self.path(name))
            .bucketBy(buckets, key)
            .sortBy(key)
            .saveAsTable(table)
        )
        self.tables.append(table)
        return self.spark.table(table)

    def release(self) -> None:
        """Let Spark's cleaner drop shuffle files whose data have been written."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete the named tables, or everything that was written."""
        for name in names or [""]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        for table in [t for t in self.tables if not names or t.removeprefix(f"{self.tag}_") in names]:
            self.spark.sql(f"DROP TABLE IF EXISTS `{table}`")
            self.tables.remove(table)
