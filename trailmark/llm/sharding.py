"""Placement of rows on shards by a lookup table that permutations fill.

Every shard has a permutation of the slots of a prime-sized table, its order of preference. Shards take
turns (as often as their weight says) to claim the first free slot they prefer, until the table is full.
A row's key is hashed to a slot, so placement is one lookup. When a shard leaves, its slots go to others and
few other rows move. The table has a fixed number of slots whatever the data, so it is broadcast safely.

Defined results: a null key is hashed as the empty string; rows of equal keys share a shard (pass further
columns as key to split a hot one); an empty table gives an empty one; the two added columns replace
columns of their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; at least a hundred slots a shard keep shards within about a per cent of each other.
TABLE_SIZE = 65537
#: Hexadecimal digits of an MD5 digest that are taken as a number: 60 bits.
DIGITS = 15


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE) -> list[str]:
    """The shard of each slot. shards: names, or names with their turns a round. Order of names is no matter."""
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(shards, 1)
    if not weights or min(weights.values()) < 1:
        raise ValueError("at least one shard, and a turn or more for each")
    if not is_prime(size) or size < sum(weights.values()):
        raise ValueError("the table's size must be a prime, and at least the number of turns")
    table: list[str | None] = [None] * size
    names = sorted(weights)
    at = {n: number(f"{n}/offset") % size for n in names}
    skip = {n: number(f"{n}/skip") % (size - 1) + 1 for n in names}
    filled = 0
    while True:
        for n in names:
            for _ in range(weights[n]):
                while table[at[n]] is not None:
                    at[n] = (at[n] + skip[n]) % size
                table[at[n]] = n
                filled += 1
                if filled == size:
                    return table


def slot_of(keys: Sequence[Column], size: int = TABLE_SIZE) -> Column:
    """The slot that the keys' text hashes to."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") % size


def table_frame(spark: SparkSession, table: Sequence[str]) -> DataFrame:
    """(slot, shard) of a lookup table, from one literal."""
    names = sorted(set(table))
    place = {n: i for i, n in enumerate(names)}
    codes = F.split(F.lit(",".join(str(place[n]) for n in table)), ",")
    rows = spark.range(1).select(F.posexplode(codes).alias("slot", "code"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.element_at(F.array(*map(F.lit, names)), F.col("code").cast("int") + 1).alias("shard"))


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with the columns slot and shard; the rows are not moved."""
    table = table_frame(df.sparkSession, lookup_table(shards, size)).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    hashed = df.withColumn("__key_slot", slot_of([F.col(f"`{k}`") for k in keys], size))
    joined = hashed.join(F.broadcast(table), F.col("__key_slot") == F.col("__slot"))
    others = [c for c in df.columns if c not in (slot, shard)]
    return joined.select(*[F.col(f"`{c}`") for c in others], F.col("__key_slot").alias(slot), F.col("__shard").alias(shard))
