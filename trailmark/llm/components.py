"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.scratch import Scratch


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours link to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours link to the least of them. Here v < u in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(u, v): every node of edges (u, v) but the least of its component, with that least node.

    Hubs are safe: minima are aggregated before the shuffle, and the joins are plain ones that adaptive
    execution splits. Each round is a written table; only a count and a sum of hashes reach the driver.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = None
    for k in range(most_rounds):
        now = scratch.keep(small_star(large_star(now)), f"round{k}")
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if k:
            scratch.drop(f"round{k - 1}")
        if mark == new:
            return now
        mark = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def only_first(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are the first of their component; same columns. rows: (id, text_hash, component_id,
    first_hash) of each, the component's least id and least text hash. Rows of one id are one document; rows
    without an id stay only where no row of the component has one, and then one row does."""
    has_id, names = F.col("component_id").isNotNull(), docs.columns
    first = F.when(has_id, F.col("id").eqNullSafe(F.col("component_id"))).otherwise(F.col("text_hash") == F.col("first_hash"))
    later = rows.where(~first).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    keyed = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    kept = keyed.join(later, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left_anti")
    null = F.col(f"`{id_col}`").isNull()
    if rows.where("id IS NULL").isEmpty():
        return kept.select(*[F.col(f"`{c}`") for c in names])
    return kept.where(~null).unionByName(kept.where(null).dropDuplicates(["__own"])).select(*[F.col(f"`{c}`") for c in names])


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the edges of one task, without the least nodes themselves."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]
