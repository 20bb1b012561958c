"""Paths over cost rasters and road networks, points along them, communities."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Moves to the eight neighbours (north, east), in the order that settles ties.
MOVES = ((0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))
#: Metres beyond which no path over a raster is sought.
LONGEST_SEARCH = 5000.0
#: Parts of the searches over the same tiles, for each of Spark's partitions.
PARTS = 4


def octile(a: tuple[int, int], b: tuple[int, int]) -> float:
    """Steps between cells, a diagonal one counting the square root of two."""
    dn, de = abs(a[0] - b[0]), abs(a[1] - b[1])
    return math.sqrt(2) * min(dn, de) + abs(dn - de)


def raster_path(cost: dict[tuple[int, int], float], start: tuple[int, int], goal: tuple[int, int], limits: tuple[int, int, int, int] | None = None) -> list[tuple[int, int]]:
    """Cells of a cheap path by A*: the cost of entered cells plus the octile steps left. A cell that is found
    anew at a lower cost queues again behind equal ones. limits: least and greatest north and east of cells
    that may be entered. Empty if there is none."""
    done, best, parent = set(), {start: 0.0}, {}
    queue, number, current = [(0.0, 0, start)], 0, {start: 0}
    while queue:
        _, k, at = heapq.heappop(queue)
        if at in done or current.get(at) != k:
            continue
        done.add(at)
        if at == goal:
            path = [at]
            while at in parent:
                at = parent[at]
                path.append(at)
            return path[::-1]
        for dn, de in MOVES:
            to = (at[0] + dn, at[1] + de)
            if to in done or to not in cost or limits and not (limits[0] <= to[0] <= limits[1] and limits[2] <= to[1] <= limits[3]):
                continue
            g = best[at] + cost[to]
            if to not in best or g < best[to]:
                number += 1
                best[to], parent[to], current[to] = g, at, number
                heapq.heappush(queue, (g + octile(to, goal), number, to))
    return []


def along(points: list[tuple[float, float]], n: int) -> list[tuple[float, float]]:
    """n evenly spaced points of a line between its ends, and the ends; one between at least."""
    xy = np.array(points, float)
    at = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))]) if len(xy) > 1 else np.zeros(1)
    wanted = np.linspace(0, at[-1], max(n, 1) + 2)
    return list(zip(np.interp(wanted, at, xy[:, 0]).tolist(), np.interp(wanted, at, xy[:, 1]).tolist(), strict=True))


def dijkstra(edges: dict[int, list[tuple[int, float]]], start: int, goal: int) -> tuple[float, list[int]]:
    """Length and nodes of a shortest path; infinity and nothing if there is none. Ties go to lesser nodes."""
    queue, done, parent = [(0.0, start, -1)], set(), {}
    while queue:
        d, at, came = heapq.heappop(queue)
        if at in done:
            continue
        done.add(at)
        parent[at] = came
        if at == goal:
            path = []
            while at != -1:
                path.append(at)
                at = parent[at]
            return d, path[::-1]
        for to, length in edges.get(at, ()):
            if to not in done:
                heapq.heappush(queue, (d + length, to, at))
    return math.inf, []


def raster_fill(gaps: DataFrame, raster: DataFrame, size: float, margin: int = 20, longest: float = LONGEST_SEARCH, keep: Sequence[str] = ("gap_id",)) -> DataFrame:
    """(gap_id or what is to be kept of gaps, k, n, e): cells along a cheap path of each gap (gap_id, n0, e0, n1, e1,
    missing) with one for every missing minute. Gaps of equal ends are searched once, whatever their length. Searches
    that need the same tiles of the raster (n, e, cost) share tasks, which get these tiles once, so no task holds all
    of it; each keeps to its own clip. Ends that are equal stay, and where the raster has no path it is the line between
    the ends; ends too far apart are left out."""
    ends = ["n0", "e0", "n1", "e1"]
    distance = F.sqrt(F.pow(F.col("n1") - F.col("n0"), 2) + F.pow(F.col("e1") - F.col("e0"), 2)) * size
    once = gaps.where(distance <= longest).groupBy(*ends).agg(F.collect_set("missing").alias("lengths"))
    tile = 64
    low = lambda a, b: F.floor((F.least(a, b) - margin) / tile)
    high = lambda a, b: F.floor((F.greatest(a, b) + margin) / tile)
    tiles = {"tn0": low("n0", "n1"), "tn1": high("n0", "n1"), "te0": low("e0", "e1"), "te1": high("e0", "e1")}
    partitions = PARTS * int(gaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*tiles, "part"]
    searches = once.withColumns(tiles).withColumn("part", F.pmod(F.xxhash64(*ends), F.lit(partitions)))
    # under names of their own, as both sides of the groups come from the gaps
    wanted = searches.select(*[F.col(c).alias(c) for c in key]).distinct().withColumn("tn", F.explode(F.sequence("tn0", "tn1"))).withColumn("te", F.explode(F.sequence("te0", "te1")))
    cells = raster.withColumn("tn", F.floor(F.col("n") / tile)).withColumn("te", F.floor(F.col("e") / tile))
    # searches take long for their bytes, so their partitions are not to be merged
    dealt = lambda df: df.repartition(partitions, *key).groupBy(*key)

    def search(asked: pd.DataFrame, clip: pd.DataFrame) -> pd.DataFrame:
        cost = dict(zip(zip(clip["n"].tolist(), clip["e"].tolist(), strict=True), clip["cost"].tolist(), strict=True))
        rows = []
        for n0, e0, n1, e1, lengths in zip(*(asked[c].tolist() for c in ends), asked["lengths"], strict=True):
            start, goal = (n0, e0), (n1, e1)
            limits = (min(n0, n1) - margin, max(n0, n1) + margin, min(e0, e1) - margin, max(e0, e1) + margin)
            path = [start] if start == goal else raster_path(cost, start, goal, limits) or [start, goal]
            for missing in lengths.tolist():
                at = along(path, missing)[1:-1][:missing]
                rows.append((n0, e0, n1, e1, missing, [round(a) for a, _ in at], [round(b) for _, b in at]))
        return pd.DataFrame(rows, columns=[*ends, "missing", "ns", "es"])

    placed = dealt(searches).cogroup(dealt(wanted.join(cells, ["tn", "te"]).select(*key, "n", "e", "cost"))).applyInPandas(
        search, "n0 long, e0 long, n1 long, e1 long, missing int, ns array<int>, es array<int>"
    )
    at = F.posexplode(F.arrays_zip("ns", "es")).alias("k", "at")
    return gaps.join(placed, ["missing", *ends]).select(*keep, at).select(*keep, (F.col("k") + 1).alias("k"), F.col("at.ns").alias("n"), F.col("at.es").alias("e"))


def road_paths(trips: DataFrame, edges: Iterable[tuple[int, int, float]], places: dict[int, tuple[float, float]], n_col: str = "points") -> DataFrame:
    """(trip_id, length, path, line): shortest paths over an undirected road network that the caller bounds,
    with so many points along each. trips: (trip_id, source, target, points)."""
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for a, b, length in sorted(edges):
        near[a].append((b, length))
        near[b].append((a, length))
    shared = trips.sparkSession.sparkContext.broadcast((dict(near), places))

    def route(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        graph, at = shared.value
        for pdf in batches:
            rows = []
            for t, a, b, n in zip(pdf["trip_id"], pdf["source"], pdf["target"], pdf[n_col], strict=True):
                length, path = dijkstra(graph, int(a), int(b))
                line = along([at[p] for p in path], int(n)) if path else []
                rows.append((t, None if math.isinf(length) else length, path, [{"x": x, "y": y} for x, y in line]))
            yield pd.DataFrame(rows, columns=["trip_id", "length", "path", "line"])

    return trips.mapInPandas(route, "trip_id long, length double, path array<long>, line array<struct<x:double,y:double>>")


def louvain(edges: list[tuple[int, int, float]], first: dict[int, int] | None = None) -> dict[int, int]:
    """Community of each node of a small weighted graph by greedy modularity moves, then the same over the
    communities until nothing moves. first: communities to begin with."""
    weight: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        weight[a][b] += w
        weight[b][a] += w
    total = sum(sum(x.values()) for x in weight.values()) or 1.0
    of = local_moves(weight, total, {n: (first or {}).get(n, n) for n in weight})
    while True:
        merged: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for a, row in weight.items():
            for b, w in row.items():
                merged[of[a]][of[b]] += w
        upper = local_moves(merged, total, {c: c for c in merged})
        new = {n: upper[c] for n, c in of.items()}
        if len(set(new.values())) == len(set(of.values())):
            return of
        of = new


def local_moves(weight: dict[int, dict[int, float]], total: float, of: dict[int, int]) -> dict[int, int]:
    """Moves nodes to the neighbouring community of most gain in modularity, until none gains."""
    of = dict(of)
    degree = {n: sum(weight[n].values()) for n in weight}
    inside: dict[int, float] = defaultdict(float)
    for n, c in of.items():
        inside[c] += degree[n]
    moved = True
    while moved:
        moved = False
        for n in sorted(weight):
            links: dict[int, float] = defaultdict(float)
            for m, w in weight[n].items():
                if m != n:
                    links[of[m]] += w
            inside[of[n]] -= degree[n]
            score = {c: round(links.get(c, 0.0) - inside.get(c, 0.0) * degree[n] / total, 12) for c in {*links, of[n]}}
            best = max(sorted(score), key=lambda c: (score[c], c == of[n]))  # noqa: B023
            moved |= best != of[n]
            of[n] = best
            inside[best] = inside.get(best, 0.0) + degree[n]
    return of
