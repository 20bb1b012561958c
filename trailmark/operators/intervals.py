"""Interval tables of dwells, visits, paths and incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.operators.series import ordered, seconds, with_breaks

#: Weights of the kernel values around a row, the rows that a zone is looked for in, and default limits (s, m).
BUFFER_WEIGHT = (0.1, 0.25, 0.3, 0.25, 0.1)
SIGNIFICANT_GAP, MIN_VISIT_TIMESPAN, MIN_VISIT_DURATION, MIN_PATH_KEEP, MIN_LOOP = 300.0, 3600.0, 300.0, 30.0, 300.0


def dwells(df: DataFrame, key: str, zone: str, time: str, tiebreak: str, gap: float) -> DataFrame:
    """(key, zone, start_time, stop_time, duration): stays in a zone (not 0), parted by gaps too."""
    w = ordered(key, time, tiebreak)
    new = ~F.col(zone).eqNullSafe(F.lag(zone).over(w)) | (seconds(F.col(time), F.lag(time).over(w)) > gap)
    rows = with_breaks(df.withColumn("__b", new), key, F.col("__b"), [time, tiebreak], "island")
    out = rows.where(F.col(zone) != 0).groupBy(key, "island").agg(F.first(zone).alias("zone"), F.min(time).alias("start_time"), F.max(time).alias("stop_time"))
    return out.withColumn("duration", seconds(F.col("stop_time"), F.col("start_time"))).drop("island")


def zone_totals(dwell: DataFrame, key: str, longer_than: float) -> DataFrame:
    """(key, zone, total_duration) of the zones that are stayed in for longer than a limit."""
    return dwell.groupBy(key, "zone").agg(F.sum("duration").alias("total_duration")).where(F.col("total_duration") > longer_than)


def visits(dwell: DataFrame, key: str, timespan: float = MIN_VISIT_TIMESPAN, longer_than: float = MIN_VISIT_DURATION) -> DataFrame:
    """Dwells of one zone that follow within the timespan merged; the longer ones stay."""
    w = ordered(key, "start_time", "zone")
    new = ~(F.col("zone").eqNullSafe(F.lag("zone").over(w)) & (seconds(F.col("start_time"), F.lag("stop_time").over(w)) <= timespan))
    rows = with_breaks(dwell.withColumn("__b", new), key, F.col("__b"), ["start_time", "zone"], "visit")
    out = rows.groupBy(key, "visit").agg(F.first("zone").alias("zone"), F.min("start_time").alias("start_time"), F.max("stop_time").alias("stop_time"))
    return out.withColumn("duration", seconds(F.col("stop_time"), F.col("start_time"))).where(F.col("duration") > longer_than).drop("visit")


def snap_points(points: DataFrame, visit: DataFrame, spots: DataFrame, key: str, time: str, x: str = "x", y: str = "y") -> DataFrame:
    """Points of a visit (bounds included) at its hotspot's centre; all others, and those without a hotspot,
    where they are. spots: (key, zone, centroid_x, centroid_y)."""
    placed = visit.join(spots, [key, "zone"]).select(F.col(key).alias("__k"), "start_time", "stop_time", "centroid_x", "centroid_y", F.col("zone").alias("snapped_zone"))
    on = (F.col(key) == F.col("__k")) & F.col(time).between(F.col("start_time"), F.col("stop_time"))
    out = points.join(placed, on, "left").withColumn(x, F.coalesce("centroid_x", x)).withColumn(y, F.coalesce("centroid_y", y))
    return out.drop("__k", "start_time", "stop_time", "centroid_x", "centroid_y")


def outside(gaps: DataFrame, visit: DataFrame, key: str) -> DataFrame:
    """Gaps that lie strictly inside no visit."""
    v = visit.select(F.col(key).alias("__k"), F.col("start_time").alias("__a"), F.col("stop_time").alias("__b"))
    return gaps.join(v, (F.col(key) == F.col("__k")) & (F.col("start_time") > F.col("__a")) & (F.col("stop_time") < F.col("__b")), "left_anti")


def complement(stops: DataFrame, points: DataFrame, key: str, time: str) -> DataFrame:
    """(key, from_time, to_time): what lies before, between and after a participant's stops; the last one
    ends a second after the last point."""
    w = ordered(key, "start_time", "stop_time")
    ends = points.groupBy(key).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    inner = stops.select(key, F.max("stop_time").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.col("start_time"))
    rows = inner.join(ends, key, "right")
    head = rows.where(F.col("start_time").isNotNull()).select(key, F.coalesce("before", "first").alias("from_time"), F.col("start_time").alias("to_time"))
    last = stops.groupBy(key).agg(F.max("stop_time").alias("stop"))
    tail = ends.join(last, key, "left").select(key, F.coalesce("stop", "first").alias("from_time"), (F.col("last") + F.expr("INTERVAL 1 SECOND")).alias("to_time"))
    return head.unionByName(tail).where(F.col("from_time") < F.col("to_time")).distinct()


def paths(points: DataFrame, spaces: DataFrame, key: str, time: str, tiebreak: str, max_drop: float, longer_than: float = MIN_PATH_KEEP, x: str = "x", y: str = "y", zone: str = "zone", split_on_drop: bool = True) -> DataFrame:
    """Paths in the half-open spaces between stops: split where rows are further apart than max_drop, rows at
    the same place as the next one dropped, and at least two points and more than ``longer_than`` seconds."""
    s = spaces.select(F.col(key).alias("__k"), "from_time", "to_time")
    inside = points.join(s, (F.col(key) == F.col("__k")) & (F.col(time) >= F.col("from_time")) & (F.col(time) < F.col("to_time"))).drop("__k")
    group = [key, "from_time"]
    w = ordered(group, time, tiebreak)
    far = (seconds(F.col(time), F.lag(time).over(w)) > max_drop) if split_on_drop else F.lit(False)
    parts = inside.withColumn("__b", F.coalesce(far, F.lit(False)).cast("long")).withColumn("part", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    wp = ordered([*group, "part"], time, tiebreak)
    moved = parts.withColumn("__same", (F.col(x) == F.lead(x).over(wp)) & (F.col(y) == F.lead(y).over(wp))).where(~F.coalesce("__same", F.lit(False)))
    place = F.struct(time, tiebreak)
    out = moved.groupBy(*group, "part").agg(
        F.min(time).alias("start_time"), F.max(time).alias("stop_time"),
        F.min_by(x, place).alias("start_x"), F.min_by(y, place).alias("start_y"), F.min_by(zone, place).alias("start_location_id"),
        F.max_by(x, place).alias("stop_x"), F.max_by(y, place).alias("stop_y"), F.max_by(zone, place).alias("stop_location_id"),
        F.count("*").alias("num_segments"),
        F.transform(F.array_sort(F.collect_list(F.struct(time, tiebreak, x, y))), lambda p: F.struct(p[x].alias("x"), p[y].alias("y"))).alias("segments"),
    )
    out = out.withColumn("duration", seconds(F.col("stop_time"), F.col("start_time")))
    return out.where((F.col("num_segments") > 1) & (F.col("duration") > longer_than)).drop("part", "from_time")


def without_loops(path: DataFrame, shorter_than: float = MIN_LOOP) -> DataFrame:
    """Paths but short ones that end in the zone they began in."""
    loop = (F.col("start_location_id") == F.col("stop_location_id")) & (F.col("start_location_id") != 0) & (F.col("duration") < shorter_than)
    return path.where(~F.coalesce(loop, F.lit(False)))


def incidents(path: DataFrame, visit: DataFrame, gaps: DataFrame, spots: DataFrame, key: str) -> DataFrame:
    """Trips, visits with their hotspot's place, and gaps that no visit holds, as one table."""
    null = lambda name: F.lit(None).cast("double").alias(name)
    trips = path.select(key, "start_time", "stop_time", "start_location_id", "stop_location_id", "start_x", "start_y", "stop_x", "stop_y", F.lit("trip").alias("type"))
    v = visit.join(spots, [key, "zone"], "left")
    stays = v.select(key, "start_time", "stop_time", F.col("zone").alias("start_location_id"), F.col("zone").alias("stop_location_id"), F.col("centroid_x").alias("start_x"), F.col("centroid_y").alias("start_y"), F.col("centroid_x").alias("stop_x"), F.col("centroid_y").alias("stop_y"), F.lit("visit").alias("type"))
    none = outside(gaps, visit, key).select(key, "start_time", "stop_time", F.lit(None).cast("long").alias("start_location_id"), F.lit(None).cast("long").alias("stop_location_id"), null("start_x"), null("start_y"), null("stop_x"), null("stop_y"), F.lit("gap").alias("type"))
    return trips.unionByName(stays).unionByName(none)


def zone_scores(df: DataFrame, key: str, zone: str, column: str, into: str, of: Column | None = None) -> DataFrame:
    """z-score of a column by the mean and sample deviation of its zone; null where there is no spread. of:
    another value scored by the same mean and deviation."""
    w = W.partitionBy(key, zone)
    sd = F.stddev_samp(column).over(w)
    value = F.col(column) if of is None else of
    return df.withColumn(into, F.when(sd > 0, (value - F.avg(column).over(w)) / sd))


def snapped_zone(df: DataFrame, key: str, order: Sequence, zone: str, hit: Column, into: str, reach: int = 2) -> DataFrame:
    """The row's zone if a hit of that zone is within reach rows, else 0."""
    w = ordered(key, *order).rowsBetween(-reach, reach)
    near = F.array_contains(F.collect_list(F.when(F.coalesce(hit, F.lit(False)), F.col(zone))).over(w), F.col(zone))
    return df.withColumn(into, F.when((F.col(zone) != 0) & near, F.col(zone)).otherwise(F.lit(0).cast("long")))
