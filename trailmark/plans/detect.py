"""Trip detection: points to gaps, density hotspots, zones, dwells, visits, paths and incidents."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.operators import intervals, series, spatial
from trailmark.sources.folders import Kept


@dataclass(frozen=True)
class TripParams:
    cell_size: float = 10.0
    bandwidth: float = 100.0
    gap: float = 300.0
    downsample: int = 5
    min_visit_duration: float = 300.0
    min_visit_timespan: float = 3600.0
    min_hotspot_keep: float = 150.0
    min_path_keep: float = 30.0
    min_loop: float = 300.0
    max_drop: float = 3600.0
    kernel_threshold: float = 0.2
    max_raster: int = 30_000
    split_on_drop: bool = True


#: For series whose rows are hours apart and whose plane is a hundred units wide.
EVENT_SCALE = replace(TripParams(), cell_size=5.0, bandwidth=20.0, gap=6 * 3600.0, min_visit_duration=1800.0, min_visit_timespan=12 * 3600.0, min_hotspot_keep=600.0, max_drop=4 * 3600.0)


@dataclass(frozen=True)
class Trips:
    points: DataFrame
    hotspots: DataFrame
    visits: DataFrame
    paths: DataFrame
    gaps: DataFrame
    incidents: DataFrame


def cell_size_for(width: float, height: float, params: TripParams) -> float:
    """The cell size, doubled until neither side has more cells than the raster's limit."""
    size = params.cell_size
    while max(width, height) / size > params.max_raster:
        size *= 2
    return size


def zoned(points: DataFrame, key: str, params: TripParams, kept: Kept) -> tuple[DataFrame, DataFrame]:
    """Points with the density at their cell and the zone of its peak (0 outside), and the zones' centres."""
    cells = spatial.above_mean(spatial.density(points, key, params.bandwidth, params.cell_size), key)
    cells = kept.write(cells, "cells")
    basins = spatial.basins(cells, key)
    peaks = basins.select(key, "peak_n", "peak_e").distinct().withColumn("zone", F.row_number().over(W.partitionBy(key).orderBy("peak_n", "peak_e")).cast("long"))
    zones = kept.write(basins.join(peaks, [key, "peak_n", "peak_e"]).join(cells, [key, "n", "e"]).select(key, "n", "e", "density", "zone"), "zones")
    centres = zones.groupBy(key, "zone").agg((F.sum(F.col("e") * F.col("density")) / F.sum("density") * params.cell_size).alias("centroid_x"), (F.sum(F.col("n") * F.col("density")) / F.sum("density") * params.cell_size).alias("centroid_y"))
    at = points.withColumn("n", F.ceil(F.col("y") / params.cell_size)).withColumn("e", F.ceil(F.col("x") / params.cell_size))
    out = at.join(zones, [key, "n", "e"], "left").drop("n", "e")
    return out.withColumn("zone", F.coalesce("zone", F.lit(0).cast("long"))).withColumn("density", F.coalesce("density", F.lit(0.0))), centres


def detect_trips(points: DataFrame, key: str, time: str, tiebreak: str, params: TripParams | None = None) -> Trips:
    """All tables of the detection for points (key, time, tiebreak, x, y). Participants are independent: every
    step is partitioned by them. Gaps are of all points, density and paths of the downsampled ones."""
    params = params or TripParams()
    kept = Kept(points.sparkSession, "trips")
    order = [time, tiebreak]
    gaps = series.data_gaps(points, key, time, tiebreak, params.gap)
    thin = kept.write(series.downsample(points, key, time, tiebreak, params.downsample), "thin")
    placed, centres = zoned(thin, key, params, kept)
    scored = intervals.zone_scores(series.convolve(placed, key, order, "density", intervals.BUFFER_WEIGHT, "modified"), key, "zone", "density", "norm_kernel")
    scored = intervals.zone_scores(scored, key, "zone", "density", "norm_modified", F.col("modified"))
    hit = (F.col("norm_kernel") > params.kernel_threshold) | (F.col("norm_modified") > params.kernel_threshold)
    linked = kept.write(intervals.snapped_zone(scored, key, order, "zone", hit, "linked").drop("zone").withColumnRenamed("linked", "zone"), "linked")
    dwells = kept.write(intervals.dwells(linked, key, "zone", time, tiebreak, params.gap), "dwells")
    totals = intervals.zone_totals(dwells, key, params.min_hotspot_keep)
    hotspots = kept.write(centres.join(totals, [key, "zone"]), "hotspots")
    visits = kept.write(intervals.visits(dwells, key, params.min_visit_timespan, params.min_visit_duration), "visits")
    snapped = intervals.snap_points(linked, visits, hotspots.select(key, "zone", "centroid_x", "centroid_y"), key, time)
    stops = visits.select(key, "start_time", "stop_time").unionByName(intervals.outside(gaps, visits, key))
    spaces = kept.write(intervals.complement(stops, points, key, time), "spaces")
    paths = intervals.paths(snapped, spaces, key, time, tiebreak, params.max_drop, params.min_path_keep, split_on_drop=params.split_on_drop)
    paths = kept.write(intervals.without_loops(paths, params.min_loop), "paths")
    incidents = intervals.incidents(paths, visits, gaps, hotspots.select(key, "zone", "centroid_x", "centroid_y"), key)
    return Trips(snapped, hotspots, visits, paths, gaps, incidents)
