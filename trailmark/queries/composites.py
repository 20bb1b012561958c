"""Queries that chain several operators as a user's script would."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import activity, fits, intervals, series, signal, spatial
from trailmark.queries.base import PTS, points, query
from trailmark.queries.places import sampled_axes
from trailmark.queries.series import LEVEL_SQL, PATHS_SQL, VISITS_SQL, counted, day, visited

#: The span that the report and the single path are of; the report's last day is included.
FROM, TO = "2024-01-08", "2024-01-15"


@query("c03_build_visits", f"WITH {PTS}, {VISITS_SQL} SELECT *, row_number() OVER (PARTITION BY id ORDER BY start_time, zone) AS position FROM visits")
def c03(spark, sf):
    return visited(spark, sf).withColumn("position", F.row_number().over(series.ordered("id", "start_time", "zone")))


@query("c04_detect_path", f"WITH {PTS}, spaces AS (SELECT DISTINCT id, TIMESTAMP '{FROM}' AS from_time, TIMESTAMP '{TO}' AS to_time FROM pts), {PATHS_SQL} SELECT * FROM paths")
def c04(spark, sf):
    p = points(spark, sf)
    at = lambda t: F.to_timestamp_ntz(F.lit(f"{t} 00:00:00"))
    between = p.select("id").distinct().select("id", at(FROM).alias("from_time"), at(TO).alias("to_time"))
    return intervals.paths(p, between, "id", "ts", "event_id", 4 * 3600, x="k", y="value").drop("segments")


@query("c08_span_report", f"WITH {PTS} SELECT id, date_trunc('day', ts) AS day, {', '.join(f'count(*) FILTER (WHERE {LEVEL_SQL} = {n!r}) AS {n}' for n in ('sedentary', 'light', 'moderate', 'vigorous'))}, count(*) AS total, 22 AS recommended FROM pts WHERE CAST(ts AS DATE) BETWEEN DATE '{FROM}' AND DATE '{TO}' GROUP BY id, day HAVING count(*) >= 4")
def c08(spark, sf):
    return activity.span_report(counted(spark, sf), "id", "ts", "counts", FROM, TO, least_rows=4)


@query("c12_first_cell", f"WITH {PTS}, c AS (SELECT DISTINCT id, date_trunc('hour', ts) AS hour, k / 10.0 AS n, value / 10 AS e FROM pts) SELECT id, hour, CAST(trunc(min(struct_pack(n := n, e := e)).n) AS BIGINT) AS n, CAST(trunc(min(struct_pack(n := n, e := e)).e) AS BIGINT) AS e FROM c GROUP BY ALL")
def c12(spark, sf):
    p = points(spark, sf).groupBy("id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.collect_set(F.struct((F.col("k") / 10).alias("n"), (F.col("value") / 10).alias("e"))).alias("cells"))
    return spatial.first_cell(p, "cells").drop("cells")


@query("m02_axis_counts")
def m02(spark, sf):
    return signal.activity_counts(sampled_axes(spark), "pid", "ts").select("pid", "second", "x_count", "y_count", "z_count", F.round("summary_count", 6).alias("summary_count"))


@query("m08_fit_metrics")
def m08(spark, sf):
    h = activity.histogram(counted(spark, sf), ["id"], "counts", 0, 10000, 100)
    fitted = fits.piecewise_fits(activity.log_frequencies(activity.trimmed_tail(h, ["id"]), ["id"], 0, 100), "id")
    return fitted.select("id", *[F.round(c, 6).alias(c) for c in ("r2", "mse", "exp_var", "aic", "bic")])


@query("c15_file_axes")
def c15(spark, sf):
    return signal.axes(signal.activity_counts(sampled_axes(spark), "pid", "ts"), "pid")
