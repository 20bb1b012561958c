"""Resampling, windows, intervals and activity over the events of a participant."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.operators import activity, intervals, series, spatial
from trailmark.queries.base import BY, GAP, MERGE, PTS, VISIT, points, query, table
from trailmark.queries.scalars import LEVEL_SQL



def day():
    return F.date_trunc("day", "ts").cast("timestamp_ntz")


def is_worn():
    return F.col("event_type") != "error"


def counted(spark, sf):
    return points(spark, sf).withColumn("counts", F.col("value") * 20)


# --- aggregation and resampling


@query("a01_resample", f"WITH {PTS} SELECT id, date_trunc('day', ts) AS epoch, median(k) AS k, CAST(sum(zone) AS BIGINT) AS zone, arg_min(event_type, (ts, event_id)) AS event_type FROM pts GROUP BY id, epoch")
def a01(spark, sf):
    return series.resample(points(spark, sf), "id", day(), median=["k"], total=["zone"], first=["event_type"], order=["ts", "event_id"])


@query("a02_second_median", f"WITH {PTS} SELECT id, date_trunc('second', ts) AS epoch, median(k) AS k, median(value) AS value FROM pts GROUP BY ALL")
def a02(spark, sf):
    return series.resample(points(spark, sf), "id", F.date_trunc("second", "ts").cast("timestamp_ntz"), median=["k", "value"])


@query("a03_tick_median", f"WITH {PTS} SELECT id, CAST(epoch_us(ts) // 20000 AS BIGINT) AS tick, median(value) AS value FROM pts GROUP BY ALL")
def a03(spark, sf):
    tick = F.floor(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts")) / 20000)
    return series.resample(points(spark, sf), "id", tick, median=["value"], into="tick")


@query("a04_minute_means", f"WITH {PTS} SELECT id, date_trunc('minute', ts) AS epoch, round(avg(k), 6) AS k, round(avg(value), 6) AS value FROM pts GROUP BY ALL")
def a04(spark, sf):
    out = series.resample(points(spark, sf), "id", F.date_trunc("minute", "ts").cast("timestamp_ntz"), mean=["k", "value"])
    return out.withColumns({c: F.round(c, 6) for c in ("k", "value")})


BOUTS_SQL = f"""bouts AS (SELECT id, date_trunc('day', ts) AS epoch, {', '.join(f"CAST(count(*) FILTER (WHERE event_type <> 'error' AND {LEVEL_SQL} = '{n}') AS BIGINT) AS {n}" for n in ('sedentary', 'light', 'moderate', 'vigorous'))} FROM pts GROUP BY ALL)"""


@query("a06_activity_bouts", f"WITH {PTS}, {BOUTS_SQL} SELECT *, 1440 - sedentary - light - moderate - vigorous AS non_wear FROM bouts")
def a06(spark, sf):
    return activity.bouts(counted(spark, sf), "id", day(), "counts", is_worn(), 1440)


@query("a07_dominant_level", f"WITH {PTS}, {BOUTS_SQL}, b AS (SELECT *, 2 - sedentary - light - moderate - vigorous AS non_wear, greatest(2 - sedentary - light - moderate - vigorous, sedentary, light, moderate, vigorous) AS top FROM bouts) SELECT id, epoch, CASE WHEN non_wear = top THEN 'non_wear' WHEN sedentary = top THEN 'sedentary' WHEN light = top THEN 'light' WHEN moderate = top THEN 'moderate' ELSE 'vigorous' END AS dominant FROM b")
def a07(spark, sf):
    return activity.dominant(activity.bouts(counted(spark, sf), "id", day(), "counts", is_worn(), 2)).select("id", "epoch", "dominant")


@query("a08_daily_report", f"WITH {PTS} SELECT id, date_trunc('day', ts) AS day, {', '.join(f'count(*) FILTER (WHERE {LEVEL_SQL} = {n!r}) AS {n}' for n in ('sedentary', 'light', 'moderate', 'vigorous'))}, count(*) AS total, 22 AS recommended FROM pts GROUP BY id, day HAVING count(*) >= 4")
def a08(spark, sf):
    return activity.daily_report(counted(spark, sf), "id", day(), "counts", least_rows=4)


@query("a09_zone_scores", f"WITH {PTS} SELECT event_id, round(CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END, 6) AS z FROM pts WINDOW w AS (PARTITION BY id, zone)")
def a09(spark, sf):
    return intervals.zone_scores(points(spark, sf), "id", "zone", "value", "z").select("event_id", F.round("z", 6).alias("z"))


@query("a11_visit_frequency", f"WITH {PTS}, c AS (SELECT id, k // 25 AS a, floor(value / 25) AS b, count(*) AS times FROM pts GROUP BY ALL) SELECT times, count(*) AS cells FROM c GROUP BY times")
def a11(spark, sf):
    p = points(spark, sf).withColumn("a", F.floor(F.col("k") / 25)).withColumn("b", F.floor(F.col("value") / 25))
    return spatial.visit_frequency(p, ["id", "a", "b"])


@query("a12_cell_histogram", f"""WITH {PTS}, c AS (SELECT n, e FROM range(0, 10) a(n), range(0, 10) b(e)), h AS (SELECT k // 10 AS n, CAST(floor(value / 10) AS BIGINT) AS e, count(*) AS c FROM pts GROUP BY ALL)
SELECT c.n, c.e, coalesce(h.c, -1) AS visits FROM c LEFT JOIN h ON c.n = h.n AND c.e = h.e""")
def a12(spark, sf):
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("n"), (F.col("id") % 10).alias("e"))
    p = points(spark, sf).select(F.floor(F.col("k") / 10).alias("n"), F.floor(F.col("value") / 10).alias("e"))
    return cell_counts(p, cells)


def cell_counts(p, cells):
    p, cells = (d.select(F.col("n").alias("cn"), F.col("e").alias("ce")) for d in (p, cells))
    return spatial.cell_histogram(p, cells, ["cn", "ce"]).select(F.col("cn").alias("n"), F.col("ce").alias("e"), F.col("n").alias("visits"))


@query("a13_share_of_total", "SELECT event_type, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY event_type")
def a13(spark, sf):
    p = points(spark, sf)
    n = p.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("event_type", F.round(F.col("n") / F.col("total"), 9).alias("share"))


HIST_SQL = """hist AS (SELECT i.id, b.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT id FROM pts) i CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 100)) b
 LEFT JOIN (SELECT id, CAST(least(floor(value * 20 / 100), 99) AS INTEGER) AS bin, count(*) AS n FROM pts WHERE value * 20 BETWEEN 0 AND 10000 GROUP BY ALL) h ON h.id = i.id AND h.bin = b.bin)"""


@query("a14_histogram", f"WITH {PTS}, {HIST_SQL} SELECT * FROM hist")
def a14(spark, sf):
    return activity.histogram(counted(spark, sf), ["id"], "counts", 0, 10000, 100)


@query("a15_bin_counts", "SELECT round_even(value * 20 / 100, 0) * 100 AS bin, count(*) AS n FROM events GROUP BY ALL")
def a15(spark, sf):
    return counted(spark, sf).groupBy((F.rint(F.col("counts") / 100) * 100).alias("bin")).agg(F.count("*").alias("n"))


@query("a16_valid_participants", f"WITH {PTS}, d AS (SELECT id, date_trunc('day', ts) AS d FROM pts GROUP BY ALL HAVING count(*) > 2), g AS (SELECT id FROM d GROUP BY id HAVING count(*) > 13) SELECT event_id FROM pts WHERE id IN (SELECT id FROM g)")
def a16(spark, sf):
    return activity.valid_participants(points(spark, sf), "id", day(), 2, 13).select("event_id")


@query("a17_valid_days", f"""WITH {PTS}, r AS (SELECT *, CAST(round_even(epoch_us(ts) / 86400000000.0, 0) AS BIGINT) AS d, date_trunc('minute', ts) AS m FROM pts), d AS (SELECT id, d FROM r GROUP BY ALL HAVING count(DISTINCT m) > 2),
g AS (SELECT id FROM d GROUP BY id HAVING count(*) > 13) SELECT event_id FROM r WHERE (id, d) IN (SELECT (id, d) FROM d WHERE id IN (SELECT id FROM g))""")
def a17(spark, sf):
    p = points(spark, sf)
    return activity.valid_days(p, "id", activity.rounded_day(F.col("ts")), F.date_trunc("minute", "ts"), 2, 13).select("event_id")


@query("a19_block_sums", f"WITH {PTS}, r AS (SELECT id, value, (row_number() {BY} - 1) // 10 AS block FROM pts) SELECT id, block, round(sum(value), 6) AS total FROM r GROUP BY ALL")
def a19(spark, sf):
    p = points(spark, sf).withColumn("block", F.floor((F.row_number().over(series.ordered("id", "ts", "event_id")) - 1) / 10))
    return p.groupBy("id", "block").agg(F.round(F.sum("value"), 6).alias("total"))


@query("a22_distinct_ids", "SELECT DISTINCT user_id AS id FROM events")
def a22(spark, sf):
    return points(spark, sf).select("id").distinct()


@query("a23_quartiles", """WITH q AS (SELECT c_nationkey, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY ALL)
SELECT c_nationkey, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3, round(min(c_acctbal) FILTER (WHERE c_acctbal >= q1 - 1.5 * (q3 - q1)), 4) AS low, round(max(c_acctbal) FILTER (WHERE c_acctbal <= q3 + 1.5 * (q3 - q1)), 4) AS high FROM customer JOIN q USING (c_nationkey) GROUP BY c_nationkey, q1, q2, q3""")
def a23(spark, sf):
    out = activity.quartiles(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal")
    return out.select("c_nationkey", *[F.round(c, 4).alias(c) for c in ("q1", "q2", "q3", "low", "high")])


@query("a24_best_column", f"WITH {PTS} SELECT event_id, CASE WHEN k >= value AND k >= zone THEN 'k' WHEN value >= zone THEN 'value' ELSE 'zone' END AS best FROM pts")
def a24(spark, sf):
    return activity.dominant(points(spark, sf), ["k", "value", "zone"], "best").select("event_id", "best")


@query("a25_map_centre", f"WITH {PTS} SELECT id, round(avg(k), 6) AS k, round(avg(value), 6) AS value FROM pts GROUP BY id")
def a25(spark, sf):
    return points(spark, sf).groupBy("id").agg(F.round(F.avg("k"), 6).alias("k"), F.round(F.avg("value"), 6).alias("value"))


# --- windows


@query("w01_time_delta", f"WITH {PTS} SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) {BY}) / 1e6, 3) AS delta FROM pts")
def w01(spark, sf):
    return series.with_delta(points(spark, sf), "id", "ts", "event_id").select("event_id", F.round("delta", 3).alias("delta"))


GAPS_SQL = f"""gaps AS (SELECT id, lag(ts) {BY} - INTERVAL 1 SECOND AS start_time, ts - INTERVAL 1 SECOND AS stop_time, epoch_us(ts) - epoch_us(lag(ts) {BY}) AS gap FROM pts QUALIFY gap > {GAP * 1_000_000})"""


@query("w02_data_gaps", f"WITH {PTS}, {GAPS_SQL} SELECT id, stop_time - to_seconds(gap // 1000000) AS start_time, stop_time FROM gaps")
def w02(spark, sf):
    return series.data_gaps(points(spark, sf), "id", "ts", "event_id", GAP)


@query("w03_step_length", f"WITH {PTS} SELECT event_id, round(sqrt(power(k - lag(k) {BY}, 2) + power(value - lag(value) {BY}, 2)), 6) AS d FROM pts")
def w03(spark, sf):
    w = series.ordered("id", "ts", "event_id")
    return points(spark, sf).select("event_id", F.round(F.sqrt(F.pow(F.col("k") - F.lag("k").over(w), 2) + F.pow(F.col("value") - F.lag("value").over(w), 2)), 6).alias("d"))


RUNS_SQL = f"""marked AS (SELECT *, CASE WHEN zone IS NOT DISTINCT FROM lag(zone) {BY} AND row_number() {BY} > 1 THEN 0 ELSE 1 END AS new FROM pts),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT id, CAST(run AS BIGINT) AS run, any_value(zone) AS zone, min(ts) AS start_time, max(ts) AS end_time, count(*) AS duration FROM numbered GROUP BY id, run)"""


@query("w04_run_lengths", f"WITH {PTS}, {RUNS_SQL} SELECT * FROM runs")
def w04(spark, sf):
    return series.run_lengths(points(spark, sf), "id", "zone", "ts", "event_id")


MOVES_SQL = f"""{RUNS_SQL}, cut AS (SELECT *, CASE WHEN duration > 3 OR coalesce(lag(duration) OVER (PARTITION BY id ORDER BY run) > 3, false) THEN 1 ELSE 0 END AS c FROM runs),
seg AS (SELECT *, sum(c) OVER (PARTITION BY id ORDER BY run ROWS UNBOUNDED PRECEDING) AS segment FROM cut),
moves AS (SELECT id, CAST(segment AS BIGINT) AS segment, min(start_time) AS start_time, max(end_time) AS end_time, arg_min(zone, run) AS grid_cell, CAST(sum(duration) AS BIGINT) AS duration, count(*) AS trip_length FROM seg GROUP BY id, segment)"""


def moved(spark, sf):
    return series.movement(points(spark, sf), "id", "zone", "ts", "event_id", 3)


@query("w05_movement", f"WITH {PTS}, {MOVES_SQL} SELECT * FROM moves")
def w05(spark, sf):
    return moved(spark, sf)


@query("t11_trips_and_dwells", f"WITH {PTS}, {MOVES_SQL} SELECT id, segment, CASE WHEN trip_length > 1 THEN 'trip' ELSE 'dwell' END AS kind FROM moves WHERE trip_length > 1 OR (trip_length = 1 AND duration <> 1)")
def t11(spark, sf):
    return moved(spark, sf).where("trip_length > 1 OR (trip_length = 1 AND duration <> 1)").select("id", "segment", F.when(F.col("trip_length") > 1, "trip").otherwise("dwell").alias("kind"))


@query("w06_downsample", f"""WITH {PTS}, d AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) {BY} > 36000000000, false) AS far FROM pts),
n AS (SELECT *, row_number() OVER (PARTITION BY id, far ORDER BY ts, event_id) AS r FROM d) SELECT event_id FROM n WHERE far OR (r - 1) % 36000 = 0""")
def w06(spark, sf):
    return series.downsample(points(spark, sf), "id", "ts", "event_id", 36000).select("event_id")


@query("w07_convolution", f"""WITH {PTS} SELECT event_id, round({' + '.join(f"coalesce({f}(value, {k}) {BY}, 0) * {x}" for f, k, x in (('lead', 2, 0.1), ('lead', 1, 0.25), ('lag', 0, 0.3), ('lag', 1, 0.25), ('lag', 2, 0.1)))}, 6) AS smooth FROM pts""")
def w07(spark, sf):
    return series.convolve(points(spark, sf), "id", ["ts", "event_id"], "value", intervals.BUFFER_WEIGHT, "smooth").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("w08_snap_zone", f"WITH {PTS} SELECT event_id, CASE WHEN zone <> 0 AND list_contains(list(CASE WHEN value > 60 THEN zone END) OVER (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), zone) THEN zone ELSE 0 END AS snapped FROM pts")
def w08(spark, sf):
    return intervals.snapped_zone(points(spark, sf), "id", ["ts", "event_id"], "zone", F.col("value") > 60, "snapped").select("event_id", "snapped")


DWELLS_SQL = f"""isl AS (SELECT *, sum(CASE WHEN zone IS DISTINCT FROM pz OR ts - pt > INTERVAL {GAP} SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT *, lag(zone) {BY} AS pz, lag(ts) {BY} AS pt FROM pts)),
dwells AS (SELECT id, any_value(zone) AS zone, min(ts) AS start_time, max(ts) AS stop_time, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration FROM isl WHERE zone <> 0 GROUP BY id, island)"""


def dwelt(spark, sf):
    return intervals.dwells(points(spark, sf), "id", "zone", "ts", "event_id", GAP)


@query("w09_dwells", f"WITH {PTS}, {DWELLS_SQL} SELECT * FROM dwells")
def w09(spark, sf):
    return dwelt(spark, sf)


@query("a10_zone_totals", f"WITH {PTS}, {DWELLS_SQL} SELECT id, zone, round(sum(duration), 3) AS total_duration FROM dwells GROUP BY id, zone HAVING sum(duration) > {VISIT}")
def a10(spark, sf):
    return intervals.zone_totals(dwelt(spark, sf), "id", VISIT).withColumn("total_duration", F.round("total_duration", 3))


VISITS_SQL = f"""{DWELLS_SQL}, vi AS (SELECT *, sum(CASE WHEN zone IS NOT DISTINCT FROM pz AND start_time - pt <= INTERVAL {MERGE} SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY start_time, zone ROWS UNBOUNDED PRECEDING) AS visit
 FROM (SELECT *, lag(zone) OVER (PARTITION BY id ORDER BY start_time, zone) AS pz, lag(stop_time) OVER (PARTITION BY id ORDER BY start_time, zone) AS pt FROM dwells)),
visits AS (SELECT id, any_value(zone) AS zone, min(start_time) AS start_time, max(stop_time) AS stop_time, (epoch_us(max(stop_time)) - epoch_us(min(start_time))) / 1e6 AS duration FROM vi GROUP BY id, visit HAVING (epoch_us(max(stop_time)) - epoch_us(min(start_time))) / 1e6 > {VISIT})"""


def visited(spark, sf):
    return intervals.visits(dwelt(spark, sf), "id", MERGE, VISIT)


@query("w11_visits", f"WITH {PTS}, {VISITS_SQL} SELECT * FROM visits")
def w11(spark, sf):
    return visited(spark, sf)


SPOTS_SQL = "spots AS (SELECT id, zone, round(avg(k), 6) AS centroid_x, round(avg(value), 6) AS centroid_y FROM pts GROUP BY id, zone)"


def spots(spark, sf):
    """Centres of the zones."""
    return points(spark, sf).groupBy("id", "zone").agg(F.round(F.avg("k"), 6).alias("centroid_x"), F.round(F.avg("value"), 6).alias("centroid_y"))


@query("j10_snap_to_visit", f"WITH {PTS}, {VISITS_SQL}, {SPOTS_SQL} SELECT event_id, coalesce(centroid_x, k) AS x, coalesce(centroid_y, value) AS y FROM pts p LEFT JOIN (SELECT v.id, start_time, stop_time, centroid_x, centroid_y FROM visits v JOIN spots USING (id, zone)) v ON p.id = v.id AND ts BETWEEN start_time AND stop_time")
def j10(spark, sf):
    p = points(spark, sf).withColumn("x", F.col("k").cast("double")).withColumn("y", F.col("value"))
    return intervals.snap_points(p, visited(spark, sf), spots(spark, sf), "id", "ts").select("event_id", "x", "y")


@query("j11_gaps_outside_visits", f"WITH {PTS}, {VISITS_SQL}, {GAPS_SQL} SELECT id, start_time, stop_time FROM (SELECT id, stop_time - to_seconds(gap // 1000000) AS start_time, stop_time FROM gaps) g WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.id = g.id AND g.start_time > v.start_time AND g.stop_time < v.stop_time)")
def j11(spark, sf):
    return intervals.outside(series.data_gaps(points(spark, sf), "id", "ts", "event_id", GAP), visited(spark, sf), "id")


SPACES_SQL = f"""stops AS (SELECT id, start_time, stop_time FROM visits UNION ALL SELECT id, stop_time - to_seconds(gap // 1000000), stop_time FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.id = g.id AND g.stop_time - to_seconds(gap // 1000000) > v.start_time AND g.stop_time < v.stop_time)),
ends AS (SELECT id, min(ts) AS first, max(ts) AS last FROM pts GROUP BY id),
head AS (SELECT s.id, coalesce(max(stop_time) OVER (PARTITION BY s.id ORDER BY start_time, stop_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first) AS from_time, start_time AS to_time FROM stops s JOIN ends USING (id)),
tail AS (SELECT id, coalesce((SELECT max(stop_time) FROM stops s WHERE s.id = ends.id), first) AS from_time, last + INTERVAL 1 SECOND AS to_time FROM ends),
spaces AS (SELECT DISTINCT * FROM (SELECT * FROM head UNION ALL SELECT * FROM tail) WHERE from_time < to_time)"""


def spaces(spark, sf):
    p, v = points(spark, sf), visited(spark, sf)
    gaps = intervals.outside(series.data_gaps(p, "id", "ts", "event_id", GAP), v, "id")
    return intervals.complement(v.select("id", "start_time", "stop_time").unionByName(gaps), p, "id", "ts")


@query("w14_complement", f"WITH {PTS}, {VISITS_SQL}, {GAPS_SQL}, {SPACES_SQL} SELECT * FROM spaces")
def w14(spark, sf):
    return spaces(spark, sf)


PATHS_SQL = f"""inside AS (SELECT p.*, from_time FROM pts p JOIN spaces s ON p.id = s.id AND ts >= from_time AND ts < to_time),
parts AS (SELECT *, sum(CASE WHEN d > INTERVAL 4 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY id, from_time ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part
 FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY id, from_time ORDER BY ts, event_id) AS d FROM inside)),
kept AS (SELECT * FROM parts WINDOW w AS (PARTITION BY id, from_time, part ORDER BY ts, event_id) QUALIFY NOT coalesce(k = lead(k) OVER w AND value = lead(value) OVER w, false)),
paths AS (SELECT id, min(ts) AS start_time, max(ts) AS stop_time, arg_min(k, (ts, event_id)) AS start_x, arg_min(value, (ts, event_id)) AS start_y, arg_min(zone, (ts, event_id)) AS start_location_id, arg_max(k, (ts, event_id)) AS stop_x, arg_max(value, (ts, event_id)) AS stop_y, arg_max(zone, (ts, event_id)) AS stop_location_id, count(*) AS num_segments, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration
 FROM kept GROUP BY id, from_time, part HAVING count(*) > 1 AND max(ts) - min(ts) > INTERVAL 30 SECOND)"""


def found_paths(spark, sf):
    return intervals.paths(points(spark, sf), spaces(spark, sf), "id", "ts", "event_id", 4 * 3600, x="k", y="value")


@query("c05_paths", f"WITH {PTS}, {VISITS_SQL}, {GAPS_SQL}, {SPACES_SQL}, {PATHS_SQL} SELECT * FROM paths")
def c05(spark, sf):
    return found_paths(spark, sf).drop("segments")


@query("o06_incidents", f"""WITH {PTS}, {VISITS_SQL}, {GAPS_SQL}, {SPOTS_SQL}, {SPACES_SQL}, {PATHS_SQL}
SELECT id, start_time, stop_time, start_location_id, stop_location_id, CAST(start_x AS DOUBLE) AS start_x, start_y, CAST(stop_x AS DOUBLE) AS stop_x, stop_y, 'trip' AS type FROM paths
UNION ALL SELECT v.id, start_time, stop_time, v.zone, v.zone, centroid_x, centroid_y, centroid_x, centroid_y, 'visit' FROM visits v LEFT JOIN spots USING (id, zone)
UNION ALL SELECT id, stop_time - to_seconds(gap // 1000000), stop_time, NULL, NULL, NULL, NULL, NULL, NULL, 'gap' FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.id = g.id AND g.stop_time - to_seconds(gap // 1000000) > v.start_time AND g.stop_time < v.stop_time)""")
def o06(spark, sf):
    gaps = series.data_gaps(points(spark, sf), "id", "ts", "event_id", GAP)
    return intervals.incidents(found_paths(spark, sf), visited(spark, sf), gaps, spots(spark, sf), "id").withColumn("start_x", F.col("start_x").cast("double")).withColumn("stop_x", F.col("stop_x").cast("double"))


@query("w12_last_of_repeats", f"WITH {PTS} SELECT event_id FROM pts QUALIFY coalesce(zone <> lead(zone) {BY}, true)")
def w12(spark, sf):
    w = series.ordered("id", "ts", "event_id")
    return points(spark, sf).withColumn("n", F.lead("zone").over(w)).where("coalesce(zone <> n, true)").select("event_id")


@query("w13_session_id", f"WITH {PTS} SELECT event_id, CAST(sum(new) OVER (PARTITION BY id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) {BY} > INTERVAL {GAP} SECOND THEN 1 ELSE 0 END AS new FROM pts)")
def w13(spark, sf):
    p = series.with_delta(points(spark, sf), "id", "ts", "event_id")
    return series.with_breaks(p, "id", F.col("delta") > GAP, ["ts", "event_id"], "session").select("event_id", "session")


@query("w15_spine", f"WITH {PTS}, e AS (SELECT id, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM pts GROUP BY id) SELECT id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM e")
def w15(spark, sf):
    return series.spine(points(spark, sf), "id", "ts", "1 hour").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("w16_cut_spine", f"WITH {PTS}, e AS (SELECT id, date_trunc('minute', min(ts)) AS a, date_trunc('minute', max(ts)) AS b FROM pts GROUP BY id) SELECT id, unnest(generate_series(a, least(a + INTERVAL 89 MINUTE, b), INTERVAL 1 MINUTE)) AS ts FROM e")
def w16(spark, sf):
    e = points(spark, sf).groupBy("id").agg(F.date_trunc("minute", F.min("ts")).alias("a"), F.date_trunc("minute", F.max("ts")).alias("b"))
    return e.select("id", F.explode(F.sequence("a", F.least(F.col("a") + F.expr("INTERVAL 89 MINUTES"), F.col("b")), F.expr("INTERVAL 1 MINUTE"))).alias("ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("w17_every_nth", f"WITH {PTS} SELECT event_id FROM pts QUALIFY (row_number() {BY} - 1) % 5 = 0")
def w17(spark, sf):
    return series.every_nth(points(spark, sf), "id", ["ts", "event_id"], 5).select("event_id")


THIN_SQL = """mi AS (SELECT *, date_trunc('minute', ts) AS m FROM pts), ra AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY m) AS r FROM mi),
co AS (SELECT id, k, value, ts, c, m + to_minutes(c) AS minute FROM ra, range(0, {n} + 1) t(c) WHERE (r - 1) % ({n} + 1) = 0),
thin AS (SELECT id, minute, k, value FROM co QUALIFY row_number() OVER (PARTITION BY id, minute ORDER BY c, ts, k, value) = 1)"""


@query("w18_thin_minutes", f"WITH {PTS}, {THIN_SQL.format(n=2)} SELECT * FROM thin")
def w18(spark, sf):
    return series.thin_minutes(points(spark, sf), "id", "ts", 2, ["k", "value"]).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("m11_subsampling", "WITH " + PTS + ", " + ", ".join(f"c{n} AS (WITH {THIN_SQL.format(n=n)} SELECT {n} AS cycles, id, count(*) AS minutes, round(sum(value), 4) AS total FROM thin GROUP BY id)" for n in (0, 1, 2, 4, 8)) + " " + " UNION ALL ".join(f"SELECT * FROM c{n}" for n in (0, 1, 2, 4, 8)))
def m11(spark, sf):
    out = None
    for n in (0, 1, 2, 4, 8):
        one = series.thin_minutes(points(spark, sf), "id", "ts", n, ["k", "value"]).groupBy("id").agg(F.count("*").alias("minutes"), F.round(F.sum("value"), 4).alias("total")).withColumn("cycles", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@query("w19_wear_marks")
def w19(spark, sf):
    p = points(spark, sf).withColumn("pos", F.row_number().over(series.ordered("id", "ts", "event_id")))
    rows = p.withColumn("on", F.when((F.col("k") % 7 < 2) & (F.col("value") > 45), F.col("value")).otherwise(0.0))
    return activity.wear_marks(rows, "id", "pos", "on", frame=6, allowance=2).select("event_id", "wearing")


@query("w20_bin_centres", "SELECT CAST(i AS BIGINT) AS i, CASE WHEN i > 0 THEN i * 100 - 50.0 END AS centre FROM range(0, 101) t(i)")
def w20(spark, sf):
    edge = F.col("i") * 100.0
    return spark.range(101).withColumnRenamed("id", "i").select("i", ((edge + F.when(F.col("i") > 0, edge - 100)) / 2).alias("centre"))


@query("w21_trim_tail", f"""WITH {PTS}, {HIST_SQL}, b AS (SELECT *, max(bin) OVER (PARTITION BY id) AS top, (max(bin) OVER (PARTITION BY id) - bin) // 7 AS block FROM hist),
f AS (SELECT id, min(block) AS first FROM (SELECT id, block FROM b GROUP BY ALL HAVING count(*) FILTER (WHERE n > 0) >= 3.5) GROUP BY id) SELECT id, bin, n FROM b JOIN f USING (id) WHERE block >= first AND bin < top""")
def w21(spark, sf):
    return activity.trimmed_tail(activity.histogram(counted(spark, sf), ["id"], "counts", 0, 10000, 100), ["id"])


@query("m09_log_frequencies", f"WITH {PTS}, {HIST_SQL} SELECT id, bin, (bin + 0.5) * 100 AS centre, round(ln((n + 1) / (sum(n + 1) OVER (PARTITION BY id))), 6) AS y FROM hist")
def m09(spark, sf):
    return activity.log_frequencies(activity.histogram(counted(spark, sf), ["id"], "counts", 0, 10000, 100), ["id"], 0, 100).withColumn("y", F.round("y", 6))


@query("w22_interpolate", f"""WITH {PTS}, p AS (SELECT id, ts AS t0, lead(ts) {BY} AS t1, k AS k0, lead(k) {BY} AS k1, value AS v0, lead(value) {BY} AS v1 FROM pts), g AS (SELECT *, (epoch_us(t1) - epoch_us(t0)) / 1e6 AS span FROM p), q AS (SELECT * FROM g WHERE span > 7200 AND span <= 43200 AND sqrt(power(k1 - k0, 2) + power(v1 - v0, 2)) < 30),
s AS (SELECT *, unnest(generate_series(1, greatest(CAST(ceil(span / 3600) AS BIGINT) - 1, 1))) AS j FROM q)
SELECT id, ts, CAST(k AS DOUBLE) AS k, value, false AS interpolated FROM pts UNION ALL SELECT id, t0 + to_seconds(j * 3600), round(k0 + (k1 - k0) * j * 3600 / span, 6), round(v0 + (v1 - v0) * j * 3600 / span, 6), true FROM s WHERE j * 3600 < span""")
def w22(spark, sf):
    p = points(spark, sf).withColumn("k", F.col("k").cast("double"))
    out = series.interpolate_gaps(p, "id", "ts", "event_id", ["k", "value"], 7200, 43200, 30.0, 3600)
    return out.withColumns({c: F.when(F.col("interpolated"), F.round(c, 6)).otherwise(F.col(c)) for c in ("k", "value")})


@query("w23_forward_fill", f"WITH {PTS} SELECT event_id, last_value(CASE WHEN k % 3 = 0 THEN k END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM pts")
def w23(spark, sf):
    p = points(spark, sf).withColumn("k", F.when(F.col("k") % 3 == 0, F.col("k")))
    return series.forward_fill(p, "id", ["ts", "event_id"], "k").select("event_id", "k")


@query("w24_halves", f"WITH {PTS} SELECT event_id, CASE WHEN row_number() {BY} <= count(*) OVER (PARTITION BY id) // 2 THEN 'before' ELSE 'after' END AS half FROM pts")
def w24(spark, sf):
    return series.halves(points(spark, sf), "id", ["ts", "event_id"]).select("event_id", "half")


@query("j13_nearest_known", f"""WITH {PTS}, n AS (SELECT event_id, id, ts, CASE WHEN k % 4 = 0 THEN k END AS x FROM pts) SELECT event_id, last_value(x IGNORE NULLS) OVER b AS prev_x, last_value(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS prev_time, first_value(x IGNORE NULLS) OVER a AS next_x, first_value(CASE WHEN x IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS next_time
FROM n WINDOW b AS (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def j13(spark, sf):
    p = points(spark, sf).select("event_id", "id", "ts", F.when(F.col("k") % 4 == 0, F.col("k")).alias("x"))
    return series.known_neighbours(p, "id", ["ts", "event_id"], "ts", "x").select("event_id", "prev_x", "prev_time", "next_x", "next_time")


# --- joins by keys


@query("j02_join_on_second", f"WITH {PTS}, c AS (SELECT id, date_trunc('second', ts) AS s, value FROM pts WHERE k % 2 = 0) SELECT p.event_id, c.value FROM pts p JOIN c ON p.id = c.id AND date_trunc('second', p.ts) = c.s")
def j02(spark, sf):
    p = points(spark, sf).withColumn("s", F.date_trunc("second", "ts"))
    return p.select("event_id", "id", "s").join(p.where("k % 2 = 0").select("id", "s", "value"), ["id", "s"]).select("event_id", "value")


@query("j03_bouts_to_epochs", f"WITH {PTS}, b AS (SELECT id, date_trunc('day', ts) AS d, count(*) FILTER (WHERE event_type <> 'error') AS worn FROM pts GROUP BY ALL) SELECT event_id, worn FROM pts p LEFT JOIN b ON p.id = b.id AND date_trunc('day', p.ts) = b.d AND b.worn > 1")
def j03(spark, sf):
    p = points(spark, sf).withColumn("d", day())
    b = p.groupBy("id", "d").agg(F.count(F.when(is_worn(), 1)).alias("worn")).where("worn > 1")
    return p.join(b, ["id", "d"], "left").select("event_id", "worn")


@query("j04_attributes", "SELECT e.event_id, c.c_mktsegment, n.n_name FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
def j04(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return points(spark, sf).join(c, F.col("id") == F.col("c_custkey")).select("event_id", "c_mktsegment", "n_name")


@query("j06_semi_valid", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def j06(spark, sf):
    good = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(good, "o_custkey", "left_semi").select("o_orderkey")


@query("j07_in_city_cells", f"WITH {PTS} SELECT event_id FROM pts WHERE (k // 10 + CAST(floor(value / 10) AS BIGINT)) % 2 = 0 AND value < 100")
def j07(spark, sf):
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("n"), (F.col("id") % 10).alias("e")).where("(n + e) % 2 = 0")
    p = points(spark, sf).withColumn("n", F.floor(F.col("k") / 10)).withColumn("e", F.floor(F.col("value") / 10))
    return p.join(cells, ["n", "e"], "left_semi").select("event_id")


@query("j12_points_in_spaces", f"WITH {PTS}, {VISITS_SQL}, {GAPS_SQL}, {SPACES_SQL} SELECT event_id, from_time FROM pts p JOIN spaces s ON p.id = s.id AND ts >= from_time AND ts < to_time")
def j12(spark, sf):
    s = spaces(spark, sf).withColumnRenamed("id", "sid")
    return points(spark, sf).join(s, (F.col("id") == F.col("sid")) & (F.col("ts") >= F.col("from_time")) & (F.col("ts") < F.col("to_time"))).select("event_id", "from_time")


@query("j19_visit_hotspots", f"WITH {PTS}, {VISITS_SQL}, {SPOTS_SQL} SELECT v.id, v.zone, start_time, centroid_x, centroid_y FROM visits v JOIN spots USING (id, zone)")
def j19(spark, sf):
    return visited(spark, sf).join(spots(spark, sf), ["id", "zone"]).select("id", "zone", "start_time", "centroid_x", "centroid_y")


@query("o02_head_and_tail", "SELECT * FROM (SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 50) UNION ALL SELECT * FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)")
def o02(spark, sf):
    p = points(spark, sf).select("event_id", "ts")
    return p.orderBy("ts", "event_id").limit(50).unionByName(p.orderBy(F.desc("ts"), F.desc("event_id")).limit(50))


@query("o04_set_intersection", f"WITH {PTS} SELECT id, array_to_string(list_sort(list_intersect(list(DISTINCT k) FILTER (WHERE value < 50), list(DISTINCT k) FILTER (WHERE value >= 50))), ',') AS both FROM pts GROUP BY id")
def o04(spark, sf):
    g = points(spark, sf).groupBy("id").agg(F.collect_set(F.when(F.col("value") < 50, F.col("k"))).alias("a"), F.collect_set(F.when(F.col("value") >= 50, F.col("k"))).alias("b"))
    return g.select("id", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("both"))


@query("o05_nonzero_zones", f"WITH {PTS} SELECT DISTINCT id, zone FROM pts WHERE zone <> 0")
def o05(spark, sf):
    return points(spark, sf).where("zone <> 0").select("id", "zone").distinct()


@query("o07_best_by_max", f"WITH {PTS} SELECT id, max(value) AS best, arg_max(event_id, (value, event_id)) AS event_id FROM pts GROUP BY id")
def o07(spark, sf):
    return points(spark, sf).groupBy("id").agg(F.max("value").alias("best"), F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"))


@query("c01_modified_kernel", f"""WITH {PTS}, m AS (SELECT *, {' + '.join(f"coalesce({f}(value, {k}) {BY}, 0) * {x}" for f, k, x in (('lead', 2, 0.1), ('lead', 1, 0.25), ('lag', 0, 0.3), ('lag', 1, 0.25), ('lag', 2, 0.1)))} AS modified FROM pts)
SELECT event_id, round(CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END, 5) AS norm_kernel, round(CASE WHEN stddev_samp(value) OVER w > 0 THEN (modified - avg(value) OVER w) / stddev_samp(value) OVER w END, 5) AS norm_modified FROM m WINDOW w AS (PARTITION BY id, zone)""")
def c01(spark, sf):
    p = series.convolve(points(spark, sf), "id", ["ts", "event_id"], "value", intervals.BUFFER_WEIGHT, "modified")
    p = intervals.zone_scores(p, "id", "zone", "value", "norm_kernel")
    p = intervals.zone_scores(p, "id", "zone", "value", "norm_modified", F.col("modified"))
    return p.select("event_id", F.round("norm_kernel", 5).alias("norm_kernel"), F.round("norm_modified", 5).alias("norm_modified"))


@query("c09_recorded_minutes", f"WITH {PTS}, e AS (SELECT id, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM pts GROUP BY id), s AS (SELECT id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS h FROM e) SELECT s.id, s.h AS ts, r.k IS NOT NULL AS recorded, r.k FROM s LEFT JOIN (SELECT id, date_trunc('hour', ts) AS h, arg_min(k, (ts, event_id)) AS k FROM pts GROUP BY ALL) r ON s.id = r.id AND s.h = r.h")
def c09(spark, sf):
    p = points(spark, sf)
    s = series.spine(p, "id", "ts", "1 hour")
    r = p.groupBy("id", F.date_trunc("hour", "ts").alias("ts")).agg(F.min_by("k", F.struct("ts", "event_id")).alias("k"))
    return s.join(r, ["id", "ts"], "left").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("k").isNotNull().alias("recorded"), "k")


@query("c13_span_totals", f"WITH {PTS}, r AS (SELECT id, k, row_number() {BY} AS pos FROM pts) SELECT id, CAST(count(*) FILTER (WHERE k <> 0) AS BIGINT) AS total FROM r WHERE (pos >= 5 AND pos < 15) OR (pos >= 20 AND pos < 30) GROUP BY id")
def c13(spark, sf):
    p = points(spark, sf).withColumn("pos", F.row_number().over(W.partitionBy("id").orderBy("ts", "event_id")))
    ids = p.select("id").distinct()
    spans = ids.select("id", F.explode(F.array(F.struct(F.lit(5).alias("start"), F.lit(15).alias("stop")), F.struct(F.lit(20).alias("start"), F.lit(30).alias("stop")))).alias("s")).select("id", "s.*")
    return activity.span_totals(p, "id", "pos", "k", spans)
