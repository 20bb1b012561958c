"""Sources, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions import geo, scalar
from trailmark.operators import transit
from trailmark.queries.base import PTS, points, query, table
from trailmark.sources import folders


@query("s02_csv_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_custkey < 40")
def s02(spark, sf):
    path = folders.Kept(spark, "csv").root
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    folders.append_csv(table(spark, sf, "orders").select(*cols, "o_orderpriority"), path)
    df = folders.read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string", cols)
    return df.where("o_custkey < 40").withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("s17_partitioned_sink", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def s17(spark, sf):
    path = folders.Kept(spark, "sink").root
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    folders.append_table(n, path, ["n_regionkey"])
    folders.append_table(n.where("n_regionkey = 1").withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast(n.schema["n_nationkey"].dataType)), path, ["n_regionkey"])
    return spark.read.schema(n.schema).parquet(path)


@query("s18_replace_keys", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'new' ELSE n_name END AS n_name, n_regionkey FROM nation")
def s18(spark, sf):
    path = folders.Kept(spark, "keys").root
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    folders.append_table(n, path, ["n_regionkey"])
    folders.replace_keys(n.where("n_regionkey = 2").withColumn("n_name", F.lit("new")), path, ["n_regionkey"])
    return spark.read.schema(n.schema).parquet(path)


@query("s05_first_last_sample", f"""WITH {PTS}, p AS (SELECT event_id, id, ts, k, value FROM pts WHERE k > 0 AND value > 0)
SELECT * FROM (SELECT * FROM p ORDER BY ts, event_id LIMIT 10000) UNION ALL SELECT * FROM (SELECT * FROM p ORDER BY ts DESC, event_id DESC LIMIT 10000)""")
def s05(spark, sf):
    return folders.first_and_last(points(spark, sf).where("k > 0 AND value > 0").select("event_id", "id", "ts", "k", "value"), ["ts", "event_id"], 10000)


@query("s07_id_range", "SELECT DISTINCT user_id AS id FROM events WHERE user_id > 20 AND user_id < 90")
def s07(spark, sf):
    return points(spark, sf).where(scalar.strictly_between(F.col("id"), 20, 90)).select("id").distinct()


@query("s08_id_list", "SELECT DISTINCT c_custkey AS id, c_nationkey AS city FROM customer WHERE c_nationkey IN (3, 7)")
def s08(spark, sf):
    return table(spark, sf, "customer").where("c_nationkey IN (3, 7)").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("city")).distinct()


@query("s09_counts_scan", "SELECT ts AS utcdate, value * 20 AS counts, user_id AS iid FROM events WHERE user_id = 7")
def s09(spark, sf):
    return points(spark, sf).where("id = 7").select(F.col("ts").alias("utcdate"), (F.col("value") * 20).alias("counts"), F.col("id").alias("iid"))


@query("s10_window_scan", """SELECT event_id, 'open' AS bounds FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'
UNION ALL SELECT event_id, 'half open' FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'""")
def s10(spark, sf):
    p = points(spark, sf)
    lo, hi = F.expr("TIMESTAMP_NTZ'2024-01-05 00:00:00'"), F.expr("TIMESTAMP_NTZ'2024-01-09 00:00:00'")
    a = p.where(scalar.strictly_between(F.col("ts"), lo, hi)).select("event_id", F.lit("open").alias("bounds"))
    return a.unionByName(p.where((F.col("ts") >= lo) & (F.col("ts") < hi)).select("event_id", F.lit("half open").alias("bounds")))


@query("s11_report_scan", f"WITH {PTS} SELECT id, ts, k, value FROM pts WHERE id BETWEEN 5 AND 60 AND event_type <> 'error'")
def s11(spark, sf):
    return points(spark, sf).where("id BETWEEN 5 AND 60 AND event_type <> 'error'").select("id", "ts", "k", "value")


@query("s20_not_done", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def s20(spark, sf):
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return folders.not_done(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@query("s22_parse_cells", f"WITH {PTS} SELECT id, CAST(count(DISTINCT k) AS BIGINT) AS cells, CAST(sum(k) AS BIGINT) AS total FROM pts GROUP BY id")
def s22(spark, sf):
    text = points(spark, sf).groupBy("id").agg(F.to_json(F.collect_list("k")).alias("cells"))
    cells = text.select("id", F.from_json("cells", "array<bigint>").alias("c"))
    return cells.select("id", F.size(F.array_distinct("c")).cast("long").alias("cells"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("p01_format_points", f"WITH {PTS} SELECT id, ts AS utc_date, k - 10.0 AS lat, value AS lon FROM pts WHERE abs(k - 10.0) <= 90 AND abs(value) <= 180")
def p01(spark, sf):
    raw = points(spark, sf).select("id", F.col("ts").alias("UTC_Date"), (F.col("k") - 10.0).alias("Lat"), F.col("value").alias("Lon"))
    df = raw.toDF(*[c.lower() for c in raw.columns])
    return df.where("abs(lat) <= 90 AND abs(lon) <= 180")


@query("p02_drop_all_copies", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS price FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def p02(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.first("l_extendedprice").alias("p")).where("n = 1")
    return one.select("l_orderkey", "l_linenumber", F.round("p", 4).alias("price"))


@query("p03_keep_first", "SELECT DISTINCT ON (user_id, event_type) user_id AS id, event_type, ts FROM events ORDER BY user_id, event_type, ts, event_id")
def p03(spark, sf):
    return points(spark, sf).groupBy("id", "event_type").agg(F.min_by("ts", F.struct("ts", "event_id")).alias("ts"))


@query("p04_drop_nulls", f"WITH {PTS} SELECT event_id, nullif(k, 7) AS k FROM pts WHERE nullif(k, 7) IS NOT NULL")
def p04(spark, sf):
    return points(spark, sf).select("event_id", F.nullif(F.col("k"), F.lit(7)).alias("k")).na.drop(subset=["k"])


@query("p05_open_interval", "SELECT event_id, value FROM events WHERE value > 10 AND value < 90")
def p05(spark, sf):
    return points(spark, sf).where(scalar.strictly_between(F.col("value"), 10, 90)).select("event_id", "value")


@query("p06_trim_counts", "SELECT event_id, value * 100 AS counts FROM events WHERE value * 100 < 10000")
def p06(spark, sf):
    return points(spark, sf).select("event_id", (F.col("value") * 100).alias("counts")).where("counts < 10000")


LEVEL_SQL = "CASE WHEN value * 20 < 100 THEN 'sedentary' WHEN value * 20 < 2020 THEN 'light' WHEN value * 20 < 5999 THEN 'moderate' ELSE 'vigorous' END"


@query("p07_activity_level", f"SELECT event_id, {LEVEL_SQL} AS level FROM events")
def p07(spark, sf):
    return points(spark, sf).select("event_id", scalar.activity_level(F.col("value") * 20).alias("level"))


@query("p08_scaled_levels", "SELECT event_id, CASE WHEN value < 100 / 60.0 THEN 'sedentary' WHEN value < 2020 / 60.0 THEN 'light' WHEN value < 5999 / 60.0 THEN 'moderate' ELSE 'vigorous' END AS level FROM events")
def p08(spark, sf):
    return points(spark, sf).select("event_id", scalar.activity_level(F.col("value"), scalar.cut_points(1, "S")).alias("level"))


@query("p09_city_number", "SELECT c_custkey, CAST(floor((c_custkey * 1000003 % 900000000) / 100000000) AS INTEGER) AS city FROM customer")
def p09(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalar.city_number(F.col("c_custkey") * 1000003 % 900000000).alias("city"))


REGIONS = {0: "victoria", 1: "vancouver", 2: "saskatoon", 3: "montreal"}


@query("p10_labels", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'victoria' WHEN 1 THEN 'vancouver' WHEN 2 THEN 'saskatoon' WHEN 3 THEN 'montreal' ELSE 'really unknown' END AS city FROM nation")
def p10(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", scalar.label(F.col("n_regionkey"), REGIONS).alias("city"))


@query("p11_multi_labels", """SELECT user_id AS id, event_id, CASE WHEN event_id % 3 = 0 THEN 'two,one' WHEN event_id % 3 = 1 THEN 'three' ELSE '' END AS labels FROM events""")
def p11(spark, sf):
    codes = F.when(F.col("event_id") % 3 == 0, "[2, 1]").when(F.col("event_id") % 3 == 1, "[3]").otherwise("[]")
    return points(spark, sf).select("id", "event_id", scalar.joined_labels(codes, {"1": "one", "2": "two", "3": "three"}).alias("labels"))


@query("p12_age", """SELECT o_orderkey, CAST(coalesce(2024 - year(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END), CASE WHEN o_orderkey % 3 = 1 THEN 30 END, -1) AS INTEGER) AS age FROM orders""")
def p12(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey") % 3
    return o.select("o_orderkey", scalar.age(F.lit("2024-06-01").cast("date"), F.when(k == 0, F.col("o_orderdate")), F.when(k == 1, 30)).cast("int").alias("age"))


@query("p13_euclidean", f"WITH {PTS} SELECT event_id, round(sqrt((k - 50.0) * (k - 50.0) + (value - 20.0) * (value - 20.0)), 6) AS d FROM pts")
def p13(spark, sf):
    return points(spark, sf).select("event_id", F.round(geo.euclidean(F.col("k"), F.col("value"), F.lit(50.0), F.lit(20.0)), 6).alias("d"))


@query("p14_haversine", f"""WITH {PTS}, r AS (SELECT event_id, radians(k * 0.5) AS a, radians(value - 100) AS o, radians(48.4) AS b, radians(-123.3) AS c FROM pts)
SELECT event_id, round(2 * 6378137.0 * asin(sqrt(least(1.0, power(sin((b - a) / 2), 2) + cos(a) * cos(b) * power(sin((c - o) / 2), 2)))), 3) AS d FROM r""")
def p14(spark, sf):
    return points(spark, sf).select("event_id", F.round(geo.haversine(F.col("k") * 0.5, F.col("value") - 100, F.lit(48.4), F.lit(-123.3)), 3).alias("d"))


@query("p15_metres_degrees", "SELECT event_id, round(value * 360 / (2 * pi() * 6378137.0), 12) AS degrees FROM events")
def p15(spark, sf):
    return points(spark, sf).select("event_id", F.round(geo.metres_to_degrees(F.col("value")), 12).alias("degrees"))


@query("p16_utm_zone", f"WITH {PTS} SELECT event_id, CAST(floor((k * 3.6) / 6) % 60 + 1 AS INTEGER) AS zone, CASE WHEN k < 50 THEN '327' ELSE '326' END || lpad(CAST(CAST(floor((k * 3.6) / 6) % 60 + 1 AS INTEGER) AS VARCHAR), 2, '0') AS epsg FROM pts")
def p16(spark, sf):
    lat, lon = F.col("k") - 50, F.col("k") * 3.6 - 180
    return points(spark, sf).select("event_id", geo.utm_zone(lon).alias("zone"), geo.epsg_code(lat, lon).alias("epsg"))


def utm_sql() -> str:
    _, radius, alpha = geo.kruger()
    e = (geo.FLATTENING * (2 - geo.FLATTENING)) ** 0.5
    east = " + ".join(f"{a:.17e} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    north = " + ".join(f"{a:.17e} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    return f"""WITH {PTS}, a AS (SELECT event_id, radians(48 + k * 0.01) AS phi, radians((-123 + value * 0.01) - (10 * 6 - 183)) AS lam FROM pts),
t AS (SELECT event_id, lam, sinh(atanh(sin(phi)) - {e:.17e} * atanh({e:.17e} * sin(phi))) AS t FROM a),
x AS (SELECT event_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT event_id, round(5e5 + 9.996e-1 * {radius:.17e} * (eta + {east}), 3) AS easting, round(9.996e-1 * {radius:.17e} * (xi + {north}), 3) AS northing FROM x"""


@query("p17_utm", utm_sql())
def p17(spark, sf):
    east, north = geo.utm(48 + F.col("k") * 0.01, -123 + F.col("value") * 0.01, 10)
    return points(spark, sf).select("event_id", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


@query("p18_conic_to_utm")
def p18(spark, sf):
    lat, lon = geo.conic_inverse(3_900_000 + F.col("k") * 100, 1_900_000 + F.col("value") * 100)
    east, north = geo.utm(F.col("lat"), F.col("lon"), 10)
    return points(spark, sf).select("event_id", lat.alias("lat"), lon.alias("lon")).select("*", east.alias("easting"), north.alias("northing"))


@query("p19_half_even_grid", f"WITH {PTS} SELECT event_id, round_even(k / 10.0, 0) * 10 AS e, round_even(value / 2.5, 0) * 2.5 AS n FROM pts")
def p19(spark, sf):
    return points(spark, sf).select("event_id", scalar.round_to(F.col("k"), 10.0).alias("e"), scalar.round_to(F.col("value"), 2.5).alias("n"))


@query("p20_bins", "SELECT event_id, round_even(value * 20 / 100, 0) * 100 AS bin FROM events")
def p20(spark, sf):
    return points(spark, sf).select("event_id", scalar.round_to(F.col("value") * 20, 100.0).alias("bin"))


@query("p21_grid_from_least", f"WITH {PTS}, m AS (SELECT min(k) AS mk, min(value) AS mv FROM pts) SELECT event_id, CAST(ceil((k - mk) / 10.0) AS BIGINT) AS gx, CAST(ceil((value - mv) / 10.0) AS BIGINT) AS gy FROM pts, m")
def p21(spark, sf):
    p = points(spark, sf)
    least = F.broadcast(p.agg(F.min("k").alias("mk"), F.min("value").alias("mv")))
    return p.crossJoin(least).select("event_id", scalar.grid_index(F.col("k"), F.col("mk"), 10.0).alias("gx"), scalar.grid_index(F.col("value"), F.col("mv"), 10.0).alias("gy"))


@query("p22_grid_truncated", f"WITH {PTS} SELECT event_id, CAST(CAST(trunc(value / 10) AS BIGINT) AS VARCHAR) || CAST(CAST(trunc(k / 10.0) AS BIGINT) AS VARCHAR) AS cell FROM pts")
def p22(spark, sf):
    whole = lambda c: (F.col(c) / 10).cast("long").cast("string")
    return points(spark, sf).select("event_id", F.concat(whole("value"), whole("k")).alias("cell"))


@query("p24_axis_value", "SELECT event_id, round(1000 + (value / 7) * 25, 6) AS x FROM events")
def p24(spark, sf):
    return points(spark, sf).select("event_id", F.round(scalar.axis_value(F.col("value") / 7, 1000.0, 25.0), 6).alias("x"))


TIME_SQL = "lpad(CAST(l_linenumber + 20 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') || ':00'"


@query("p25_service_hours", f"SELECT DISTINCT l_linenumber, l_partkey % 60 AS m, CASE WHEN l_linenumber + 20 >= 24 AND l_linenumber + 20 <= 26 THEN lpad(CAST(l_linenumber - 4 AS VARCHAR), 2, '0') || substr({TIME_SQL}, 3) ELSE {TIME_SQL} END AS t FROM lineitem")
def p25(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_partkey") % 60).alias("m")).distinct()
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return li.withColumn("t", scalar.service_hour(F.concat(pad(F.col("l_linenumber") + 20), F.lit(":"), pad(F.col("m")), F.lit(":00"))))


@query("p26_numeric_or_drop", "SELECT p_partkey, CAST(try_cast(CASE WHEN p_partkey % 5 = 0 THEN 'x' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS BIGINT) AS BIGINT) AS stop FROM part WHERE p_partkey % 5 <> 0")
def p26(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string")).alias("stop"))
    return p.withColumn("stop", F.expr("try_cast(stop AS BIGINT)")).where("stop IS NOT NULL")


@query("p27_local_time", "SELECT event_id, ts - INTERVAL 8 HOUR AS local_ts FROM events")
def p27(spark, sf):
    return points(spark, sf).select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("America/Vancouver"), F.col("ts")).alias("local_ts"))


@query("p28_pixels", f"WITH {PTS}, m AS (SELECT id, avg(k) AS mk, avg(value) AS mv FROM pts GROUP BY id) SELECT event_id, round((k - mk) * 4 + 320, 6) AS px, round((mv - value) * 4 + 320, 6) AS py FROM pts JOIN m USING (id)")
def p28(spark, sf):
    w = W.partitionBy("id")
    return points(spark, sf).select("event_id", F.round((F.col("k") - F.avg("k").over(w)) * 4 + 320, 6).alias("px"), F.round((F.avg("value").over(w) - F.col("value")) * 4 + 320, 6).alias("py"))


@query("p29_magnitude", f"WITH {PTS} SELECT event_id, round(sqrt(k * k + value * value + 9.0), 6) AS m FROM pts")
def p29(spark, sf):
    return points(spark, sf).select("event_id", F.round(scalar.magnitude(F.col("k").cast("double"), F.col("value"), F.lit(3.0)), 6).alias("m"))


@query("p30_clamp_deadband", "SELECT event_id, CASE WHEN least(greatest(value - 50, -2.13), 2.13) < 0.068 THEN 0 ELSE least(greatest(value - 50, -2.13), 2.13) END AS v FROM events")
def p30(spark, sf):
    return points(spark, sf).select("event_id", scalar.deadband(scalar.clamp(F.col("value") - 50, -2.13, 2.13), 0.068).alias("v"))


@query("p31_rescaled", "SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 9) AS v FROM events")
def p31(spark, sf):
    p = points(spark, sf)
    ends = F.broadcast(p.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    return p.crossJoin(ends).select("event_id", F.round(scalar.rescaled(F.col("value"), F.col("lo"), F.col("hi")), 9).alias("v"))


@query("p32_inverse_cost", "SELECT event_id, CASE WHEN value / 50 > 0 AND value / 50 < 1 THEN 1 - value / 50 ELSE 0 END AS cost FROM events")
def p32(spark, sf):
    return points(spark, sf).select("event_id", scalar.inverse_cost(F.col("value") / 50).alias("cost"))


@query("p33_initial_token", f"WITH {PTS} SELECT event_id, substr(event_type, 1, 1) || CAST(k AS VARCHAR) AS token FROM pts")
def p33(spark, sf):
    return points(spark, sf).select("event_id", scalar.initial_token(F.col("event_type"), F.col("k")).alias("token"))


STOP_TIMES = """st AS (SELECT CAST(l_orderkey AS BIGINT) AS trip_id, l_partkey AS stop_id, lpad(CAST(l_suppkey % 27 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') || ':00' AS departure_time, l_linenumber AS stop_sequence FROM lineitem),
tr AS (SELECT o_custkey % 50 AS route_id, o_orderkey AS trip_id, dayofweek(o_orderdate) AS service_id FROM orders),
sp AS (SELECT p_partkey AS stop_id, p_size * 37.0 AS easting, p_partkey % 97 * 11.0 AS northing FROM part)"""


def feed(spark, sf):
    """lineitem, orders and part as a timetable's stop times, trips and stops."""
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    li = table(spark, sf, "lineitem")
    times = li.select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").cast("string").alias("stop_id"), F.concat(pad(F.col("l_suppkey") % 27), F.lit(":"), pad(F.col("l_partkey") % 60), F.lit(":00")).alias("departure_time"), F.col("l_linenumber").alias("stop_sequence"))
    trips = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("route_id"), F.col("o_orderkey").alias("trip_id"), (F.dayofweek("o_orderdate") - 1).alias("service_id"))
    stops = table(spark, sf, "part").select(F.col("p_partkey").alias("stop_id"), (F.col("p_size") * 37.0).alias("easting"), (F.col("p_partkey") % 97 * 11.0).alias("northing"))
    return times, trips, stops


MAIN_SQL = f"""{STOP_TIMES}, main AS (SELECT route_id, trip_id, service_id, CASE WHEN CAST(substr(departure_time, 1, 2) AS INTEGER) >= 24 THEN lpad(CAST(CAST(substr(departure_time, 1, 2) AS INTEGER) - 24 AS VARCHAR), 2, '0') || substr(departure_time, 3, 3) ELSE substr(departure_time, 1, 5) END AS time,
 avg(stop_sequence) AS stop_sequence, round_even(avg(easting) / 25.0, 0) * 25.0 AS easting, round_even(avg(northing) / 25.0, 0) * 25.0 AS northing FROM tr JOIN st USING (trip_id) JOIN sp USING (stop_id) GROUP BY ALL)"""


@query("j01_timetable_chain", f"WITH {STOP_TIMES} SELECT route_id, trip_id, stop_id, CAST(count(*) AS BIGINT) AS n FROM tr JOIN st USING (trip_id) JOIN sp USING (stop_id) GROUP BY ALL")
def j01(spark, sf):
    times, trips, stops = feed(spark, sf)
    rows = trips.join(times.withColumn("stop_id", F.col("stop_id").cast("long")), "trip_id").join(stops, "stop_id")
    return rows.groupBy("route_id", "trip_id", "stop_id").agg(F.count("*").alias("n"))


@query("t08_timetable", f"WITH {MAIN_SQL} SELECT route_id, trip_id, service_id, time, round(stop_sequence, 6) AS stop_sequence, easting, northing FROM main")
def t08(spark, sf):
    times, trips, stops = feed(spark, sf)
    return transit.timetable(times, trips, stops, 25.0).withColumn("service_id", F.col("service_id").cast("long")).withColumn("stop_sequence", F.round("stop_sequence", 6))


def calendar(spark, sf):
    """Each service runs on its own weekday and on the next one."""
    cols = [(((F.col("id") - 1) % 7 == k) | (F.col("id") % 7 == k)).cast("int").alias(d) for k, d in enumerate(transit.DAYS)]
    return spark.range(7).select(F.col("id").cast("int").alias("service_id"), *cols)


@query("j05_active_services", f"WITH {MAIN_SQL} SELECT route_id, trip_id, time FROM main WHERE service_id IN (2, 3)")
def j05(spark, sf):
    times, trips, stops = feed(spark, sf)
    return transit.active(transit.timetable(times, trips, stops, 25.0), calendar(spark, sf), "wednesday").select("route_id", "trip_id", "time")


@query("a18_routes_by_place", f"WITH {MAIN_SQL} SELECT 'wednesday' AS day, northing, easting, array_to_string(list_sort(list(DISTINCT route_id)), ',') AS routes FROM main WHERE service_id IN (2, 3) GROUP BY northing, easting")
def a18(spark, sf):
    times, trips, stops = feed(spark, sf)
    out = transit.routes_by_place(transit.timetable(times, trips, stops, 25.0), calendar(spark, sf), ["wednesday"])
    return out.withColumn("routes", F.array_join(F.transform("routes", lambda r: r.cast("string")), ","))


@query("a05_route_minute_means", f"WITH {STOP_TIMES} SELECT route_id, substr(departure_time, 1, 5) AS minute, round(avg(stop_sequence), 6) AS stop_sequence, round(avg(easting), 6) AS easting FROM tr JOIN st USING (trip_id) JOIN sp USING (stop_id) GROUP BY ALL")
def a05(spark, sf):
    times, trips, stops = feed(spark, sf)
    rows = trips.join(times.withColumn("stop_id", F.col("stop_id").cast("long")), "trip_id").join(stops, "stop_id")
    return rows.groupBy("route_id", F.substring("departure_time", 1, 5).alias("minute")).agg(F.round(F.avg("stop_sequence"), 6).alias("stop_sequence"), F.round(F.avg("easting"), 6).alias("easting"))
