"""Edge cases of the operators on small tables made by hand."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.functions import geo, scalar
from trailmark.operators import activity, fits, graph, intervals, series, signal, spatial, text, transit
from trailmark.plans import detect
from trailmark.sources import folders
from trailmark.streaming import resample

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def track(spark, rows, schema="id long, ts timestamp_ntz, event_id long, zone long, x double, y double"):
    return spark.createDataFrame([(i, at(s), k, *rest) for k, (i, s, *rest) in enumerate(rows)], schema)


def test_gap_must_exceed_the_limit(spark):
    df = track(spark, [(1, 0, 1, 0.0, 0.0), (1, 300, 1, 0.0, 0.0), (1, 601, 1, 0.0, 0.0), (2, 5, 1, 0.0, 0.0)])
    got = series.data_gaps(df, "id", "ts", "event_id", 300).collect()
    assert [(g["id"], g["start_time"], g["stop_time"]) for g in got] == [(1, at(299), at(600))]


def test_runs_of_equal_times_and_nulls(spark):
    df = track(spark, [(1, 0, None, 0.0, 0.0), (1, 0, None, 0.0, 0.0), (1, 0, 5, 0.0, 0.0), (1, 1, 5, 0.0, 0.0), (1, 2, 6, 0.0, 0.0)])
    got = {g["run"]: (g["zone"], g["duration"]) for g in series.run_lengths(df, "id", "zone", "ts", "event_id").collect()}
    assert got == {1: (None, 2), 2: (5, 2), 3: (6, 1)}
    assert series.run_lengths(df.limit(0), "id", "zone", "ts", "event_id").count() == 0


def test_visit_bounds_are_inclusive_and_spaces_half_open(spark):
    points = track(spark, [(1, s, 1, float(s), 0.0) for s in (0, 10, 20, 30, 40)])
    visit = spark.createDataFrame([(1, 1, at(10), at(20), 10.0)], "id long, zone long, start_time timestamp_ntz, stop_time timestamp_ntz, duration double")
    spots = spark.createDataFrame([(1, 1, 99.0, 9.0)], "id long, zone long, centroid_x double, centroid_y double")
    assert sorted(r["x"] for r in intervals.snap_points(points, visit, spots, "id", "ts").collect()) == [0.0, 30.0, 40.0, 99.0, 99.0]
    assert sorted(r["x"] for r in intervals.snap_points(points, visit, spots.limit(0), "id", "ts").collect()) == [0.0, 10.0, 20.0, 30.0, 40.0]
    spaces = intervals.complement(visit.select("id", "start_time", "stop_time"), points, "id", "ts")
    assert sorted((r["from_time"], r["to_time"]) for r in spaces.collect()) == [(at(0), at(10)), (at(20), at(41))]
    paths = intervals.paths(points, spaces, "id", "ts", "event_id", 3600, 15)
    assert [(p["start_time"], p["stop_time"], p["num_segments"], [s["x"] for s in p["segments"]]) for p in paths.collect()] == [(at(20), at(40), 3, [20.0, 30.0, 40.0])]


def test_gap_that_touches_a_visit_is_not_inside(spark):
    v = spark.createDataFrame([(1, at(10), at(50))], "id long, start_time timestamp_ntz, stop_time timestamp_ntz")
    g = spark.createDataFrame([(1, at(10), at(20)), (1, at(11), at(49)), (2, at(11), at(49))], "id long, start_time timestamp_ntz, stop_time timestamp_ntz")
    assert sorted((r["id"], r["start_time"]) for r in intervals.outside(g, v, "id").collect()) == [(1, at(10)), (2, at(11))]


def test_visits_merge_at_the_timespan(spark):
    rows = [(1, 7, at(0), at(10), 10.0), (1, 7, at(3610), at(3700), 90.0), (1, 7, at(7301), at(7400), 99.0), (1, 8, at(7500), at(7600), 100.0)]
    d = spark.createDataFrame(rows, "id long, zone long, start_time timestamp_ntz, stop_time timestamp_ntz, duration double")
    assert [(v["start_time"], v["stop_time"]) for v in intervals.visits(d, "id", 3600, 300).collect()] == [(at(0), at(3700))]


def test_repeated_points_keep_the_last_and_scores_need_spread(spark):
    points = track(spark, [(1, s, 3, x, 0.0) for s, x in ((0, 1.0), (40, 1.0), (80, 2.0), (120, 2.0))])
    spaces = spark.createDataFrame([(1, at(0), at(121))], "id long, from_time timestamp_ntz, to_time timestamp_ntz")
    p = intervals.paths(points, spaces, "id", "ts", "event_id", 3600).first()
    assert (p["start_time"], p["stop_time"], p["num_segments"]) == (at(40), at(120), 2)
    one = track(spark, [(1, 0, 3, 1.0, 0.0)])
    assert intervals.zone_scores(one, "id", "zone", "x", "z").first()["z"] is None
    got = series.convolve(track(spark, [(1, k, 0, v, 0.0) for k, v in enumerate((1.0, 2.0, 3.0))]), "id", ["ts"], "x", intervals.BUFFER_WEIGHT, "c").orderBy("ts").collect()
    assert np.allclose([g["c"] for g in got], np.convolve([0, 0, 1, 2, 3, 0, 0], intervals.BUFFER_WEIGHT, "valid"))


def test_half_even_rounding_and_bins(spark):
    df = spark.createDataFrame([(x,) for x in (5.0, 15.0, 25.0, -5.0, -15.0)], "x double")
    assert [r[0] for r in df.select(scalar.round_to(F.col("x"), 10.0)).collect()] == [0.0, 20.0, 20.0, 0.0, -20.0]
    h = spark.createDataFrame([(1, 0.0), (1, 10000.0), (1, 9999.0), (1, 10001.0)], "id long, c double")
    got = {r["bin"]: r["n"] for r in activity.histogram(h, ["id"], "c", 0, 10000, 100).collect()}
    assert len(got) == 100 and got[0] == 1 and got[99] == 2 and sum(got.values()) == 3


def test_levels_ties_and_days(spark):
    df = spark.createDataFrame([(99.0,), (100.0,), (2020.0,), (5999.0,), (None,)], "c double")
    assert [r[0] for r in df.select(scalar.activity_level(F.col("c"))).collect()] == ["sedentary", "light", "moderate", "vigorous", "vigorous"]
    b = spark.createDataFrame([(0, 0, 5, 5, 0), (3, 3, 0, 0, 0)], "non_wear int, sedentary int, light int, moderate int, vigorous int")
    assert [r["dominant"] for r in activity.dominant(b).collect()] == ["light", "non_wear"]
    noon = spark.createDataFrame([(dt.datetime(1970, 1, 1, 12),), (dt.datetime(1970, 1, 2, 12),), (dt.datetime(1970, 1, 2, 11),)], "t timestamp_ntz")
    assert [r[0].day for r in noon.select(activity.rounded_day(F.col("t"))).collect()] == [1, 3, 2]


@pytest.mark.parametrize(("on", "worn"), [
    ([], set(range(300))), ([50], set(range(300))), ([10, 12, 100], {10, 11, 12}), ([*range(0, 5), *range(94, 99), *range(190, 200)], set(range(0, 99)) | set(range(190, 200))),
])
def test_wear_marks(spark, on, worn):
    df = spark.createDataFrame([(1, k, 5.0 if k in on else 0.0) for k in range(300)], "id long, pos long, c double")
    got = {r["pos"] for r in activity.wear_marks(df, "id", "pos", "c").collect() if r["wearing"]}
    assert got == worn


def test_timetable_hours_and_bad_stops(spark):
    times = spark.createDataFrame([(1, "7", "24:10:00", 1), (1, "x7", "25:10:00", 2), (1, "8", "26:00:59", 3), (1, "8", "09:00:00", 4)], "trip_id long, stop_id string, departure_time string, stop_sequence int")
    trips, stops = spark.createDataFrame([(5, 1, 2)], "route_id long, trip_id long, service_id int"), spark.createDataFrame([(7, 12.5, 37.5), (8, 0.0, 0.0)], "stop_id long, easting double, northing double")
    got = {r["time"]: (r["easting"], r["northing"]) for r in transit.timetable(times, trips, stops, 25.0).collect()}
    assert got == {"00:10": (0.0, 50.0), "02:00": (0.0, 0.0), "09:00": (0.0, 0.0)}


def test_prism_is_inside_both_disks(spark):
    rows = [(1, at(0), 0, 0), (1, at(60), None, None), (1, at(120), 3, 0)]
    known = spark.createDataFrame(rows, "id long, minute timestamp_ntz, n int, e int")
    got = transit.prism_minutes(known, "id", "minute", 50.0)
    middle = {(r["n"], r["e"]) for r in got.collect() if r["minute"] == at(60)}
    assert middle == {(n, e) for n in range(-5, 8) for e in range(-5, 6) if math.hypot(n, e) * 50 <= 120 and math.hypot(n - 3, e) * 50 <= 120}
    far = spark.createDataFrame([(1, at(0), 0, 0), (1, at(420), None, None), (1, at(900), 3, 0)], "id long, minute timestamp_ntz, n int, e int")
    assert {r["minute"] for r in transit.prism_minutes(far, "id", "minute", 50.0).collect()} == {at(0), at(900)}


def test_bus_probability_needs_a_span(spark):
    person = spark.createDataFrame([(1, m, 0, 0) for m in range(6)] + [(2, 0, 0, 0), (2, 1, 0, 0), (3, 0, 9, 9)], "trip long, minute int, n int, e int")
    bus = spark.createDataFrame([(7, 70, m, 0, 0) for m in (0, 1, 5)], "route long, bus_trip long, minute int, n int, e int")
    routes = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "trip long, route long")
    assert {r["trip"]: r["probability"] for r in transit.bus_probability(person, bus, routes).collect()} == {1: 0.5, 2: None, 3: None}


def test_similarity_of_terms(spark):
    df = spark.createDataFrame([("t1 d300.0 D300.55",)], "s string")
    assert df.select(text.terms_of(F.col("s"))).first()[0] == ["t1", "d300", "d300", "55"]
    docs = spark.createDataFrame([(1, ["a1", "b1"]), (2, ["a1", "b1"]), (3, ["c1"]), (4, [])], "doc long, terms array<string>")
    got = {(r["i"], r["j"]): r["score"] for r in text.cosine_pairs(text.tfidf(docs, "doc", "terms"), "doc").collect()}
    assert set(got) == {(2, 1)} and got[2, 1] == pytest.approx(1)
    assert df.select(text.ngrams(F.split("s", " "), 2, 3)).first()[0] == ["t1 d300.0", "d300.0 D300.55", "t1 d300.0 D300.55"]


def test_projections(spark):
    df = spark.createDataFrame([(48.4284, -123.3656)], "lat double, lon double")
    east, north = df.select(*[c.alias(n) for c, n in zip(geo.utm(F.col("lat"), F.col("lon")), "en", strict=True)]).first()
    assert (round(east), round(north)) == (472948, 5363891) or abs(east - 472948) < 50
    back = df.select(*[c.alias(n) for c, n in zip(geo.conic_inverse(F.lit(6_200_000.0), F.lit(3_000_000.0)), ("lat", "lon"), strict=True)]).first()
    assert back["lat"] == pytest.approx(63.390675, abs=1e-9) and back["lon"] == pytest.approx(-91.86666666666666)


def test_raster_and_road_paths():
    cost = {(n, e): 1.0 for n in range(5) for e in range(5)} | {(n, 2): 100.0 for n in range(4)}
    path = graph.raster_path(cost, (0, 0), (0, 4))
    assert path[0] == (0, 0) and path[-1] == (0, 4) and (4, 2) in path
    assert graph.raster_path(cost, (0, 0), (9, 9)) == []
    assert graph.along([(0.0, 0.0), (0.0, 4.0)], 3) == [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0), (0.0, 3.0), (0.0, 4.0)]
    assert graph.dijkstra({1: [(2, 1.0), (3, 5.0)], 2: [(3, 1.0)]}, 1, 3) == (2.0, [1, 2, 3])
    two = graph.louvain([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.1)])
    assert len({two[k] for k in (0, 1, 2)}) == 1 and len(set(two.values())) == 2


def test_fits_and_counts():
    x = np.linspace(0, 6000, 61)
    y = np.where(x < 2000, 5 - x / 1000, 3 - (x - 2000) / 4000)
    beta, error = fits.fixed_breaks(x, y, [0, 2000, 6000])
    assert error < 1e-20 and np.allclose(np.cumsum(beta[1:]), [-1e-3, -2.5e-4])
    assert fits.search_breaks(x, y, [(1500, 2500)], [1700])[0] == pytest.approx(2000, abs=20)
    t = np.arange(1500) / 50
    assert signal.counts(np.zeros(1500), 50).tolist() == [0] * 30 and signal.counts(np.sin(2 * np.pi * t), 50)[5:].min() > 100
    assert len(signal.counts(np.zeros(1), 50)) == 0


def test_polygon_and_nearest(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (-1.0, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(spatial.in_polygon(F.col("x"), F.col("y"), [ring])).collect()] == [True, False, False]
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "p long, x double, y double")
    nodes = spark.createDataFrame([(7, 3.0, 4.0), (6, 4.0, 3.0), (9, 70.0, 0.0)], "node long, x double, y double")
    got = {r["p"]: (r["node"], r["distance"]) for r in spatial.nearest_node(points, nodes, "p", "node", 10.0, rings=4).collect()}
    assert got == {1: (6, 5.0), 2: (9, 30.0)}


def test_trips_cover_the_range(spark):
    rows = [(1, 60 * k, 0, 0.0 if k < 40 else 400.0 if k >= 60 else 20.0 * (k - 40), 0.0) for k in range(120)]
    df = track(spark, rows).drop("zone")
    trips = detect.detect_trips(df, "id", "ts", "event_id", detect.TripParams(kernel_threshold=0.1))
    kinds = [r["type"] for r in trips.incidents.orderBy("start_time").collect()]
    assert kinds.count("visit") == 2 and "trip" in kinds and "gap" not in kinds
    v = sorted((r["start_time"], r["stop_time"]) for r in trips.visits.collect())
    assert all(a[1] <= b[0] for a, b in zip(v, v[1:], strict=False))


def test_sinks_append_and_replace(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    p = f"file://{tmp_path}/t"
    folders.append_table(df, p, ["k"])
    folders.replace_keys(df.where("k = 2").withColumn("v", F.lit("c")), p, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "c")]
    assert [r["k"] for r in folders.not_done(df, df.where("k = 1"), ["k"]).collect()] == [2]


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, at(s), float(s)) for s in (0, 10, 70, 1000)] + [(2, at(5), 1.0), (2, at(90000), 0.0)], "id long, ts timestamp_ntz, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, out, n in (("minutes", resample.stream_resample(stream, "id", "ts", ["v"]), 4), ("sessions", resample.stream_sessions(stream, "id", "ts"), 3)):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == n


def test_first_cell(spark):
    from trailmark.operators import spatial

    rows = spark.createDataFrame([(1, [(2.9, -3.5)]), (2, []), (3, None), (4, [(5.0, 1.0), (1.5, 9.0)])], "id long, cells array<struct<n:double,e:double>>")
    got = {r["id"]: (r["n"], r["e"]) for r in spatial.first_cell(rows, "cells").collect()}
    assert got == {1: (2, -3), 2: (None, None), 3: (None, None), 4: (1, 9)}


def test_prism_spans_are_the_cells_of_both_circles(spark):
    r = random.Random(8)
    rows = [(k, r.randrange(-9, 9), r.randrange(-9, 9), r.randrange(-9, 9), r.randrange(-9, 9), float(r.choice([0, 50, 100, 123, 250, 500, 641])), float(r.choice([0, 50, 150, 300, 500]))) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, n0 int, e0 int, n1 int, e1 int, r0 double, r1 double")
    got = {tuple(x) for x in spatial.prism(df, 50.0).select("k", "n", "e").collect()}
    inside = lambda n, e, a, b, radius: ((n - a) * 50) ** 2 + ((e - b) * 50) ** 2 <= radius**2
    want = {(k, n, e) for k, n0, e0, n1, e1, r0, r1 in rows for n in range(-25, 26) for e in range(-25, 26) if inside(n, e, n0, e0, r0) and inside(n, e, n1, e1, r1)}
    assert got == want


def test_shared_minutes(spark):
    from trailmark.plans import prisms

    person = spark.createDataFrame([("p", 1, 0, 0, 4), ("p", 2, 0, 0, 4), ("p", 3, 5, 1, 1)], "trip string, minute int, n int, lo int, hi int")
    bus = spark.createDataFrame([("r", "b", 1, 0, 4, 9), ("r", "b", 2, 0, 5, 9), ("r", "b", 3, 4, 1, 1), ("r", "c", 3, 5, 0, 9), ("r", "c", 3, 5, 1, 2)], "route string, bus_trip string, minute int, n int, lo int, hi int")
    got = sorted(tuple(x) for x in prisms.shared_minutes(person, bus).collect())
    assert got == [("p", "r", "b", 1), ("p", "r", "c", 3)]


def test_nearest_node_without_nodes_is_an_error(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p int, x double, y double")
    with pytest.raises(ValueError):
        spatial.nearest_node(points, spark.createDataFrame([], "q int, x double, y double"), "p", "q", 10.0, rings=2)


def test_previous_id_across_holes(spark):
    from trailmark.queries.more import previous

    ids = [1, 2, 5, 999, 1000, 4000, 4002]
    got = sorted(tuple(x) for x in previous(spark.createDataFrame([(k,) for k in ids], "id long")).collect())
    assert got == list(zip(ids[1:], ids[:-1]))
