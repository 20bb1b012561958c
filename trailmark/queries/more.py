"""Composite operators and further variants."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.operators import activity, fits, graph, intervals, series, text, transit
from trailmark.plans import prisms
from trailmark.queries.base import BY, PTS, VISIT, points, query, table
from trailmark.queries.places import COS_SQL, KNOWN_SQL, ROADS, TFIDF_SQL, bags, known_minutes
from trailmark.queries.series import DWELLS_SQL, GAPS_SQL, MOVES_SQL, PATHS_SQL, SPACES_SQL, SPOTS_SQL, VISITS_SQL, counted, dwelt, found_paths, moved, spots, visited


@query("w10_start_propagation", f"WITH {PTS}, m AS (SELECT *, CASE WHEN zone IS DISTINCT FROM lag(zone) {BY} THEN 1 ELSE 0 END AS new FROM pts), r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT event_id, min(ts) OVER (PARTITION BY id, run) AS start_time FROM r")
def w10(spark, sf):
    runs = series.with_runs(points(spark, sf), "id", F.col("zone"), ["ts", "event_id"])
    return runs.select("event_id", F.min("ts").over(W.partitionBy("id", "run")).alias("start_time"))


@query("o01_position_by_keys", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority, o_orderkey) AS position FROM orders")
def o01(spark, sf):
    w = series.ordered("o_custkey", "o_orderdate", "o_orderpriority", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("position"))


@query("o03_union_all", "SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def o03(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("j20_all_pairs", """WITH tok AS (SELECT conv_id AS id, unnest(regexp_extract_all(lower(translate(text, 'àâäçéèêëîïôöùûüßñóíáú', '                     ')), '[a-z]{2,}')) AS term FROM conversations), tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations),
w AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), x AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS x FROM w) SELECT a.id AS i, b.id AS j, round(sum(a.x * b.x), 5) AS score FROM x a JOIN x b ON a.term = b.term AND a.id > b.id GROUP BY ALL""")
def j20(spark, sf):
    c = table(spark, sf, "conversations")
    plain = F.lower(F.translate("text", "àâäçéèêëîïôöùûüßñóíáú", " " * 21))
    docs = c.groupBy("conv_id").agg(F.flatten(F.collect_list(F.regexp_extract_all(plain, F.lit("[a-z]{2,}"), F.lit(0)))).alias("terms"))
    return text.cosine_pairs(text.tfidf(docs, "conv_id", "terms"), "conv_id").withColumn("score", F.round("score", 5))


HALVES_SQL = "h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY segment) <= count(*) OVER (PARTITION BY id) // 2 THEN 'before' ELSE 'after' END AS half FROM moves)"


@query("x03_story_halves", f"WITH {PTS}, {MOVES_SQL}, {HALVES_SQL} SELECT id, half, string_agg(CASE WHEN trip_length = 1 AND duration > 3 THEN 'd' ELSE 't' END || duration, ' ' ORDER BY segment) AS story FROM h GROUP BY id, half")
def x03(spark, sf):
    h = series.halves(moved(spark, sf), "id", ["segment"])
    token = F.concat(F.when((F.col("trip_length") == 1) & (F.col("duration") > 3), "d").otherwise("t"), F.col("duration").cast("string"))
    return text.story(h, ["id", "half"], ["segment"], token).select("id", "half", F.array_join("tokens", " ").alias("story"))


@query("x04_kernel_story", f"""WITH {PTS}, {VISITS_SQL}, {GAPS_SQL}, {SPACES_SQL}, {PATHS_SQL}, p AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY start_time, stop_time) AS r, 't' || num_segments AS t FROM paths), v AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY start_time, zone) AS r, 'd' || CAST(duration AS BIGINT) AS d FROM (SELECT id, zone, start_time, floor(duration) AS duration FROM visits))
SELECT coalesce(p.id, v.id) AS id, string_agg(concat_ws(' ', t, d), ' ' ORDER BY coalesce(p.r, v.r)) AS story FROM p FULL JOIN v ON p.id = v.id AND p.r = v.r GROUP BY ALL""")
def x04(spark, sf):
    p = found_paths(spark, sf).select("id", F.row_number().over(series.ordered("id", "start_time", "stop_time")).alias("r"), F.concat(F.lit("t"), F.col("num_segments").cast("string")).alias("t"))
    v = visited(spark, sf).select("id", F.row_number().over(series.ordered("id", "start_time", "zone")).alias("r"), F.concat(F.lit("d"), F.floor("duration").cast("string")).alias("d"))
    return text.story(p.join(v, ["id", "r"], "full"), ["id"], ["r"], F.concat_ws(" ", "t", "d")).select("id", F.array_join("tokens", " ").alias("story"))


@query("x11_subset_similarity", f"WITH {PTS}, {TFIDF_SQL.format(key='0')}, {COS_SQL} SELECT i, j, round(score, 6) AS score FROM cs WHERE i IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND j IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def x11(spark, sf):
    subset = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    w = text.tfidf(bags(spark, sf), "id", "terms")
    return text.cosine_pairs(w.join(subset, "id", "left_semi"), "id").withColumn("score", F.round("score", 6))


def previous(ids, block: int = 1000):
    """(a, b): each id with the present one before it. Only the greatest id of each block of numbers meets the
    others in one task."""
    rows = ids.withColumn("block", F.floor(F.col("id") / block))
    within = F.lag("id").over(W.partitionBy("block").orderBy("id"))
    tops = rows.groupBy("block").agg(F.max("id").alias("top")).select("block", F.lag("top").over(W.orderBy("block")).alias("top"))
    return rows.withColumn("b", within).join(tops, "block").select(F.col("id").alias("a"), F.coalesce("b", "top").alias("b")).where("b IS NOT NULL")


@query("x12_pairwise_corpora", f"""WITH {PTS}, b AS (SELECT id, unnest(string_split(event_type || ' z' || zone, ' ')) AS term FROM pts), pr AS (SELECT id AS i, lag(id) OVER (ORDER BY id) AS j FROM (SELECT DISTINCT id FROM b) QUALIFY j IS NOT NULL), tok AS (SELECT i, j, id, term FROM pr JOIN b ON b.id IN (i, j)),
tf AS (SELECT i, j, id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT i, j, term, count(*) AS df FROM tf GROUP BY ALL), w AS (SELECT i, j, id, term, tf * (ln(3.0 / (1 + df)) + 1) AS w FROM tf JOIN df USING (i, j, term)), x AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY i, j, id)) AS x FROM w)
SELECT a.i, a.j, round(sum(a.x * b.x), 6) AS score FROM x a JOIN x b ON a.i = b.i AND a.j = b.j AND a.term = b.term AND a.id = a.i AND b.id = a.j GROUP BY ALL""")
def x12(spark, sf):
    d = bags(spark, sf)
    pairs = previous(d.select("id").distinct())
    docs = pairs.withColumn("id", F.explode(F.array("a", "b"))).join(d, "id")
    out = text.cosine_pairs(text.tfidf(docs, "id", "terms", ["a", "b"]), "id", ["a", "b"])
    return out.select("i", "j", F.round("score", 6).alias("score"))


@query("t02_wandering_prisms", f"""WITH {PTS}, {KNOWN_SQL.replace("nb AS (SELECT id, h, n,", "k2 AS (SELECT id, h, CASE WHEN h BETWEEN 30 AND 90 THEN NULL ELSE n END AS n, CASE WHEN h BETWEEN 30 AND 90 THEN NULL ELSE e END AS e FROM kn), nb AS (SELECT id, h, n,").replace("FROM kn WINDOW", "FROM k2 WINDOW")}
SELECT id, count(*) AS cells FROM nb, range(-60, 61) a(dn), range(-60, 61) b(de) WHERE (dn * dn + de * de) * 160000 <= power((h - h0) * 120, 2) AND (power(n0 + dn - n1, 2) + power(e0 + de - e1, 2)) * 160000 <= power((h1 - h) * 120, 2) GROUP BY id""")
def t02(spark, sf):
    known = known_minutes(spark, sf)
    dwells = known.select("id").distinct().select("id", F.expr("TIMESTAMP_NTZ'2024-01-01 00:30:00'").alias("start_time"), F.expr("TIMESTAMP_NTZ'2024-01-01 01:30:00'").alias("end_time"))
    return prisms.person_prism_spans(known, dwells, "id", "minute", 400.0, wander=True).groupBy("id").agg(transit.cell_count().alias("cells"))


@query("t05_path_filled_minutes")
def t05(spark, sf):
    known = known_minutes(spark, sf)
    raster = spark.range(40 * 40).select((F.floor(F.col("id") / 40) - 5).cast("int").alias("n"), (F.col("id") % 40 - 5).cast("int").alias("e")).withColumn("cost", F.when((F.col("n") + F.col("e")) % 3 == 0, 0.5).otherwise(100.0))
    return prisms.filled_by_paths(known, raster, "id", "minute", 50.0, margin=3)


@query("t07_route_points")
def t07(spark, sf):
    trips = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("trip_id"), (F.col("n_nationkey") % 25).alias("source"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("target"), F.lit(5).alias("points"))
    out = graph.road_paths(trips, ROADS, {k: (k // 5 * 10.0, k % 5 * 10.0) for k in range(25)})
    return out.select("trip_id", F.posexplode("line").alias("k", "at")).select("trip_id", "k", "at.x", "at.y")


@query("t10_preprocess", f"WITH {PTS}, m AS (SELECT id, date_trunc('minute', ts) AS minute, avg(k) AS x, avg(value) AS y FROM pts GROUP BY ALL), r AS (SELECT id, minute, round_even(x / 10, 0) * 10 AS easting, round_even(y / 10, 0) * 10 AS northing FROM m) SELECT * FROM r WHERE CAST(easting + northing AS BIGINT) % 20 = 0 AND easting BETWEEN 0 AND 90 AND northing BETWEEN 0 AND 90")
def t10(spark, sf):
    cells = spark.range(100).select((F.floor(F.col("id") / 10) * 10.0).cast("double").alias("easting"), (F.col("id") % 10 * 10.0).alias("northing")).where("cast(easting + northing as bigint) % 20 = 0")
    p = points(spark, sf).withColumn("x", F.col("k").cast("double")).withColumn("y", F.col("value"))
    return prisms.preprocess(p, "id", F.date_trunc("minute", "ts").cast("timestamp_ntz"), 10.0, cells)


@query("c02_refined_hotspots", f"WITH {PTS}, {DWELLS_SQL}, {SPOTS_SQL}, t AS (SELECT id, zone, sum(duration) AS d FROM dwells GROUP BY id, zone HAVING sum(duration) > {VISIT}) SELECT id, zone, centroid_x, centroid_y, round(d, 3) AS total_duration FROM spots JOIN t USING (id, zone)")
def c02(spark, sf):
    kept = spots(spark, sf).join(intervals.zone_totals(dwelt(spark, sf), "id", VISIT), ["id", "zone"])
    return kept.withColumn("total_duration", F.round("total_duration", 3))


@query("c10_first_known_cell", f"WITH {PTS} SELECT id, date_trunc('hour', ts) AS hour, arg_min(k, (ts, event_id)) AS n, CAST(trunc(arg_min(value, (ts, event_id))) AS INTEGER) AS e FROM pts GROUP BY ALL")
def c10(spark, sf):
    at = F.struct("ts", "event_id")
    return points(spark, sf).groupBy("id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.min_by("k", at).alias("n"), F.min_by("value", at).cast("int").alias("e"))


@query("c11_walking_prisms", f"WITH {PTS}, {KNOWN_SQL} SELECT id, count(*) AS cells FROM nb, range(-20, 21) a(dn), range(-20, 21) b(de) WHERE (h1 - h0 < 15 OR nb.n IS NOT NULL) AND (dn * dn + de * de) * 10000 <= power((h - h0) * 120, 2) AND (power(n0 + dn - n1, 2) + power(e0 + de - e1, 2)) * 10000 <= power((h1 - h) * 120, 2) GROUP BY id")
def c11(spark, sf):
    return transit.prism_minute_spans(known_minutes(spark, sf), "id", "minute", 100.0, transit.VWALK).groupBy("id").agg(transit.cell_count().alias("cells"))


@query("m05_flat_tail", f"WITH {PTS} SELECT event_id, CASE WHEN k / 50.0 - 1 > 0 THEN -1e-12 ELSE k / 50.0 - 1 END AS slope FROM pts")
def m05(spark, sf):
    slope = F.col("k") / 50.0 - 1
    return points(spark, sf).select("event_id", F.when(slope > 0, fits.FLAT).otherwise(slope).alias("slope"))


def log_hist(df):
    return activity.log_frequencies(activity.trimmed_tail(activity.histogram(df, ["id"], "counts", 0, 10000, 100), ["id"]), ["id"], 0, 100)


@query("m10_population_and_participants")
def m10(spark, sf):
    # id 0 is the whole population; participants are numbered from 1 here
    c = counted(spark, sf).select((F.col("id") + 1).alias("id"), "counts")
    everyone = fits.piecewise_fits(log_hist(c.withColumn("id", F.lit(0).cast("long"))), "id")
    return everyone.unionByName(fits.piecewise_fits(log_hist(c), "id"))


@query("m12_slope_table")
def m12(spark, sf):
    hist, out = log_hist(counted(spark, sf).select("id", "counts")), None
    for n in (2, 3, 4):
        starts = [10000.0 * k / n / 2 for k in range(1, n)]
        one = fits.piecewise_fits(hist, "id", starts=starts, bounds=[(s * 0.5, s * 1.5) for s in starts]).select("id", F.lit(n).alias("segments"), "breaks", "slopes", "r2")
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("id").agg(F.max_by("segments", "r2").alias("best_r_square"))
    return out.join(best, "id")
