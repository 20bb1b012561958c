"""Grid cells: visit histograms, nearest nodes, disks, prisms, polygons, density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cell_histogram(points: DataFrame, cells: DataFrame, on: Sequence[str], missing: int = -1) -> DataFrame:
    """Every cell with its number of points; ``missing`` where there is none. Points elsewhere do not count."""
    n = points.groupBy(*on).agg(F.count("*").alias("n"))
    return cells.join(n, list(on), "left").withColumn("n", F.coalesce("n", F.lit(missing)))


def visit_frequency(df: DataFrame, cell: Sequence[str]) -> DataFrame:
    """(times, cells): how many cells are visited so many times."""
    return df.groupBy(*cell).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("cells"))


def disk_offsets(radius: float, size: float) -> Column:
    """array<struct<dn, de>> of the lattice offsets within a radius, bound included."""
    reach = int(radius // size)
    hits = [(n, e) for n in range(-reach, reach + 1) for e in range(-reach, reach + 1) if (n * n + e * e) * size * size <= radius * radius]
    return F.array(*[F.struct(F.lit(n).alias("dn"), F.lit(e).alias("de")) for n, e in hits])


def within_radius(points: DataFrame, cells: DataFrame, radius: float, size: float, n: str = "n", e: str = "e") -> DataFrame:
    """points joined with the cells at most a radius away, on integer cell indices: an equi-join over the
    offsets of the disk, so there is no cross product."""
    near = points.withColumn("__o", F.explode(disk_offsets(radius, size))).withColumn("cell_n", F.col(n) + F.col("__o.dn")).withColumn("cell_e", F.col(e) + F.col("__o.de")).drop("__o")
    return near.join(cells.select(F.col(n).alias("cell_n"), F.col(e).alias("cell_e")), ["cell_n", "cell_e"], "left_semi")


def prism_spans(rows: DataFrame, size: float, n0: str = "n0", e0: str = "e0", n1: str = "n1", e1: str = "e1", r0: str = "r0", r1: str = "r1") -> DataFrame:
    """rows with the cells that are within r0 of the first cell and r1 of the second, as a run (n, lo, hi) of
    columns lo to hi for each row of cells that both circles share. Indices are integers, radii in metres."""
    reach = lambda r: F.floor(F.col(r) / size).cast("long")
    first, last = F.greatest(F.col(n0) - reach(r0), F.col(n1) - reach(r1)), F.least(F.col(n0) + reach(r0), F.col(n1) + reach(r1))
    cut = rows.withColumn("__first", first.cast("long")).withColumn("__last", last.cast("long")).where("__first <= __last")
    cut = cut.withColumn("n", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")

    def half(n: str, r: str) -> Column:
        """Cells on each side that are within the circle; the root's rounding is put right by the exact test."""
        beside = lambda k: F.pow((F.col("n") - F.col(n)) * size, 2) + F.pow(k * size, 2) <= F.pow(r, F.lit(2))
        root = F.floor(F.sqrt(F.greatest(F.pow(r, F.lit(2)) - F.pow((F.col("n") - F.col(n)) * size, 2), F.lit(0.0))) / size)
        return F.when(beside(root + 1), root + 1).when(beside(root), root).otherwise(root - 1).cast("long")

    wide = cut.withColumn("__h0", half(n0, r0)).withColumn("__h1", half(n1, r1))
    wide = wide.withColumn("lo", F.greatest(F.col(e0) - F.col("__h0"), F.col(e1) - F.col("__h1"))).withColumn("hi", F.least(F.col(e0) + F.col("__h0"), F.col(e1) + F.col("__h1")))
    return wide.where("__h0 >= 0 AND __h1 >= 0 AND lo <= hi").drop("__h0", "__h1")


def prism(rows: DataFrame, size: float, n0: str = "n0", e0: str = "e0", n1: str = "n1", e1: str = "e1", r0: str = "r0", r1: str = "r1") -> DataFrame:
    """rows exploded to the cells (n, e) of prism_spans()."""
    return prism_spans(rows, size, n0, e0, n1, e1, r0, r1).withColumn("e", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def in_ellipse(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column, elapsed: Column, stationary: Column, speed: float) -> Column:
    """Whether the way over the point fits the time that is left for moving."""
    leg = lambda a, b: F.sqrt(F.pow(x - a, 2) + F.pow(y - b, 2))
    return leg(x1, y1) + leg(x2, y2) <= (elapsed - stationary) * speed


def nearest_node(points: DataFrame, nodes: DataFrame, point_id: str, node_id: str, bucket: float, rings: int = 30) -> DataFrame:
    """Each point with its nearest node (least id on a tie) by buckets of the plane. A point whose nearest
    node in reach may not be the nearest of all is searched again with twice the buckets; points that no ring
    settles are an error. Nodes, the small side, are sent to the buckets around them, points to their own."""
    from trailmark.sources.folders import Kept

    kept, found, size = Kept(points.sparkSession, "nearest"), None, bucket
    left = points
    for k in range(rings):
        b = lambda c, s=size: F.floor(F.col(c) / s)
        near = left.withColumn("__bx", b("x")).withColumn("__by", b("y"))
        other = nodes.select(F.col(node_id), F.col("x").alias("node_x"), F.col("y").alias("node_y"))
        other = other.withColumn("__bx", F.explode(F.sequence(b("node_x") - 1, b("node_x") + 1))).withColumn("__by", F.explode(F.sequence(b("node_y") - 1, b("node_y") + 1)))
        d = F.sqrt(F.pow(F.col("x") - F.col("node_x"), 2) + F.pow(F.col("y") - F.col("node_y"), 2))
        best = near.join(other, ["__bx", "__by"]).withColumn("distance", d).groupBy(point_id).agg(F.min_by(F.struct(node_id, "node_x", "node_y", "distance"), F.struct("distance", node_id)).alias("best"))
        sure = kept.write(best.where(F.col("best.distance") <= size).select(point_id, f"best.{node_id}", "best.node_x", "best.node_y", "best.distance"), f"ring{k}")
        found = sure if found is None else found.unionByName(sure)
        left, size = kept.write(left.join(sure, point_id, "left_anti"), f"left{k}"), size * 2
        if left.isEmpty():
            return found
    raise ValueError(f"points without a node within {size / 2}")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether the point is inside the closed ring, an array of struct<x, y>, by the even-odd rule. Points on the
    ring are not inside it."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    crosses = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    between = lambda v, s, c: (v >= F.least(s["a"][c], s["b"][c])) & (v <= F.greatest(s["a"][c], s["b"][c]))
    turn = lambda s: (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (x - s["a"]["x"])
    on = lambda s: (turn(s) == 0) & between(x, s, "x") & between(y, s, "y")
    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, on)


def ring_column(ring: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring])


def in_polygon(x: Column, y: Column, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Inside an odd number of the rings (holes and parts); the bounding box is tried first. So a point on the outer
    ring is out, and one on the ring of a hole is in."""
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    inside = sum((in_ring(x, y, ring_column(r)).cast("int") for r in rings), F.lit(0)) % 2 == 1
    return F.when(x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)), inside).otherwise(False)


def lattice(df: DataFrame, x0: float, x1: float, y0: float, y1: float, size: float) -> DataFrame:
    """(easting, northing) of a lattice on the given ranges."""
    spark = df.sparkSession
    rows = spark.range(int((y1 - y0) // size) + 1).select((F.lit(y0) + F.col("id") * size).alias("northing"))
    return rows.withColumn("easting", F.explode(F.transform(F.sequence(F.lit(0), F.lit(int((x1 - x0) // size))), lambda k: F.lit(x0) + k * size)))


def densify(edges: DataFrame, step: float) -> DataFrame:
    """Points along the edges (x0, y0, x1, y1), both ends included, at most a step apart."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    rows = edges.withColumn("__n", F.greatest(F.ceil(length / step), F.lit(1)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("__n")
    return rows.withColumn("x", at("x0", "x1")).withColumn("y", at("y0", "y1")).drop("__n")


def density(points: DataFrame, key: str, bandwidth: float, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """(key, n, e, density): Epanechnikov density at the lattice cells within the bandwidth of a point. Points of
    one cell and place count together, so a cell is exploded once for each distinct place. Places are dealt by key
    before that, into as many partitions as set, so neither cells nor what follows by key is shuffled."""
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = points.where(F.col(key).isNotNull()).groupBy(key, x, y).agg(F.count("*").alias("w")).repartition(partitions, key)
    place = place.withColumn("total", F.sum("w").over(W.partitionBy(key)))
    box = lambda c: F.sequence(F.ceil((F.col(c) - bandwidth) / size), F.floor((F.col(c) + bandwidth) / size))
    cells = place.withColumn("e", F.explode(box(x))).withColumn("n", F.explode(box(y)))
    d2 = F.pow(F.col("e") * size - F.col(x), 2) + F.pow(F.col("n") * size - F.col(y), 2)
    inside = cells.withColumn("d2", d2).where(F.col("d2") < bandwidth * bandwidth)
    sums = inside.groupBy(key, "n", "e").agg(F.sum(F.col("w") * (1 - F.col("d2") / (bandwidth * bandwidth))).alias("s"), F.first("total").alias("total"))
    return sums.select(key, "n", "e", (F.col("s") * 2 / (3.141592653589793 * bandwidth * bandwidth * F.col("total"))).alias("density"))


def above_mean(cells: DataFrame, key: str, column: str = "density") -> DataFrame:
    """Cells at or above the mean of the nonzero ones."""
    mean = F.avg(F.when(F.col(column) > 0, F.col(column))).over(W.partitionBy(key))
    return cells.withColumn("__m", mean).where(F.col(column) >= F.col("__m")).drop("__m")


def neighbours(cells: DataFrame, key: str) -> DataFrame:
    """Pairs of a cell with each of its present neighbours of eight, and itself: (key, n, e, on, oe, other)."""
    around = F.array(*[F.struct(F.lit(a).alias("dn"), F.lit(b).alias("de")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    moved = cells.withColumn("__o", F.explode(around)).select(key, F.col("n").alias("on"), F.col("e").alias("oe"), F.col("density").alias("other"), (F.col("n") + F.col("__o.dn")).alias("n"), (F.col("e") + F.col("__o.de")).alias("e"))
    return cells.join(moved, [key, "n", "e"])


def peaks(cells: DataFrame, key: str) -> DataFrame:
    """Cells that no neighbour exceeds. Each cell goes to its own row of cells and the two beside it, where a window
    of three columns has its neighbours; cells dealt by key are not shuffled again."""
    rows = cells.withColumn("__row", F.explode(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)))
    top = F.max("density").over(W.partitionBy(key, "__row").orderBy("e").rangeBetween(-1, 1))
    return rows.withColumn("__top", top).where("n = __row AND density >= __top").drop("__row", "__top")


def basins(cells: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """Each cell with the peak (peak_n, peak_e) that steepest ascent leads to; ties go to the greater cell
    indices. Pointers are doubled, so rounds grow with the logarithm of the longest ascent."""
    from trailmark.sources.folders import Kept

    step = neighbours(cells, key).groupBy(key, "n", "e").agg(F.max(F.struct("other", "on", "oe")).alias("t"))
    kept = Kept(cells.sparkSession, "basins")
    now = kept.write(step.select(key, "n", "e", F.col("t.on").alias("peak_n"), F.col("t.oe").alias("peak_e")), "step0")
    for k in range(rounds):
        far = now.select(key, F.col("n").alias("peak_n"), F.col("e").alias("peak_e"), F.col("peak_n").alias("far_n"), F.col("peak_e").alias("far_e"))
        new = kept.write(now.join(far, [key, "peak_n", "peak_e"]).select(key, "n", "e", F.col("far_n").alias("peak_n"), F.col("far_e").alias("peak_e")), f"step{k + 1}")
        moved = new.join(now.select(key, "n", "e", F.col("peak_n").alias("a"), F.col("peak_e").alias("b")), [key, "n", "e"]).where("peak_n <> a OR peak_e <> b").limit(1).count()
        now = new
        if not moved:
            break
    return now


def visited_costs(hist: DataFrame, road: DataFrame, on: Sequence[str], count: str = "n", road_cost: float = 100.0, elsewhere: float = 100_000.0) -> DataFrame:
    """Cost of each cell: visited cells by 1 - share of all visits, rescaled to [0, 1]; else roads; else far."""
    totals = hist.where(F.col(count) > 0).agg(F.sum(count).alias("__total"))
    cost = hist.crossJoin(F.broadcast(totals)).withColumn("p", F.when(F.col(count) > 0, F.col(count) / F.col("__total")))
    cost = cost.withColumn("c", F.when((F.col("p") > 0) & (F.col("p") < 1), 1 - F.col("p")).when(F.col("p").isNotNull(), F.lit(0.0)))
    bounds = cost.agg(F.min("c").alias("__low"), F.max("c").alias("__high"))
    scaled = cost.crossJoin(F.broadcast(bounds)).withColumn("c", F.when(F.col("c").isNotNull(), F.when(F.col("__high") > F.col("__low"), (F.col("c") - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.0)))
    marked = scaled.join(road.select(*on).distinct().withColumn("__road", F.lit(True)), list(on), "left")
    value = F.coalesce("c", F.when(F.col("__road"), F.lit(road_cost)), F.lit(elsewhere))
    return marked.select(*on, value.alias("cost"))


def first_cell(df: DataFrame, cells: str) -> DataFrame:
    """n and e of a row's only cell, cut to whole numbers; of the least one where there are more, null where
    there is none."""
    least = F.array_min(cells)
    return df.withColumn("n", least["n"].cast("long")).withColumn("e", least["e"].cast("long"))
