"""Results that larger tables and odd inputs have shown to be wrong or too dear."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmark import catalog
from trailmark.functions import scalar
from trailmark.operators import communities, graph, spatial, text, transit
from trailmark.plans import prisms
from trailmark.queries import places

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_rounding_of_halves_is_that_of_the_sql(spark):
    values = [k / 1e9 for k in range(50, 200_000, 100)] + [-1.5e-7, 0.0, 1e12, -2.5]
    want = [r[0] for r in duckdb.execute("SELECT round(v, 7) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert [r[0] for r in df.select(scalar.rounded(F.col("v"), 7)).collect()] == want
    assert df.select(scalar.rounded(F.lit(None).cast("double"), 7)).first()[0] is None


def test_points_on_rings(spark):
    at = [(x, y) for x in (5.0, 6.0, 20.5, 30.0, 40.5, 60.0, 80.5) for y in (5.5, 6.0, 20.5, 30.0, 60.5, 70.0, 90.5)] + [(5.5, 30.0), (5.5, 5.5)]
    df = spark.createDataFrame(at, "x double, y double").coalesce(1)
    got = [r[0] for r in df.select(spatial.in_polygon(F.col("x"), F.col("y"), places.SQUARE)).collect()]
    assert got == [5.5 < x < 80.5 and 5.5 < y < 90.5 and not (20.5 < x < 40.5 and 20.5 < y < 60.5) for x, y in at]
    slope = [[(0.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (5.0, 5.0), (4.0, 4.0), (0.0, 1.0)], "x double, y double").coalesce(1)
    assert [r[0] for r in df.select(spatial.in_polygon(F.col("x"), F.col("y"), slope)).collect()] == [False, True, False, False, False]


def test_first_cell_of_equal_minutes_is_the_first_events(spark):
    rows = [(k, 1, 5, e, 2) for k, e in enumerate((7, 3, 9))] + [(3, 1, 6, 0, 0), (9, 2, 5, 4, 4), (8, 2, 5, 6, 3), (7, 2, 5, 5, 3)]
    df = spark.createDataFrame(rows, "event_id long, trip long, minute int, e long, n long").coalesce(1)
    assert {r["trip"]: (r["n"], r["e"]) for r in places.first_cells(df).collect()} == {1: (2, 7), 2: (3, 5)}
    con = duckdb.connect()
    con.execute("CREATE TABLE p AS SELECT * FROM (VALUES " + ", ".join(str(r) for r in sorted(rows)) + ") t(event_id, trip, minute, e, n)")
    assert con.execute("SELECT trip, arg_min(n, minute * 1000 + n), arg_min(e, minute * 1000 + n) FROM p GROUP BY trip ORDER BY trip").fetchall() == [(1, 2, 7), (2, 3, 5)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_peaks_shuffle_places_only(spark):
    rows = [(k % 3, float(k * 7 % 40), float(k * 11 % 30)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    dens = spatial.density(df, "id", 15.0, 5.0)
    cells = {(r["id"], r["n"], r["e"]): r["density"] for r in dens.collect()}
    near = lambda i, n, e: [cells[i, n + a, e + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (i, n + a, e + b) in cells]
    # once for the places and once to deal them by id: neither cells nor their neighbours
    found = spatial.peaks(dens, "id")
    assert exchanges(found) <= 2 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["n"], r["e"]) for r in found.collect()} == {k for k, d in cells.items() if d >= max(near(*k))}


def test_scores_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(k, [f"w{min(int(v), 60)}" for v in rng.zipf(1.4, 12)]) for k in range(40)] + [(40, ["alone"]), (None, ["w1"])]
    w = text.tfidf(spark.createDataFrame(docs, "doc long, terms array<string>"), "doc", "terms")
    rows = [r for r in w.collect() if r["doc"] is not None]
    of = {d: {r["term"]: r["weight"] for r in rows if r["doc"] == d} for d in range(41)}
    want = {(i, j): sum(x * of[j][t] for t, x in of[i].items() if t in of[j]) for i in of for j in of if i > j and set(of[i]) & set(of[j])}
    monkeypatch.setattr(text, "FEW_DOCS", 3)
    got = {(r["i"], r["j"]): r["score"] for r in text.cosine_pairs(w, "doc").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    # a few scores and columns at a time
    monkeypatch.setattr(text, "SCORES", 50)
    monkeypatch.setattr(text, "DENSE", 8 * 41 * 2)
    frame = pd.DataFrame([(r["doc"], hash(r["term"]), r["weight"]) for r in rows], columns=["doc", "term", "weight"])
    found = {(i, j): s for a, b, c in text.all_scores(text.block_scores(frame, frame)) for i, j, s in zip(a, b, c, strict=True)}
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k]) for k in want)


PAIRS = ["x08_cosine", "g05_similarity_edges", "x11_subset_similarity", "j20_all_pairs"]


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_are_not_shuffled(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Exchange hash" not in plan[: plan.index("FlatMapGroupsInPandas")]


def test_degrees_find_pairs_once(spark):
    plan = catalog.queries()["g04_degrees"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "Union" not in plan


def test_traits_do_not_shuffle_pairs(spark):
    plan = catalog.queries()["j21_similar_traits"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "Exchange hash" not in plan[: plan.index("FlatMapGroupsInPandas")]


@pytest.mark.parametrize("name", ["x08_cosine", "j21_similar_traits"])
def test_documents_are_written_once_and_dealt_once(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pairs = plan[plan.index("FlatMapGroupsInPandas") :].split("Union")[0].split("HashAggregate")[0]
    assert pairs.count("Exchange") == 1 and "FileScan parquet [doc#" in pairs


def test_pairs_come_in_runs_and_both_ways(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(text, "RUN", 5)
    rows = [(d, t, float(x)) for d in range(24) for t, x in enumerate(rng.random(6) * (rng.random(6) < 0.5)) if x]
    frame = pd.DataFrame(rows, columns=["doc", "term", "weight"])
    of = {d: dict(zip(g["term"], g["weight"], strict=True)) for d, g in frame.groupby("doc")}
    want = {(i, j): sum(x * of[j][t] for t, x in of[i].items() if t in of[j]) for i in of for j in of if i > j and set(of[i]) & set(of[j])}
    halves = [frame[frame["doc"] % 2 == k] for k in (0, 1)]
    blocks = lambda: (x for a, b in ((halves[0], halves[0]), (halves[1], halves[1]), (halves[0], halves[1])) for x in text.block_scores(a, b))
    runs = list(text.all_scores(blocks()))
    got = {(i, j): s for a, b, c in runs for i, j, s in zip(a, b, c, strict=True)}
    assert len(got) == sum(len(a) for a, _, _ in runs) == len(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert all(min(len(set(a)), len(set(b))) <= 5 for a, b, _ in runs)
    both = [(i, j) for a, b in text.both_ways(0.3, 9)(blocks()) for i, j in zip(a, b, strict=True)]
    assert sorted(both) == sorted(x for (i, j), s in want.items() if s > 0.3 for x in ((i, j), (j, i)))


def test_spans_by_brute_force_and_a_few_hits_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    person = [tuple(map(int, r)) for r in zip(rng.integers(0, 9, 300), rng.integers(0, 12, 300), rng.integers(0, 2, 300), rng.integers(0, 2, 300), strict=True)]
    bus = [(k % 3, k, int(m), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for k in range(20) for m in rng.integers(0, 12, 4)]
    hits = {}
    for t, m, n, e in person:
        for r, b, *at in bus:
            if at == [m, n, e]:
                hits.setdefault((t, r, b), set()).add(m)
    want = {k: (len(v), max(v) - min(v) + 1) for k, v in hits.items() if max(v) - min(v) + 1 > 2}
    p, q = spark.createDataFrame(person, "trip long, minute int, n int, e int"), spark.createDataFrame(bus, "route long, bus_trip long, minute int, n int, e int")
    found = transit.shared_spans(p, q, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInPandas")]
    assert {(r["trip"], r["route"], r["bus_trip"]): (r["hits"], r["span"]) for r in found.collect()} == want
    monkeypatch.setattr(transit, "HITS", 7)
    cell = lambda m, n, e: m * 4 + n * 2 + e
    people = pd.DataFrame({(cell(*r[1:]), r[0]) for r in person}, columns=["cell", "id"])
    trips = pd.DataFrame([(cell(*r[2:]), r[1], r[0], r[2]) for r in bus], columns=["cell", "id", "route", "minute"])
    out = pd.concat(list(transit.span_rows(people, trips, 2)))
    assert {(t, r, b): (h, s) for t, r, b, h, s in out.itertuples(index=False)} == want


def test_bus_probability_shuffles_no_shared_minutes(spark):
    plan = catalog.queries()["t09_bus_probability"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Join Inner" not in plan[: plan.index("FlatMapGroupsInPandas")]


def test_raster_fills_are_whole_and_search_equal_ends_once(spark):
    rng = np.random.default_rng(7)
    ends = [tuple(map(int, x)) for x in rng.integers(0, 8, (12, 4))] + [(3, 3, 3, 3)]
    gaps = [(int(rng.integers(-(1 << 63), 1 << 63)), *ends[k % 13], 1 + k % 5) for k in range(40)]
    cost = {(n, e): 0.5 if (n + e) % 3 == 0 else 100.0 for n in range(-5, 20) for e in range(-5, 20)}
    raster = spark.createDataFrame([(*c, v) for c, v in cost.items()], "n int, e int, cost double")
    df = spark.createDataFrame(gaps, "gap_id long, n0 int, e0 int, n1 int, e1 int, missing int")
    got = {(r["gap_id"], r["k"]): (r["n"], r["e"]) for r in graph.raster_fill(df, raster, 50.0, 3).collect()}
    want = {}
    for g, n0, e0, n1, e1, missing in gaps:
        path = graph.raster_path(cost, (n0, e0), (n1, e1), (min(n0, n1) - 3, max(n0, n1) + 3, min(e0, e1) - 3, max(e0, e1) + 3))
        for k, (n, e) in enumerate(graph.along(path, missing)[1:-1], 1):
            want[g, k] = (round(n), round(e))
    assert got == want
    plan = graph.raster_fill(df, raster, 50.0, 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(n0" in plan and not any("missing" in line for line in plan.splitlines() if "hashpartitioning(n0" in line)


def test_path_filled_minutes_look_back_only_and_share_tasks(spark):
    start = pd.Timestamp("2024-01-01")
    rng = np.random.default_rng(3)
    cells = {k: [tuple(map(int, c)) if rng.random() < 0.4 else None for c in rng.integers(0, 90, (30, 2))] for k in range(4)} | {4: [None, (1, 2), None], 5: [(300, 300), None, None, (300, 300), None, (301, 303)]}
    rows = [(k, (start + pd.Timedelta(minutes=m)).to_pydatetime(), *(c or (None, None))) for k, row in cells.items() for m, c in enumerate(row)]
    known = spark.createDataFrame(rows, "id long, minute timestamp_ntz, n int, e int")
    cost = {(n, e): 0.5 if (n + e) % 3 == 0 else 100.0 for n in range(95) for e in range(95)}
    raster = spark.createDataFrame([(*c, v) for c, v in cost.items()], "n int, e int, cost double")
    want = {}
    for k, row in cells.items():
        at = [m for m, c in enumerate(row) if c]
        want |= {(k, m): row[m] for m in at}
        for a, b in zip(at, at[1:], strict=False):
            p, q = row[a], row[b]
            limits = (min(p[0], q[0]) - 3, max(p[0], q[0]) + 3, min(p[1], q[1]) - 3, max(p[1], q[1]) + 3)
            path = [p] if p == q else graph.raster_path(cost, p, q, limits) or [p, q]
            if np.hypot(p[0] - q[0], p[1] - q[1]) * 50.0 <= graph.LONGEST_SEARCH:
                want |= {(k, a + m): (round(n), round(e)) for m, (n, e) in enumerate(graph.along(path, b - a - 1)[1:-1], 1) if b - a > 1}
    filled = prisms.filled_by_paths(known, raster, "id", "minute", 50.0, margin=3)
    got = filled.collect()
    assert len(got) == len(want) and {(r["id"], round((r["minute"] - start).total_seconds() / 60)): (r["n"], r["e"]) for r in got} == want
    plan = filled._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "flatmapcogroupsinpandas" in plan


class OneProcess:
    """communities.Jobs without executors."""

    def __init__(self, vectors):
        self.vectors = vectors

    def run(self, state, low, high, make, schema):
        rows = list(make(self.vectors, state, low, high))
        return rows if len(rows[0]) > 2 else [{"links": x} for _, x in rows]


@pytest.mark.parametrize("small", [{}, {"HELD": 3}, {"HELD": 3, "BATCH": 20, "ROWS": 7, "COLUMNS": 16, "LARGE": 4, "LISTED": 2, "GROUPS": 5}, {"HELD": 3, "BATCH": 40, "DENSE": 0, "ROWS": 7, "COLUMNS": 16, "PIECE": 30}])
def test_communities_are_those_of_all_edges(monkeypatch, small):
    for k, v in small.items():
        monkeypatch.setattr(communities, k, v)
    rng = np.random.default_rng(11)
    for above in (0.5, 0.8, 0.9):
        x = rng.random((60, 6)) * (rng.random((60, 6)) < 0.6)
        x = x[x.sum(1) > 0]
        x = np.concatenate([x, x[:20]])
        x /= np.linalg.norm(x, axis=1)[:, None]
        score = np.floor(x @ x.T * 1e9 + 0.5) / 1e9
        want = graph.louvain([(i, j, 1 - score[i, j]) for i in range(len(x)) for j in range(i) if score[i, j] > above])
        terms = [np.flatnonzero(r) for r in x]
        vectors = communities.Vectors([t.astype(np.int64).tobytes() for t in terms], [r[t].tobytes() for r, t in zip(x, terms, strict=True)], above)
        of, degree = communities.partition(OneProcess(vectors))
        assert {k: int(of[k]) for k in np.flatnonzero(degree > 0).tolist()} == want


def test_communities_of_more_than_two_million_edges(spark, tmp_path, monkeypatch):
    n = 2300
    kinds = ["click", "view", "error", "signup", "purchase"]
    rng = np.random.default_rng(2)
    rows = [(u * 6 + k, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=k), u, kinds[int(c)] if k else "click", float(v), '{"k": 1}') for u in range(n) for k, (c, v) in enumerate(zip(rng.integers(0, 5, 6), rng.integers(0, 150, 6), strict=True))]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    query = catalog.queries()["g04_communities"]
    assert catalog.queries()["g05_similarity_edges"](spark, str(tmp_path)).count() > 2_000_000
    got = {r["id"]: r["community"] for r in query(spark, str(tmp_path)).collect()}
    assert len(got) == n
    monkeypatch.setattr(communities, "HELD", n)
    assert {r["id"]: r["community"] for r in query(spark, str(tmp_path)).collect()} == got


def test_documents_without_edges_have_no_community(spark):
    docs = spark.createDataFrame([(3, ["a"]), (5, ["a", "b"]), (9, ["c"]), (None, ["a"])], "doc long, terms array<string>")
    w = text.tfidf(docs, "doc", "terms")
    assert {r["id"]: r["community"] for r in communities.similar_communities(w, "doc", 0.5).collect()} == graph.louvain([(5, 3, 0.4)])
    assert communities.similar_communities(w.where("doc > 9"), "doc", 0.5).collect() == []
