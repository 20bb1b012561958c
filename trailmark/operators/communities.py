"""Communities of documents whose edges are too many to be kept: they are made anew from the documents' vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a weight, which is a whole number of them, so that sums do not depend on their order; what an edge of no weight counts.
ONE, TINY = 1e9, 2.0**-30
#: Units whose links to each other the driver holds; documents that move between two jobs, as expected.
HELD, BATCH = 2048, 4096
#: Rows and columns of the weights made at a time, and columns for one unit; documents of a large community; communities that a unit's list has at least, of groups of them; numbers of
#: the dense vectors of all documents.
ROWS, COLUMNS, PIECE, LARGE, LISTED, GROUPS, DENSE = 128, 1024, 1 << 16, 32, 24, 128, 1 << 24


class Vectors:
    """Vectors of documents: dense ones if there are few terms, else sparse."""

    def __init__(self, terms: list[bytes], weights: list[bytes], above: float):
        self.n, self.above = len(terms), above
        sizes = np.array([len(t) // 8 for t in terms], np.int64)
        names, self.term = np.unique(np.frombuffer(b"".join(terms), np.int64), return_inverse=True)
        self.value, self.start = np.frombuffer(b"".join(weights), np.float64), np.concatenate([[0], np.cumsum(sizes)])
        self.wide, self.dense = len(names), None
        if self.n * self.wide <= DENSE:
            self.dense = np.zeros((self.n, self.wide))
            self.dense[np.arange(self.n).repeat(sizes), self.term] = self.value
            self.term = self.value = self.start = None

    def take(self, nodes: np.ndarray) -> np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a dense matrix, or (start, term, value)."""
        if self.dense is not None:
            return self.dense[nodes]
        n = self.start[nodes + 1] - self.start[nodes]
        start = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(start[-1]) + (self.start[nodes] - start[:-1]).repeat(n)
        return start, self.term[at], self.value[at]

    def weights(self, a: np.ndarray | tuple, b: np.ndarray | tuple, room: np.ndarray | None = None) -> np.ndarray:
        """Weights 1 - score of what was taken, in parts; 0 where there is no edge."""
        if self.dense is None:
            names = np.unique(a[1])
            a, b = self._of(a, names), self._of(b, names)
        s = np.matmul(a * ONE, b.T, out=None if room is None else room[: len(a) * len(b)].reshape(len(a), len(b)))
        np.rint(s, out=s)
        edge = None if not s.size or s.min() > self.above * ONE else s > self.above * ONE
        np.subtract(ONE, s, out=s)
        np.maximum(s, TINY, out=s)
        return s if edge is None else np.multiply(s, edge, out=s)

    def _of(self, rows: tuple, names: np.ndarray) -> np.ndarray:
        start, term, value = rows
        place = np.searchsorted(names, term)
        place[place == len(names)] = 0
        known = names[place] == term if len(names) else np.zeros(len(term), bool)
        out = np.zeros((len(start) - 1, len(names)))
        out[np.arange(len(start) - 1).repeat(np.diff(start))[known], place[known]] = value[known]
        return out


@dataclass
class State:
    """Units (sets of documents), in the order of documents' units, and the communities that they are in."""

    unit: np.ndarray
    of: np.ndarray
    degree: np.ndarray
    inside: np.ndarray
    total: float

    def __post_init__(self) -> None:
        self.by_unit = np.argsort(self.unit, kind="stable")
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.unit, minlength=len(self.of)))])
        self.settle()

    def settle(self) -> None:
        """The communities that are left and their documents, after moves."""
        self.label = self.of[self.unit]
        self.by_label = np.argsort(self.label, kind="stable")
        sizes = np.bincount(self.label, minlength=len(self.inside))
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        # the largest first
        self.names = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
        self.rank = np.zeros(len(sizes), np.int64)
        self.rank[self.names] = np.arange(len(self.names))
        self.rank, self.sizes = self.rank[self.of], sizes[self.names]

    def nodes(self, low: int, high: int) -> np.ndarray:
        return self.by_unit[self.bounds[low] : self.bounds[high]]

    def members(self, community: int) -> np.ndarray:
        return self.by_label[self.cuts[community] : self.cuts[community + 1]]


def links(vectors: Vectors, state: State, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(unit, links): those of some units at a time to each community that is left, their own documents left out."""
    large = int(np.searchsorted(-state.sizes, -LARGE, "right"))
    # a large community is summed by itself; of the others come all first documents, all second ones and so on
    layers = [(state.members(c), k, k + 1) for k, c in enumerate(state.names[:large].tolist())]
    for m in range(int(state.sizes[large]) if large < len(state.sizes) else 0):
        to = int(np.searchsorted(-state.sizes, -m, "left"))
        for c in range(large, to, COLUMNS):
            layers.append((state.by_label[state.cuts[state.names[c : min(to, c + COLUMNS)]] + m], c, min(to, c + COLUMNS)))
    pieces = [(part, vectors.take(part) if vectors.dense is not None else None, c, to) for nodes, c, to in layers for part in np.split(nodes, range(COLUMNS, len(nodes), COLUMNS))]
    room, first = np.zeros(ROWS * COLUMNS), low
    while first < high:
        last = max(first + 1, int(np.searchsorted(state.bounds, state.bounds[first] + ROWS, "right")) - 1)
        last = min(last, high)
        nodes, out = state.nodes(first, last), np.zeros((last - first, len(state.names)))
        for r in range(0, len(nodes), ROWS):
            some = nodes[r : r + ROWS]
            unit, rows, each = state.unit[some], vectors.take(some), out if len(nodes) == last - first else np.zeros((len(some), len(state.names)))
            for part, columns, c, to in pieces:
                w = vectors.weights(rows, vectors.take(part) if columns is None else columns, room)
                units = state.unit[part]
                mine = np.flatnonzero((units >= first) & (units < last))
                if len(mine):
                    w[:, mine] *= unit[:, None] != units[mine]
                if to - c == len(part):
                    each[:, c:to] += w
                else:
                    each[:, c] += w.sum(1)
            if each is not out:
                ends = np.searchsorted(unit, np.arange(first, last + 1))
                for u in range(last - first):
                    out[u] += each[ends[u] : ends[u + 1]].sum(0)
        yield first, out
        first = last


def lists(vectors: Vectors, state: State, low: int, high: int) -> Iterator[tuple[int, float, float, np.ndarray, np.ndarray]]:
    """(unit, own, least, communities, links) of units: the links to the own community and to the others whose gain is
    best; every other one's is below least."""
    inside, width = state.inside[state.names], len(state.names) // GROUPS
    for first, found in links(vectors, state, low, high):
        units = np.arange(first, first + len(found))
        mine = units - first, state.rank[units]
        score = inside * (state.degree[units] / -state.total)[:, None]
        score += found
        if found.min() <= 0:
            score[found <= 0] = -np.inf
        score[mine] = -np.inf
        least = np.full(len(units), -np.inf)
        if width:
            tops = score[:, : width * GROUPS].reshape(len(units), GROUPS, width).max(2)
            least = np.partition(tops, -LISTED, axis=1)[:, -LISTED] - 0.002
        row, at = np.nonzero(score >= np.maximum(least, -1e300)[:, None])
        ends = np.searchsorted(row, np.arange(len(units) + 1))
        own, good, of_good = found[mine].tolist(), state.names[at], found[row, at]
        for r, u in enumerate(units.tolist()):
            part = slice(ends[r], ends[r + 1])
            yield u, own[r], float(least[r]), good[part], of_good[part]


class Jobs:
    """What executors make of the vectors, which are broadcast once: a row for each document, while edges are its square."""

    def __init__(self, spark: SparkSession, vectors: Vectors):
        self.spark, self.vectors = spark, vectors
        self.shared = spark.sparkContext.broadcast(vectors)

    def run(self, state: State, low: int, high: int, make: Callable[[Vectors, State, int, int], Iterable[tuple]], schema: str) -> list:
        """Rows of make() of the units from low to high, in their order."""
        shared, now = self.shared, self.spark.sparkContext.broadcast(state)
        names = [c.split()[0] for c in schema.split(", ")]
        # each task has its share of documents, and makes the columns once
        tasks = int(min(high - low, max(1, self.spark.sparkContext.defaultParallelism * 2)))
        at = np.linspace(state.bounds[low], state.bounds[high], tasks + 1)
        ends = np.unique(np.concatenate([[low], np.searchsorted(state.bounds, at[1:-1]), [high]])).clip(low, high).tolist()

        def work(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for pdf in batches:
                for k in pdf["id"].tolist():
                    rows = make(shared.value, now.value, ends[k], ends[k + 1])
                    yield pd.DataFrame(list(rows), columns=names)

        found = self.spark.range(0, len(ends) - 1, 1, len(ends) - 1).mapInPandas(work, schema).collect()
        now.destroy()
        return sorted(found)

    def close(self) -> None:
        self.shared.destroy()


def packed_links(vectors: Vectors, state: State, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    for first, found in links(vectors, state, low, high):
        each = np.zeros((len(found), len(state.inside)))
        each[:, state.names] = found
        yield from ((first + r, row.tobytes()) for r, row in enumerate(each))


def packed_lists(vectors: Vectors, state: State, low: int, high: int) -> Iterator[tuple[int, float, float, bytes, bytes]]:
    for u, own, least, communities, found in lists(vectors, state, low, high):
        yield u, own, least, communities.astype(np.int64).tobytes(), found.tobytes()


def best_of(own: int, own_links: float, communities: np.ndarray, found: np.ndarray, inside: np.ndarray, share: float) -> tuple[int, float]:
    """The community of most gain, and the gain: of equal ones the own one, else the least."""
    mine = round(own_links - float(inside[own]) * share, 3)
    if not len(communities):
        return own, mine
    score = np.round(found - inside[communities] * share, 3)
    top = float(score.max())
    return (int(communities[score == top].min()), top) if top > mine else (own, mine)


def held_moves(weight: np.ndarray, degree: np.ndarray, total: float) -> np.ndarray:
    """Community of each unit, from a matrix of links."""
    n = len(weight)
    of, inside = np.arange(n), degree.copy()
    moved = True
    while moved:
        moved = False
        for u in range(n):
            row = np.bincount(of, weight[u], n)
            own = int(of[u])
            inside[own] -= degree[u]
            others = np.flatnonzero(row > 0)
            best, _ = best_of(own, float(row[own]), others[others != own], row[others[others != own]], inside, degree[u] / total)
            inside[best] += degree[u]
            of[u] = best
            moved |= best != own
    return of


class Touched:
    """Communities that moves have changed since executors saw them, with all their documents."""

    def __init__(self, vectors: Vectors, communities: int):
        self.vectors, self.n = vectors, 0
        self.place, self.names, self.k = np.full(communities, -1), np.zeros(1024, np.int64), 0
        self.at = np.full(vectors.n, -1)
        self.node, self.of = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.rows = None if vectors.dense is None else np.zeros((1024, vectors.wide))

    def add(self, community: int, nodes: np.ndarray) -> None:
        if self.place[community] >= 0:
            return
        to = self.n + len(nodes)
        while to > len(self.node):
            self.node, self.of, self.names = np.tile(self.node, 2), np.tile(self.of, 2), np.tile(self.names, 2)
            self.rows = None if self.rows is None else np.tile(self.rows, (2, 1))
        self.place[community], self.names[self.k] = self.k, community
        self.k += 1
        self.node[self.n : to], self.of[self.n : to] = nodes, self.place[community]
        if self.rows is not None:
            self.rows[self.n : to] = self.vectors.dense[nodes]
        self.at[nodes] = np.arange(self.n, to)
        self.n = to

    def move(self, nodes: np.ndarray, community: int) -> None:
        self.of[self.at[nodes]] = self.place[community]

    def links(self, nodes: np.ndarray) -> np.ndarray:
        """Links of a unit to each touched community."""
        taken = self.rows[: self.n] if self.rows is not None else self.vectors.take(self.node[: self.n])
        sums = np.zeros(self.n)
        for r in range(0, len(nodes), ROWS):
            sums += self.vectors.weights(self.vectors.take(nodes[r : r + ROWS]), taken).sum(0)
        mine = self.at[nodes]
        sums[mine[mine >= 0]] = 0.0
        return np.bincount(self.of[: self.n], sums, self.k)


def listed_moves(jobs: Jobs, state: State) -> np.ndarray:
    """The same moves in the same order as held_moves(), for more units. Executors list the best communities of a batch of
    units by what holds at its begin; the driver moves one unit after the other. Communities changed since then are
    weighed anew, and so are all of them if none of the list is left that beats what is not listed. Lists of all units
    serve further passes while few communities have changed."""
    vectors, n = jobs.vectors, len(state.of)
    moved, rate, rows = True, 1.0, None
    while moved:
        moved, low = False, 0
        while low < n:
            wanted = state.bounds[low] + int(BATCH / max(rate, BATCH / vectors.n))
            high = n if rows else min(n, max(low + 1, int(np.searchsorted(state.bounds, wanted, "right")) - 1))
            if rows is None:
                rows = jobs.run(state, low, high, packed_lists, "unit long, own double, least double, communities binary, links binary")
                touched = Touched(vectors, len(state.inside))
            moves = 0
            for u, own_links, least, communities, found in rows:
                nodes, own, share = state.nodes(u, u + 1), int(state.of[u]), state.degree[u] / state.total
                communities, found = np.frombuffer(communities, np.int64), np.frombuffer(found, np.float64)
                state.inside[own] -= state.degree[u]
                if touched.n:
                    left = touched.place[communities] < 0
                    anew, names = touched.links(nodes), touched.names[: touched.k]
                    if touched.place[own] >= 0:
                        own_links = float(anew[touched.place[own]])
                    linked = (anew > 0) & (names != own)
                    communities, found = np.concatenate([communities[left], names[linked]]), np.concatenate([found[left], anew[linked]])
                best, gain = best_of(own, own_links, communities, found, state.inside, share)
                if gain < least + 0.001:
                    best = whole(vectors, state, u, own, share)
                state.inside[best] += state.degree[u]
                if best != own:
                    moves += 1
                    for c in (own, best):
                        touched.add(c, state.members(c))
                    touched.move(nodes, best)
                    state.of[u] = state.label[nodes] = best
            moved |= moves > 0
            rate = max(moves / (high - low), rate / 4)
            if high - low < n or touched.n > BATCH:
                rows = None
                state.settle()
            low = high
    return state.of


def whole(vectors: Vectors, state: State, u: int, own: int, share: float) -> int:
    """The best community of a unit, of all."""
    nodes, sums = state.nodes(u, u + 1), np.zeros(vectors.n)
    for c in range(0, vectors.n, PIECE):
        part = vectors.take(np.arange(c, min(vectors.n, c + PIECE))) if vectors.dense is None else vectors.dense[c : c + PIECE]
        for r in range(0, len(nodes), ROWS):
            sums[c : c + PIECE] += vectors.weights(vectors.take(nodes[r : r + ROWS]), part).sum(0)
    sums[nodes] = 0.0
    found = np.bincount(state.label, sums, len(state.inside))
    others = np.flatnonzero(found > 0)
    others = others[others != own]
    return best_of(own, float(found[own]), others, found[others], state.inside, share)[0]


def similar_communities(weights: DataFrame, doc: str, above: float) -> DataFrame:
    """(id, community) of the documents (doc, term, weight; each term once) that have an edge: those of graph.louvain() of
    the edges i, j, 1 - score, where the score, rounded to nine digits, is beyond a threshold. Edges are made in the tasks
    that sum them and are neither collected nor written; the driver has a vector for each document."""
    spark = weights.sparkSession
    packed = F.pandas_udf(lambda x: x.map(lambda v: np.asarray(v).tobytes()), "binary")
    each = weights.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("term"), "weight"))).alias("of"))
    rows = each.select("doc", packed("of.term").alias("terms"), packed("of.weight").alias("weights")).toPandas().sort_values("doc")
    ids = rows["doc"].to_numpy()
    if not len(ids):
        return spark.createDataFrame([], "id long, community long")
    jobs = Jobs(spark, Vectors(rows["terms"].tolist(), rows["weights"].tolist(), above))
    try:
        of, degree = partition(jobs)
    finally:
        jobs.close()
    out = pd.DataFrame({"id": ids, "community": ids[of]})[degree > 0]
    return spark.createDataFrame(out.astype("int64"), "id long, community long")


def partition(jobs: Jobs) -> tuple[np.ndarray, np.ndarray]:
    """The community of each document, named by one of them, and the documents' degrees."""
    n = jobs.vectors.n
    alone, none = np.arange(n), np.zeros(n)
    one = State(alone, np.zeros(n, np.int64), none, np.zeros(1), 1.0)
    degree = np.concatenate([np.frombuffer(r["links"], np.float64) for r in jobs.run(one, 0, n, packed_links, "unit long, links binary")])
    weighted = np.rint(degree)
    total = float(weighted.sum()) or 1.0
    of, held, first = alone, None, True
    while True:
        # units are numbered in the order of their names
        names, unit = np.unique(of, return_inverse=True)
        sums = np.bincount(unit, weighted)
        if held is None and len(names) <= HELD:
            state = State(unit, np.arange(len(names)), sums, sums.copy(), total)
            held = np.array([np.frombuffer(r["links"], np.float64) for r in jobs.run(state, 0, len(names), packed_links, "unit long, links binary")])
        elif held is not None:
            # links between the units that a community had
            grouped = np.zeros((len(names), len(names)))
            np.add.at(grouped, (of_held[:, None], of_held[None]), held)
            held = grouped * (1 - np.eye(len(names)))
        if held is not None:
            to = held_moves(held, sums, total)
            of_held = np.unique(to, return_inverse=True)[1]
        else:
            to = listed_moves(jobs, State(unit, np.arange(len(names)), sums, sums.copy(), total))
        of = names[to[unit]]
        if not first and len(np.unique(to)) == len(names):
            return of, degree
        first = False
