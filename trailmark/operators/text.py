"""Stories of dwells, trips and bouts, and their TF-IDF similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from trailmark.operators.series import ordered

#: Words of two characters or more; a one-character word is no term.
TERM = r"(?<!\w)\w\w+(?!\w)"
#: Documents and terms of a block of the pairs of one corpus, at most on average; blocks of more than a few documents;
#: scores that a task holds at a time; bytes of a chunk of dense term columns; documents in a run of pairs of one document.
BLOCK_DOCS, BLOCK_TERMS, LEAST_BLOCKS, FEW_DOCS, SCORES, DENSE, RUN = 16_384, 1 << 20, 6, 512, 1 << 21, 1 << 26, 1024


def story(df: DataFrame, key: Sequence[str], order: Sequence[str], token: Column) -> DataFrame:
    """(key, tokens): the tokens in order; a null token is left out, an array of tokens is spliced in."""
    rows = df.select(*key, F.struct(*order).alias("at"), token.alias("token"))
    gathered = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("rows"))
    return gathered.select(*key, F.filter(F.transform("rows", lambda r: r["token"]), lambda t: t.isNotNull()).alias("tokens"))


def dwell_trip_story(segments: DataFrame, key: str, order: str = "segment", longer_than: int = 3) -> DataFrame:
    """Tokens d<duration> of dwells and t<duration> of trips, with t1 between two dwells in a row."""
    w = ordered(key, order)
    dwell = (F.col("trip_length") == 1) & (F.col("duration") > longer_than)
    rows = segments.withColumn("__d", dwell).withColumn("__b", F.coalesce(F.lag("__d").over(w), F.lit(False)))
    own = F.concat(F.when(F.col("__d"), "d").otherwise("t"), F.col("duration").cast("string"))
    token = F.when(F.col("__d") & F.col("__b"), F.array(F.lit("t1"), own)).otherwise(F.array(own))
    out = story(rows, [key], [order], token)
    return out.withColumn("tokens", F.flatten("tokens"))


def terms_of(text: Column) -> Column:
    """Lower-case terms of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of low to high tokens, joined by spaces."""
    parts = []
    for n in range(low, high + 1):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        parts.append(_joined_runs(tokens, starts, n))
    return F.concat(*parts)


def _joined_runs(tokens: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def tfidf(docs: DataFrame, doc: str, terms: str, corpus: Sequence[str] = ()) -> DataFrame:
    """(corpus, doc, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), each document of length 1. Documents with
    no term count in n and have no rows."""
    keys = list(corpus)
    n = docs.groupBy(*keys).agg(F.count("*").alias("n"))
    tf = docs.select(*keys, doc, F.explode(terms).alias("term")).groupBy(*keys, doc, "term").agg(F.count("*").alias("tf"))
    return weighted(tf, n, doc, keys)


def weighted(tf: DataFrame, n: DataFrame, doc: str, corpus: Sequence[str] = ()) -> DataFrame:
    """tfidf() of counted terms (corpus, doc, term, tf) and the number of documents (corpus, n)."""
    keys = list(corpus)
    df = tf.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    joined = tf.join(df, [*keys, "term"])
    joined = joined.join(n, keys) if keys else joined.crossJoin(F.broadcast(n))
    raw = joined.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(*keys, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, [*keys, doc]).select(*keys, doc, "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine_pairs(weights: DataFrame, doc: str, corpus: Sequence[str] = ()) -> DataFrame:
    """(corpus, i, j, score) of the pairs i > j that share a term. Documents of one corpus are paired by blocks, see
    of_blocks(); the small ones of many corpora are joined by term."""
    keys = list(corpus)
    if not keys:
        kind = weights.schema[doc].dataType.simpleString()
        return of_blocks(weights, doc, all_scores, f"i {kind}, j {kind}, score double", ["i", "j", "score"])
    a = weights.select(*keys, F.col(doc).alias("i"), "term", F.col("weight").alias("wi"))
    b = weights.select(*keys, F.col(doc).alias("j"), "term", F.col("weight").alias("wj"))
    return a.join(b, [*keys, "term"]).where("i > j").groupBy(*keys, "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("score"))


def of_blocks(weights: DataFrame, doc: str, found: Callable, schema: str, columns: list[str]) -> DataFrame:
    """What found() makes of the scores of all pairs of documents; weights has a term of a document once. Terms go by
    a 64-bit hash. Documents are dealt into blocks by ranges of their ids (by hash if these are no numbers), and a task
    has two blocks (or one twice), so each document's terms are shuffled once for every block, packed, and pairs are not.
    Within a block like documents stand side by side, so that what is made of pairs in this order is small when written.
    found() takes an iterator of (i, j, score) of some documents i with all j of a block, 0 where none is a pair, and yields
    tuples of columns."""
    from trailmark.sources.folders import Kept

    weights = weights.where(F.col(doc).isNotNull())
    # a row for each document, whose terms and weights are bytes: a fraction of a row for each term
    packed = F.pandas_udf(lambda x: x.map(lambda v: np.asarray(v).tobytes()), "binary")
    each = weights.groupBy(F.col(doc).alias("doc")).agg(F.collect_list(F.struct(F.xxhash64("term").alias("term"), "weight")).alias("of"))
    whole = each.select("doc", F.size("of").alias("size"), F.sort_array("of").alias("of")).select("doc", "size", packed("of.term").alias("terms"), packed("of.weight").alias("weights"))
    # written once, as their number is needed before they are dealt
    whole = Kept(weights.sparkSession, "pairs").write(whole, "documents")
    size = whole.agg(F.count("*").alias("docs"), F.sum("size").alias("terms")).first()
    docs = size["docs"]
    blocks = 1 if docs <= FEW_DOCS else max(LEAST_BLOCKS, -(-docs // BLOCK_DOCS), -(-size["terms"] // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("doc", F.lit(7)), F.lit(blocks))
    if blocks > 1 and isinstance(weights.schema[doc].dataType, NumericType):
        cuts = whole.agg(F.percentile_approx("doc", [k / blocks for k in range(1, blocks)], 10_000)).first()[0]
        block = sum(((F.col("doc") > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    rows = whole.select("doc", "terms", "weights", block.cast("int").alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pair = F.least("block", "other") * blocks + F.greatest("block", "other")
    # every group has one task's work, so they are dealt one by one and not merged by their bytes
    groups = blocks * (blocks + 1) // 2
    spread = rows.select(pair.alias("pair"), (F.col("block") <= F.col("other")).alias("left"), "doc", "terms", "weights")

    def unpacked(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["terms"].map(len).to_numpy(np.int64) // 8
        term, weight = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("terms", np.int64), ("weights", np.float64)))
        return pd.DataFrame({"doc": pdf["doc"].to_numpy().repeat(n), "term": term, "weight": weight})

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["terms", "weights", "doc"])
        a, b = divmod(int(key[0]), blocks)
        left = unpacked(pdf if a == b else pdf[pdf["left"]])
        for out in found(block_scores(left, left if a == b else unpacked(pdf[~pdf["left"]]))):
            yield pd.DataFrame(dict(zip(columns, out, strict=True)))

    return spread.repartition(groups, "pair").groupBy("pair").applyInPandas(run, schema)


def block_scores(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of documents of two blocks (doc, term, weight): the scores of some i of the left one with all j of
    the right one, 0 unless i > j or the blocks differ, where each pair is met once. Terms that many documents have are
    multiplied as a dense matrix, others by the pairs that share them."""
    i_of, ids = pd.factorize(left["doc"])
    j_of, jds = pd.factorize(right["doc"])
    if not len(ids) or not len(jds):
        return
    code, names = pd.factorize(np.concatenate([left["term"].to_numpy(), right["term"].to_numpy()]))
    a, b = code[: len(left)], code[len(left) :]
    wa, wb = left["weight"].to_numpy(), right["weight"].to_numpy()
    na, nb = np.bincount(a, minlength=len(names)), np.bincount(b, minlength=len(names))
    shared = (na > 0) & (nb > 0)
    common = np.flatnonzero(shared & (na * nb > len(ids) * len(jds) / 64))
    rare = np.flatnonzero(shared & (na * nb <= len(ids) * len(jds) / 64))
    place = np.full(len(names), -1)
    place[common] = np.arange(len(common))
    ids, jds = np.asarray(ids), np.asarray(jds)
    # the right block: rare terms in the order of term, dense ones as chunks of columns
    order = np.argsort(b, kind="stable")
    starts = np.concatenate([[0], np.cumsum(nb)])
    jr, wr = j_of[order], wb[order]
    is_rare = np.zeros(len(names), bool)
    is_rare[rare] = True
    by_doc = np.argsort(i_of, kind="stable")
    ia, ta, va = i_of[by_doc], a[by_doc], wa[by_doc]
    cuts = np.searchsorted(ia, np.arange(len(ids) + 1))
    step = max(1, SCORES // len(jds))
    wide = max(1, DENSE // (8 * len(jds)))
    cb = place[b]
    dense_b = []
    if len(common) <= wide:
        dense_b = [(0, len(common), _columns(j_of, cb, wb, len(jds), 0, len(common)))]
    same = len(left) == len(right) and left is right
    for r in range(0, len(ids), step):
        to = min(len(ids), r + step)
        s = slice(cuts[r], cuts[to])
        i, t, v = ia[s] - r, ta[s], va[s]
        score = np.zeros((to - r, len(jds)))
        c = place[t]
        for low, high, matrix in dense_b or ((x, y := min(x + wide, len(common)), _columns(j_of, cb, wb, len(jds), x, y)) for x in range(0, len(common), wide)):
            score += _columns(i, c, v, to - r, low, high) @ matrix.T
        few = np.flatnonzero(is_rare[t])
        n = nb[t[few]]
        # pieces of some million pairs of equal rare terms
        ends = np.cumsum(n)
        for k in range(0, int(ends[-1]) if len(ends) else 0, SCORES):
            p, q = np.searchsorted(ends, k, "right"), np.searchsorted(ends, min(k + SCORES, int(ends[-1])), "left") + 1
            part, m = few[p:q], n[p:q]
            rows = np.repeat(np.arange(len(part)), m)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(m) - m, m)
            begun = np.repeat(ends[p:q] - m, m) + at
            mine = (begun >= k) & (begun < k + SCORES)
            rows, at = rows[mine], at[mine]
            right_at = starts[t[part]][rows] + at
            flat = i[part][rows] * len(jds) + jr[right_at]
            score += np.bincount(flat, v[part][rows] * wr[right_at], score.size).reshape(score.shape)
        if same:
            score[ids[r:to, None] <= jds[None]] = 0.0
        yield ids[r:to], jds, score


def _columns(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, low: int, high: int) -> np.ndarray:
    """A dense matrix of the columns low to high (not included); column -1 is none."""
    out = np.zeros((rows, high - low))
    x = (column >= low) & (column < high)
    out[row[x], column[x] - low] = value[x]
    return out


def all_scores(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, score), i the greater, of the pairs that share a term, in runs of one document and many others."""
    for i, j, score in blocks:
        for k in range(0, len(j), RUN):
            r, c = np.nonzero(score[:, k : k + RUN])
            a, b, s = i[r], j[k + c], score[r, k + c]
            first = a > b
            if first.any():
                yield a[first], b[first], s[first]
            if not first.all():
                yield b[~first], a[~first], s[~first]


def both_ways(above: float, digits: int) -> Callable:
    """For of_blocks(): (id, other) of the pairs whose scores, rounded half up, are beyond a threshold, once for each
    direction, in runs of one id."""

    def found(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        for i, j, score in blocks:
            for k in range(0, len(j), RUN):
                edge = np.floor(score[:, k : k + RUN] * 10.0**digits + 0.5) / 10.0**digits > above
                r, c = np.nonzero(edge)
                yield i[r], j[k + c]
                c, r = np.nonzero(edge.T)
                yield j[k + c], i[r]

    return found


def similar_both_ways(weights: DataFrame, doc: str, above: float, digits: int) -> DataFrame:
    """(id, other) of the cosine pairs of one corpus beyond a threshold, scores rounded, in both directions."""
    kind = weights.schema[doc].dataType.simpleString()
    return of_blocks(weights, doc, both_ways(above, digits), f"id {kind}, other {kind}", ["id", "other"])


def degrees_of(above: float, digits: int) -> Callable:
    """For of_blocks(): (node, degree, weighted) of the edges of a block at a time, whose scores, rounded half up, are
    beyond a threshold."""

    def found(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        for i, j, score in blocks:
            score = np.floor(score * 10.0**digits + 0.5) / 10.0**digits
            edge = score > above
            weight = np.where(edge, 1 - score, 0.0)
            for node, axis in ((i, 1), (j, 0)):
                n = edge.sum(axis)
                yield node[n > 0], n[n > 0], weight.sum(axis)[n > 0]

    return found


def similarity_degrees(weights: DataFrame, doc: str, above: float, digits: int) -> DataFrame:
    """weighted_degrees() of similarity_edges() of the cosine pairs of one corpus, scores rounded, of which no pair leaves
    its task."""
    kind = weights.schema[doc].dataType.simpleString()
    each = of_blocks(weights, doc, degrees_of(above, digits), f"node {kind}, degree long, weighted double", ["node", "degree", "weighted"])
    out = each.groupBy("node").agg(F.sum("degree").alias("degree"), F.sum("weighted").alias("weighted"))
    return out.withColumn("mean_weight", F.col("weighted") / F.col("degree"))


def similarity_edges(pairs: DataFrame, above: float) -> DataFrame:
    """Edges (i, j, 1 - score) of the pairs beyond a threshold."""
    return pairs.where(F.col("score") > above).select("i", "j", (1 - F.col("score")).alias("weight"))


def weighted_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, weighted, mean_weight) of an undirected edge table."""
    both = edges.select(F.explode(F.array("i", "j")).alias("node"), "weight")
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted"), F.avg("weight").alias("mean_weight"))
