"""Near duplicates by similarity: sets of five-word shingles whose Jaccard similarity is 0.8 or more.

Candidates come from ball hashing on several fingerprints of each text. A fingerprint is of one band of
minwise hashes: one minimum is the key, four bits of each of the other eight are a 32-bit code. Texts that
share a band's key and whose codes differ in at most three bits are candidates; these are found by
meet-in-the-middle ball hashing of the codes, in groups of any size and in both rounds. At similarity 0.8 a
band finds a pair with probability 0.8 x 0.60, so all sixteen miss about 3 of 100,000 such pairs, and fewer
of more similar ones. Candidates are verified by the exact similarity of their sets.

Components take two rounds. In the first, each text is compared with few hubs of its groups, so a large group
of near copies gives as many pairs as texts. In the second, all candidate pairs are compared whose texts the
first has not joined, so no pair is lost by the choice of hubs. In both only such are candidates as agree in
LEAST_EQUAL of the 128 four-bit values of all their codes: at similarity 0.8 the mean is 104 and the deviation
4.4, so that loses between one and two pairs of a million by calculation, and leaves out nearly all of
similarity 0.5 and below. Pairs nearer to 0.8 are left out by a bound that loses none: only shingles that a
contender of another component holds too can be shared with it, and in each of CLASSES classes of them two
sets share at most the lesser count. Only pairs that the bound allows leave a task and are verified; in a
large group whose members are below the similarity, pairs of near codes still grow with its square.

Defined results: words are as for the fingerprints of op3 (lower case); a text of fewer words than a shingle
is one shingle, null and empty texts have equal sets; texts of equal sets are one node (64-bit digest); of a
component the rows of the least id stay, or one row where none has an id.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.components import connected_components, only_first
from trailmark.llm.scratch import Scratch
from trailmark.llm.simhash import RADIUS, bucket_variants, links, odd, pair_masks, single_masks
from trailmark.llm.words import MULTIPLIERS, mix, run_hashes, utf8, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Bands of a key and so many minima for the code.
BANDS, CODE_MINIMA = 16, 8
MINIMA = BANDS * (1 + CODE_MINIMA)
#: Equal four-bit values of the codes of all bands that a pair of the second round needs: 5 deviations below
#: the mean at similarity 0.8.
LEAST_EQUAL = 82
#: Records of a bucket of band keys, on average; codes whose variants a task emits at a time.
BUCKET_RECORDS, VALUES = 100_000, 8192
BLOCK = 1 << 20
#: Classes of shingles by which the second round bounds what two sets share.
CLASSES = 64
CODE_BITS, KEY_BITS, CODE_WIDTH = list(range(32)), list(range(32, 64)), np.uint64(32)
SALTS = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(MULTIPLIERS[0])) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct runs of words, in order."""
    hashes = word_hashes(utf8(text).lower().split())
    if not len(hashes):
        return np.zeros(1, np.uint64)
    return np.unique(run_hashes(hashes, min(shingle, len(hashes)), MULTIPLIERS[0]))


def node_of(shingles: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), np.uint64).view(np.int64))


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, code) of each band, as signed longs."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[a : a + 2048, None] ^ SALTS[MINIMA:]) * SALTS[:MINIMA]).min(0))
    minima = mix(least ^ SALTS[:MINIMA]).reshape(BANDS, -1)
    codes = np.zeros(BANDS, np.uint64)
    for j in range(1, 1 + CODE_MINIMA):
        codes = (codes << np.uint64(4)) | (minima[:, j] >> np.uint64(60))
    return minima[:, 0].view(np.int64), codes.view(np.int64)


def ball_variants(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, value): what values emit so that any two within the radius meet, as for the fingerprints of op3, but
    only the code's bits are flipped: the others tell keys apart. Of three bits two lie in one half of the code."""
    even = values[~odd(values)]
    single, double = single_masks(CODE_BITS), np.concatenate([pair_masks(CODE_BITS[:16]), pair_masks(CODE_BITS[16:])])
    emitted = [(even, even), *[((of[:, None] ^ masks).ravel(), np.repeat(of, len(masks))) for of, masks in ((values, single), (even, double))]]
    variant, value = (np.concatenate(x) for x in zip(*emitted, strict=True))
    return variant, value


def balls(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant, value) of distinct sorted values, some of their groups (the bits above the code) at a time; a very large
    group is taken apart by variants, so that each variant comes at one time."""
    group = values >> CODE_WIDTH
    starts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(values)) if len(values) else np.zeros(1, np.int64)
    k = 0
    while k < len(starts) - 1:
        to = max(k + 1, int(np.searchsorted(starts, starts[k] + VALUES, "right")) - 1)
        part = values[starts[k] : starts[to]]
        if len(part) > VALUES:
            above = part[0] >> CODE_WIDTH << CODE_WIDTH
            for variant, value in bucket_variants(part ^ above, KEY_BITS, 0, CODE_BITS):
                yield variant | above, value | above
        elif len(part) > 1:
            yield ball_variants(part)
        k = to


def code_links(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of distinct sorted values within the radius: the members of each variant's group with its hub."""
    for variant, value in balls(values):
        u, v = links(variant, value)
        yield np.searchsorted(values, u), np.searchsorted(values, v)


def code_pairs(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i < j) of all distinct sorted values within the radius, but those of one and the same label. low, high:
    the least and greatest label of each. A pair may come more than once."""
    for variant, value in balls(values):
        order = np.argsort(variant, kind="stable")
        variant, at = variant[order], np.searchsorted(values, value[order])
        for _ in range(2):
            # the second time of those only whose variant is one of several labels
            first = np.concatenate([[True], variant[1:] != variant[:-1]])[: len(variant)]
            begin, run = np.flatnonzero(first), np.cumsum(first) - 1
            if len(at):
                mixed = (np.minimum.reduceat(low[at], begin) != np.maximum.reduceat(high[at], begin))[run]
                variant, at = variant[mixed], at[mixed]
        before = np.arange(len(at)) - begin[run]
        ends = np.concatenate([[0], np.cumsum(before)])
        k = 0
        while k < len(at):
            to = max(k + 1, int(np.searchsorted(ends, ends[k] + BLOCK, "right")) - 1)
            n = before[k:to]
            i, j = at[np.repeat(begin[run[k:to]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], np.repeat(at[k:to], n)
            x = (np.bitwise_count(values[i] ^ values[j]) <= RADIUS) & ((low[i] != high[j]) | (low[j] != high[i]))
            both = np.unique(np.minimum(i[x], j[x]) * len(values) + np.maximum(i[x], j[x]))
            yield both // len(values), both % len(values)
            k = to


def grouped(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The number of each row's group above its code, with a bit by which the numbers are all even: a value is odd if its
    code is."""
    above = group.astype(np.uint64)
    above = above << np.uint64(1) | np.bitwise_count(above).astype(np.uint64) & np.uint64(1)
    return above << CODE_WIDTH | code.view(np.uint64) & np.uint64(0xFFFFFFFF)


def hub_pairs(group: np.ndarray, node: np.ndarray, code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of the texts of each key's group: each code's texts with one of them, and that one with the first of those of near
    codes that a ball links it to."""
    value = grouped(group, code)
    order = np.lexsort((mix(node.view(np.uint64) ^ code.view(np.uint64)), value))
    node, value = node[order], value[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    values, hubs = value[first], node[first]
    out = [(hubs[np.cumsum(first) - 1], node)]
    for i, j in code_links(values):
        both = np.unique(np.maximum(i, j) * len(values) + np.minimum(i, j))
        later, at = np.unique(both // len(values), return_index=True)
        out.append((hubs[both[at] % len(values)], hubs[later]))
    return out


def equal_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many four-bit values are equal in each row of two arrays of codes."""
    x = a ^ b
    x |= x >> np.uint32(1)
    x |= x >> np.uint32(2)
    return 8 * a.shape[1] - np.bitwise_count(x & np.uint32(0x11111111)).sum(1, dtype=np.int64)


def apart(group: np.ndarray, node: np.ndarray, code: np.ndarray, label: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the texts of each key's group: places (i, j) of all of near codes and different labels that agree enough in all
    bands. codes: of all bands, a row for each text."""
    order = np.argsort(value := grouped(group, code), kind="stable")
    value = value[order]
    if not len(value):
        return
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    n, values = np.diff(np.append(start, len(value))), value[start]
    low, high = np.minimum.reduceat(label[order], start), np.maximum.reduceat(label[order], start)
    several = np.flatnonzero(low != high)
    for i, j in itertools.chain([(several, several)], code_pairs(values, low, high)):
        # all texts of the one code with those of the other
        ends = np.cumsum(n[i] * n[j])
        for a in range(0, int(ends[-1]) if len(ends) else 0, BLOCK >> 4):
            at = np.arange(a, min(a + (BLOCK >> 4), int(ends[-1])))
            pair = np.searchsorted(ends, at, "right")
            at -= ends[pair] - n[i[pair]] * n[j[pair]]
            p, q = order[start[i[pair]] + at // n[j[pair]]], order[start[j[pair]] + at % n[j[pair]]]
            x = (label[p] != label[q]) & ((i[pair] != j[pair]) | (p < q))
            p, q = p[x], q[x]
            x = equal_values(codes[p], codes[q]) >= LEAST_EQUAL
            yield p[x], q[x]


def may_be_similar(counts: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets at places i and j can have the similarity: of each class of shingles they share at most the
    lesser of their two counts. counts: of the supported shingles by class, a row for each set."""
    step = max(1, BLOCK // counts.shape[1])
    most = np.concatenate([np.zeros(0, np.int64), *[np.minimum(counts[i[a : a + step]], counts[j[a : a + step]]).sum(1, dtype=np.int64) for a in range(0, len(i), step)]])
    return most / np.maximum(1, size[i] + size[j] - most) >= similarity


def of_keys(nodes: DataFrame, carried: list[str], found: Callable[[dict[str, np.ndarray]], list[tuple[np.ndarray, ...]]], schema: list[str]) -> DataFrame:
    """Rows of longs that found() gives of the texts of each band key, distinct in each task. nodes: node, keys,
    codes and the carried columns; found() takes arrays by column, arrays of arrays as rows of one, and the number of
    each row's key in group; texts alone with a key are left out."""
    buckets = max(1, -(-nodes.count() * BANDS // BUCKET_RECORDS))
    bands = F.posexplode(F.arrays_zip("keys", "codes")).alias("band", "of")
    records = nodes.select("node", *carried, bands).select("node", *carried, F.xxhash64("band", "of.keys").alias("key"), F.col("of.codes").alias("code"))

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        key = pdf["key"].to_numpy()
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        shared = np.bincount(group)[group] > 1
        pdf, group = pdf[shared], group[shared]
        columns = {c: np.stack(pdf[c].to_numpy()) if len(pdf) and pdf[c].dtype == object else pdf[c].to_numpy() for c in ("node", "code", *carried)}
        out = [tuple(np.zeros(0, np.int64) for _ in schema)]
        if len(pdf):
            out += found(columns | {"group": group})
        return pd.DataFrame(dict(zip(schema, map(np.concatenate, zip(*out, strict=True)), strict=True))).drop_duplicates()

    spread = records.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return spread.groupBy("bucket").applyInPandas(lambda key, pdf: rows(pdf), ", ".join(f"{c} long" for c in schema)).distinct()


def ordered(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, v = u[u != v], v[u != v]
    return np.minimum(u, v), np.maximum(u, v)


def hub_candidates(nodes: DataFrame) -> DataFrame:
    """(u, v): pairs of nodes (node, keys, codes) by hubs."""
    return of_keys(nodes, [], lambda x: [ordered(u, v) for u, v in hub_pairs(x["group"], x["node"], x["code"])], ["u", "v"])


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes (node, codes) that agree enough in all bands: what fails that is no candidate of the
    second round either, and costs no set."""
    codes = nodes.select("node", low_bits("codes").alias("codes"))
    both = pairs.join(codes.withColumnsRenamed({"node": "u", "codes": "a"}), "u").join(codes.withColumnsRenamed({"node": "v", "codes": "b"}), "v")

    def different(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x11111111)))

    unlike = F.aggregate(F.zip_with("a", "b", different), F.lit(0), lambda n, x: n + x)
    return both.where(unlike <= BANDS * CODE_MINIMA - LEAST_EQUAL).select("u", "v")


def contenders(nodes: DataFrame) -> DataFrame:
    """(node): those of nodes (node, label, keys, codes) that are a candidate with one of another label."""

    def found(x: dict[str, np.ndarray]) -> list[tuple[np.ndarray]]:
        return [(np.unique(x["node"][np.concatenate([i, j])]),) for i, j in apart(x["group"], x["node"], x["code"], x["label"], x["every"].view(np.uint32))]

    return of_keys(nodes.withColumn("every", low_bits("codes")), ["label", "every"], found, ["node"])


def supported_counts(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, size, counts): of sets (node, label, shingles), how many supported shingles each class has. Supported
    are those that a set of another label holds too; sets with too few of them to be similar to any other are left out."""
    each = sets.select("node", "label", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("shingle")
    classes = each.join(shared, "shingle", "left_semi").groupBy("node", F.pmod("shingle", F.lit(CLASSES)).cast("int").alias("class")).agg(F.count("*").cast("int").alias("n"))
    by_class = classes.groupBy("node").agg(F.sum("n").alias("supported"), F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("by_class"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.coalesce(F.element_at("by_class", k), F.lit(0)))
    sized = sets.select("node", F.size("shingles").cast("long").alias("size"))
    return by_class.join(sized, "node").where(F.col("supported") / F.col("size") >= similarity).select("node", "size", counts.alias("counts"))


def apart_candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): all pairs of nodes (node, label, keys, codes, size, counts) of different labels that can be similar."""

    def found(x: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for i, j in apart(x["group"], x["node"], x["code"], x["label"], x["every"].view(np.uint32)):
            true = may_be_similar(x["counts"], x["size"], i, j, similarity)
            out.append(ordered(x["node"][i[true]], x["node"][j[true]]))
        return out

    return of_keys(nodes.withColumn("every", low_bits("codes")), ["label", "every", "size", "counts"], found, ["u", "v"])


def low_bits(codes: str) -> Column:
    """The 32-bit codes as ints."""
    return F.transform(codes, lambda c: F.shiftright(F.shiftleft(c, 32), 32).cast("int"))


def sets_of(nodes: DataFrame, docs: DataFrame, prints: DataFrame, scratch: Scratch, name: str, text_col: str) -> DataFrame:
    """(node, shingles), written: the sets of the nodes (node)."""
    texts = scratch.keep(prints.join(nodes.select("node").distinct(), "node").groupBy("node").agg(F.min("text_hash").alias("text_hash")), f"{name}_texts")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")

    def sets(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                each = [shingle_set(t) for t in pdf["text"].iloc[a : a + 256]]
                yield pd.DataFrame({"node": [node_of(x) for x in each], "shingles": [x.view(np.int64) for x in each]})

    found = docs.select(text).withColumn("text_hash", F.xxhash64("text")).join(texts.select("text_hash"), "text_hash", "left_semi").select("text")
    return scratch.keep(found.mapInPandas(sets, "node long, shingles array<long>").dropDuplicates(["node"]), f"{name}_sets")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs whose shingle sets have at least the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common / (F.size("a") + F.size("b") - common) >= similarity).select("u", "v")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their component of similar texts; same columns. Rows of one id
    are one document. Runs at once but for the last join."""
    scratch = Scratch(docs.sparkSession, "near_duplicates")

    def prints_of(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a : a + 1024]
                each = [shingle_set(t) for t in part["text"]]
                drawn = [sketch(x) for x in each]
                yield pd.DataFrame({"id": part["id"], "text_hash": part["text_hash"], "node": [node_of(x) for x in each], "keys": [k for k, _ in drawn], "codes": [c for _, c in drawn]})

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    id_type = docs.schema[id_col].dataType.simpleString()
    prints = scratch.keep(rows.mapInPandas(prints_of, f"id {id_type}, text_hash long, node long, keys array<long>, codes array<long>"), "prints")
    nodes = scratch.keep(prints.groupBy("node").agg(F.min("id").alias("first_id"), F.min("text_hash").alias("first_hash"), F.first("keys").alias("keys"), F.first("codes").alias("codes")), "nodes")
    pairs = scratch.keep(agreeing(hub_candidates(nodes), nodes), "hub_pairs")
    sets = sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))), docs, prints, scratch, "hub", text_col)
    hubs = scratch.keep(similar(pairs, sets, similarity), "hub_links")
    stars = connected_components(hubs, scratch).select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = scratch.keep(nodes.join(stars, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    sets = sets_of(scratch.keep(contenders(labels), "contenders"), docs, prints, scratch, "apart", text_col)
    counts = scratch.keep(supported_counts(sets.join(labels.select("node", "label"), "node"), similarity), "counts")
    pairs = scratch.keep(apart_candidates(labels.join(counts, "node"), similarity), "apart_pairs")
    rest = scratch.keep(similar(pairs, sets, similarity), "apart_links")
    final = Scratch(docs.sparkSession, "near_duplicates_links")
    stars = connected_components(hubs.union(rest), final).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = nodes.select("node", "first_id", "first_hash").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.min("first_hash").alias("first_hash"))
    classes = rooted.drop("first_hash").join(least, "root").select("node", "component_id", "first_hash")
    found = prints.select("id", "text_hash", "node").join(classes, "node").select("id", "text_hash", "component_id", "first_hash")
    found = Scratch(docs.sparkSession, "near_duplicates_result").keep(found, "classes")
    final.drop()
    scratch.drop()
    return only_first(docs, found, id_col, text_col)
