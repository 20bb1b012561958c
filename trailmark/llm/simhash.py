"""Near duplicates by SimHash fingerprints of word shingles, linked by meet-in-the-middle ball hashing.

Fingerprints that differ in at most three bits meet in a variant: every fingerprint emits variants within
half the radius of it, rounded to whole bits, and two that emit the same variant are a colliding pair.
Which variants are emitted keeps the balls small and loses no pair:

* of an odd number of set bits: all variants at distance 1;
* of an even number: itself, all at distance 1, and those at distance 2 whose two flipped bits lie in the
  same half of the 64 (of three differing bits, two always do).

At distance 1 and 3 the two parities differ, and the even one reaches a neighbour of the odd one (or the
even one itself is such a neighbour); at distance 2 they are equal and share a neighbour. Colliding pairs
are verified. In one variant's group it is enough to link all members to one hub, so groups of copies give
as many links as members, not pairs.

The shuffle goes by the variants' leading bits (the most balanced ones): a record per fingerprint and
prefix that its variants can have, at most 1 + k + k(k-1)/2 of k bits. The receiving task emits the
variants of its prefix, and splits the prefix further while there are too many, so its memory is bounded.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows
are repeated in the result; an empty table gives an empty one; null ids never are a component's id, and
where a component has no other its id is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.components import connected_components, local_roots, only_first
from trailmark.llm.scratch import Scratch
from trailmark.llm.words import slices, utf8

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Variants that one prefix may have on average, and that a task holds at a time.
BUCKET_VARIANTS, MOST_VARIANTS = 1 << 20, 1 << 22
#: Variants of a fingerprint, on average of both parities.
MEAN_VARIANTS = 560
BLOCK_BYTES = 1 << 20
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes (repeats included)."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    values = np.array(hashes, np.uint64)
    total = np.zeros(64, np.int64)
    for a in range(0, len(values), 1 << 15):
        part = values[a : a + (1 << 15)]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(values)).view(">u8")[0])


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long."""

    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return F.pandas_udf(fingerprints, T.LongType())(text)


def pair_masks(bits: list[int]) -> np.ndarray:
    """Of the flips of two of these bits that lie in the same half."""
    pairs = [(a, b) for i, a in enumerate(bits) for b in bits[i + 1 :] if a // 32 == b // 32]
    return np.array([(1 << a) | (1 << b) for a, b in pairs], np.uint64)


def single_masks(bits: list[int]) -> np.ndarray:
    return np.array([1 << b for b in bits], np.uint64)


def odd(values: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(values) & 1).astype(bool)


def prefix_of(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for b in bits:
        out = out * 2 + ((values >> np.uint64(b)) & ONE).astype(np.int64)
    return out


def prefixes(values: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, fingerprint): every prefix that a variant of the fingerprint has."""
    even = values[~odd(values)]
    out_p, out_v = [prefix_of(values, bits)], [values]
    for masks, of in ((single_masks(bits), values), (pair_masks(bits), even)):
        for m in masks:
            out_p.append(prefix_of(of ^ m, bits))
            out_v.append(of)
    return np.concatenate(out_p), np.concatenate(out_v)


def prefix_mask(bits: list[int], prefix: int) -> tuple[np.uint64, np.uint64]:
    """The mask of the prefix's bits, and those of them that are set."""
    return np.uint64(sum(1 << b for b in bits)), np.uint64(sum(1 << b for i, b in enumerate(reversed(bits)) if prefix >> i & 1))


def variants(values: np.ndarray, bits: list[int], prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(variant, fingerprint): the variants with this prefix, and whose they are."""
    rest = [b for b in range(64) if b not in bits]
    mask, wanted = prefix_mask(bits, prefix)
    flips = (values ^ wanted) & mask
    count, is_odd = np.bitwise_count(flips), odd(values)
    halves = [np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)]
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def emit(of: np.ndarray, at: np.ndarray, masks: np.ndarray | None) -> None:
        if masks is None:
            out.append((at, of))
        elif len(masks) and len(of):
            out.append(((at[:, None] ^ masks).ravel(), np.repeat(of, len(masks))))

    at = values ^ flips
    here = count == 0
    emit(values[here & ~is_odd], at[here & ~is_odd], None)
    emit(values[here], at[here], single_masks(rest))
    emit(values[here & ~is_odd], at[here & ~is_odd], pair_masks(rest))
    emit(values[count == 1], at[count == 1], None)
    for half in halves:
        near = (count == 1) & ~is_odd & ((flips & half) != 0)
        emit(values[near], at[near], single_masks([b for b in rest if int(half) >> b & 1]))
        near = (count == 2) & ~is_odd & ((flips & ~half) == 0)
        emit(values[near], at[near], None)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def links(variant: np.ndarray, value: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that share a variant: all of its group with the group's hub, an odd fingerprint
    or else the one nearest to the variant. Verified: pairs beyond the radius are none."""
    distance = np.bitwise_count(variant ^ value)
    rank = np.where(odd(value), 0, distance.astype(np.int64) + 1)
    order = np.lexsort((value, rank, variant))
    variant, value = variant[order], value[order]
    first = np.concatenate([[True], variant[1:] != variant[:-1]])
    hub = value[np.flatnonzero(first)][np.cumsum(first) - 1]
    true = (hub != value) & (np.bitwise_count(hub ^ value) <= radius)
    return hub[true], value[true]


def bucket_variants(values: np.ndarray, bits: list[int], prefix: int, spare: list[int], most: int = MOST_VARIANTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """variants() with the prefix, taken apart by further bits while there are too many."""
    if len(values) < 2:
        return
    mask, wanted = prefix_mask(bits, prefix)
    flips, is_odd = np.bitwise_count((values ^ wanted) & mask), odd(values)
    size = np.where(flips == 0, np.where(is_odd, 64, 1057), np.where((flips == 1) & ~is_odd, 32, 1)).sum()
    if spare and size > most:
        for bit in (0, 1):
            longer, sub = [*bits, spare[0]], prefix * 2 + bit
            mask, wanted = prefix_mask(longer, sub)
            near = np.bitwise_count((values ^ wanted) & mask)
            yield from bucket_variants(values[near <= np.where(is_odd, 1, 2)], longer, sub, spare[1:], most)
        return
    yield variants(values, bits, prefix)


def bucket_links(values: np.ndarray, bits: list[int], prefix: int, spare: list[int], most: int = MOST_VARIANTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """links() of all variants with the prefix, taken apart by further bits while there are too many."""
    for emitted in bucket_variants(values, bits, prefix, spare, most):
        yield links(*emitted)


def fingerprint_links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """(u, v): links between the distinct fingerprints (signed longs), a spanning forest for each prefix."""
    counts = distinct.agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]).first()
    n = counts["n"]
    by_balance = sorted(range(64), key=lambda b: (abs(2 * (counts[f"b{b}"] or 0) - n), b))
    depth = min(20, max(0, int(np.ceil(np.log2(max(1, n * MEAN_VARIANTS / BUCKET_VARIANTS))))))
    bits, spare = by_balance[:depth], by_balance[depth:]

    def spread(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 4096):
                p, v = prefixes(pdf[fp].to_numpy()[a : a + 4096].view(np.uint64), bits)
                yield pd.DataFrame({"prefix": p, "fp": v.view(np.int64)})

    def collide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for pair in bucket_links(values, bits, int(key[0]), spare):
            found.append(pair)
            if sum(len(x) for x, _ in found) > MOST_VARIANTS:
                found = [local_roots(*map(np.concatenate, zip(*found, strict=True)))]
        u, v = local_roots(*map(np.concatenate, zip(*found, strict=True)))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    placed = distinct.select(F.col(fp).alias("fp")).mapInPandas(spread, "prefix long, fp long")
    return placed.groupBy("prefix").applyInPandas(collide, "u long, v long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: the fingerprint as a signed long, and the least id reachable by
    links, the row's own included. Runs at once; the result is a written table."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint_column(F.col(f"`{text_col}`")).alias("fp"))
    prints = scratch.keep(prints, "prints")
    first = scratch.keep(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "first")
    stars = connected_components(scratch.keep(fingerprint_links(first.select("fp")), "links"), scratch)
    rooted = first.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    out = Scratch(docs.sparkSession, "simhash_result").keep(prints.join(classes, "fp").select("id", "fp", "component_id"), "rows")
    scratch.drop()
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their component; same columns. Rows of one id are one document,
    and of a component without ids one row stays."""
    found = simhash_components(docs, id_col, text_col)
    # fingerprints are linked by what texts say, so a text's component is that of any row with it
    texts = docs.select(fingerprint_column(F.col(f"`{text_col}`")).alias("fp"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_hash")).distinct()
    of = found.groupBy("fp").agg(F.min("component_id").alias("component_id"))
    rows = texts.join(of, "fp")
    least = rows.where("component_id IS NULL").groupBy("fp").agg(F.min("text_hash").alias("first_hash"))
    return only_first(docs, rows.join(least, "fp", "left"), id_col, text_col)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
