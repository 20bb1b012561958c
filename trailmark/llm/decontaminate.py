"""Benchmark decontamination by suffix arrays of the training text.

Documents are taken in shards (a few MB of text). A shard's words get a sparse suffix array: the suffixes
that begin with enough words of the benchmark's vocabulary, the only ones that can match. Every suffix of
every test item is binary-searched in it, which gives where its window of ``window`` words occurs; runs
of such places give the longest verbatim matches. No shuffle is needed: the benchmark goes to the shards,
in blocks of ``BLOCK_BYTES`` at most, one after the other, so neither the driver nor a task holds more than
one block's index whatever the benchmark's size.

Defined results: null texts and items have no words and match nothing; repeated items count as items of
their own; repeated documents get equal rows; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.scratch import Scratch
from trailmark.llm.words import covered, slices, utf8

WINDOW = 10
#: Bytes of benchmark text that are sent to the executors at a time, and of documents in a shard.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 2 << 20
#: Lower-cases A-Z, and makes all ASCII but letters and digits a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: No text holds this byte, so it is a word that no item has.
BETWEEN = b" \xff "
#: Bytes of a word's number in a suffix key.
ID_BYTES = 4
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
MATCHES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "longest")]
    + [T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]
)


def item_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


def suffix_keys(ids: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The first width words of the suffixes at starts as byte strings that sort as the words do."""
    padded = np.concatenate([ids, np.zeros(width, ids.dtype)]).astype(">u4")
    keys = np.ascontiguousarray(padded[starts[:, None] + np.arange(width)])
    return keys.view(f"S{ID_BYTES * width}").ravel()


def build_index(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict:
    """What the shards need of the test items: vocabulary, distinct windows, and where those stand."""
    vocabulary: dict[bytes, int] = {}
    places: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
    names = []
    for name, text in items:
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in item_words(text)]
        width = min(window, len(words))
        for q in range(len(words) - width + 1 if words else 0):
            places[tuple(words[q : q + width])].append((len(names), q))
        names.append(name)
    windows = sorted(places)
    return {"window": window, "vocabulary": vocabulary, "names": names, "windows": windows, "places": [places[w] for w in windows]}


def search_shard(ids: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places in ids (0: no word of the benchmark) where windows start, and the windows' numbers."""
    windows, width = index["windows"], index["window"]
    none = np.zeros(0, np.int64)
    if not windows or not len(ids):
        return none, none
    # words of the vocabulary from each place on
    gaps = np.flatnonzero(np.append(ids, 0) == 0)
    reach = gaps[np.searchsorted(gaps, np.arange(len(ids)))] - np.arange(len(ids))
    starts = np.flatnonzero(reach >= min(map(len, windows)))
    if not len(starts):
        return none, none
    keys = suffix_keys(ids, starts, width)
    order = np.argsort(keys, kind="stable")
    keys, starts = keys[order], starts[order]
    flat = np.zeros((len(windows), width), ">u4")
    top = np.full((len(windows), width), 0xFFFFFFFF, ">u4")
    for k, w in enumerate(windows):
        flat[k, : len(w)] = top[k, : len(w)] = w
    low = np.searchsorted(keys, flat.view(f"S{ID_BYTES * width}").ravel(), "left")
    high = np.searchsorted(keys, top.view(f"S{ID_BYTES * width}").ravel(), "right")
    count = high - low
    which = np.repeat(np.arange(len(windows)), count)
    first = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return starts[first + np.arange(len(which))], which


def longest_match(starts: list[int], which: list[int], index: dict) -> int:
    """Words of the longest run that document and some item share, from the windows found (by place)."""
    best, ends, before = 0, {}, None
    by_start = defaultdict(list)
    for p, w in zip(starts, which, strict=True):
        by_start[p].append(w)
    for p in sorted(by_start):
        now = {}
        for w in by_start[p]:
            size = len(index["windows"][w])
            for item, q in index["places"][w]:
                now[item, q] = max(now.get((item, q), 0), size, ends.get((item, q - 1), 0) + 1 if before == p - 1 else 0)
        best = max(best, *now.values())
        ends, before = now, p
    return best


def match_texts(texts: list[str | None], index: dict) -> list[tuple]:
    """A row of MATCHES for each text; the texts are one shard."""
    find = index["vocabulary"].get
    words = BETWEEN.join(utf8(t).translate(FOLD) for t in texts).split()
    ids = np.fromiter((find(w, 0) for w in words), np.int64, len(words))
    marks = np.array([i for i, w in enumerate(words) if w == b"\xff"], np.int64)
    begin = np.concatenate([[0], marks + 1])
    sizes = np.append(marks, len(words)) - begin
    starts, which = search_shard(ids, index)
    order = np.argsort(starts, kind="stable")
    starts, which = starts[order], which[order]
    cut = np.searchsorted(starts, np.append(begin, len(words) + 1))
    rows = []
    for k, (b, n) in enumerate(zip(begin.tolist(), sizes.tolist(), strict=True)):
        at, windows = starts[cut[k] : cut[k + 1]] - b, which[cut[k] : cut[k + 1]]
        if not len(at):
            rows.append((n, 0, 0, [], []))
            continue
        widths = np.array([len(index["windows"][w]) for w in windows])
        mask = covered(n, at, widths).astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]))).tolist()
        found = {item for w in set(windows.tolist()) for item, _ in index["places"][w]}
        longest = longest_match(at.tolist(), windows.tolist(), index)
        spans = [{"start": x, "stop": y} for x, y in zip(edges[::2], edges[1::2], strict=True)]
        rows.append((n, int(mask.sum()), longest, spans, sorted(index["names"][i] for i in found)))
    return rows


def matches_column(text: Column, shared) -> Column:
    """A struct (MATCHES) for each text, against the broadcast index."""

    def matched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in slices([len(t) if isinstance(t, str) else 0 for t in texts], SHARD_BYTES):
            rows += match_texts(texts.iloc[a:b].tolist(), shared.value)
        return pd.DataFrame(rows, columns=MATCHES.names)

    return F.pandas_udf(matched, MATCHES)(text)


def merge_matches(found: Column) -> Column:
    """One struct (MATCHES) from those of several blocks."""

    def merged(parts: pd.Series) -> pd.DataFrame:
        rows = []
        for blocks in parts:
            n = max(x["n_words"] for x in blocks)
            spans = [(s["start"], s["stop"]) for x in blocks for s in x["spans"]]
            mask = covered(n, np.array([a for a, _ in spans], np.int64), np.array([b - a for a, b in spans], np.int64)).astype(np.int8)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]))).tolist()
            joined = [{"start": x, "stop": y} for x, y in zip(edges[::2], edges[1::2], strict=True)]
            rows.append((n, int(mask.sum()), max(x["longest"] for x in blocks), joined, sorted(i for x in blocks for i in x["items"])))
        return pd.DataFrame(rows, columns=MATCHES.names)

    return F.pandas_udf(merged, MATCHES)(found)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of at most ``most`` bytes each, or of one item; an empty block if there are none. The
    driver holds a block and a partition of the benchmark at a time."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").alias("words"))
    now, held = [], 0
    for r in items.toLocalIterator():
        size = len(utf8(r["words"]))
        if now and held + size > most:
            yield now
            now, held = [], 0
        now.append((r["item"], r["words"]))
        held += size
    yield now


def with_matches(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, into: str = "benchmark_matches", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with the struct column ``into`` (MATCHES): words, words hit, longest verbatim match, the spans of
    words that are hit, and the items whose windows occur. A benchmark of several blocks costs a pass each."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{item_text_col}`"))), F.lit(0)).alias("n")).first()["n"]
    if total <= block_bytes:
        return docs.withColumn(into, matches_column(text, spark.sparkContext.broadcast(build_index(next(blocks), window))))
    scratch = Scratch(spark, "matches")
    distinct = docs.select(F.sha2(text, 256).alias("digest"), text.alias("words"))
    parts = []
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(build_index(block, window))
        part = distinct.select("digest", matches_column(F.col("words"), shared).alias("found"))
        if k:  # the first keeps the clean texts' word counts
            part = part.where("found.n_hit > 0")
        parts.append(scratch.keep(part.groupBy("digest").agg(F.any_value("found").alias("found")), f"block{k}"))
        shared.destroy()
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = union.groupBy("digest").agg(F.collect_list("found").alias("blocks")).select(F.col("digest").alias("__digest"), merge_matches(F.col("blocks")).alias("__found"))
    keyed = docs.withColumn("__key", F.sha2(text, 256))
    joined = keyed.join(merged, F.col("__key").eqNullSafe(F.col("__digest")), "left")
    return joined.withColumn(into, F.col("__found")).drop("__key", "__digest", "__found")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **names) -> DataFrame:
    """The rows of docs in which no window of an item occurs; same columns."""
    return with_matches(docs, benchmark, text_col, into="__matches", **names).where("__matches.n_hit = 0").drop("__matches")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def digest_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
