"""Removal of passages that stand in an earlier document too, with a count-min prefilter.

A window is a run of ``window`` words of one document. A word is removed if a window covers it whose words
also stand in a document with a smaller id. Three passes over the texts, which are written once, dealt
into chunks of documents:

1. Every chunk makes a count-min sketch of its windows (rows of counters, kept sparse as sorted cell
   numbers, about two bytes a window and row). The sketches are merged by ranges of cells; a chunk gets
   back those of its cells whose merged count is two or more.
2. Windows whose count is overestimated or exact two in every row are grouped exactly, by 128 bits: a chunk
   sends each once with its place and its least document, and gets back the places of those that an earlier
   document of another chunk has. A window that two documents share is counted twice in each of its cells,
   so none is lost.
3. Every chunk removes what an earlier document has.

A window's key goes from a chunk at most once, so passages that are in a third of all documents load no
task more than others. Nothing reaches the driver but sums. A chunk sends a record to each range of cells, so
chunks and ranges both grow with the square root of the input, up to what a task's memory holds.

Defined results: a null or empty text has no words; a document shorter than a window keeps all; rows of
one id are one document for the order (they do not remove each other's words); rows without an id come
after all others; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.scratch import Scratch, hashes_to
from trailmark.llm.words import MULTIPLIERS, covered, mix, run_hashes, split_words, word_hashes

WINDOW = 13
#: Rows of the sketch, and its counters a row for each window of the input (an estimate, from its bytes).
SKETCH_ROWS, CELLS_PER_WINDOW = 2, 16
BYTES_PER_WORD = 6
#: Bytes of text in a chunk and windows' cells in a range, about: for small inputs, and at most.
CHUNK_BYTES, MOST_CHUNK_BYTES = 4 << 20, 16 << 20
RANGE_CELLS, MOST_RANGE_CELLS = 1 << 20, 4 << 20
#: Bytes of input from which chunks and ranges grow.
GROWS_FROM = 1 << 30
#: Files that the texts are dealt into, at most; each has the same number of chunks, or one less.
MOST_FILES = 20_000
#: Stands for a missing id: after all others.
LAST = np.iinfo(np.int64).max


def pack(values: np.ndarray) -> bytes:
    """Sorted integers as gaps, in the narrowest type that holds them; the first byte tells which."""
    gaps = np.diff(values, prepend=np.zeros(1, values.dtype))
    top = int(gaps.max()) if len(gaps) else 0
    kind = 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([kind]) + gaps.astype(f"<u{kind}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.uint64), dtype=np.uint64)


def by_key(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by (a, b, ids). Few values of a repeat, so only those are sorted by the rest."""
    order = np.argsort(a)
    sorted_a = a[order]
    same = sorted_a[1:] == sorted_a[:-1]
    tied = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(order) else np.zeros(0, bool)
    part = order[tied]
    order[tied] = part[np.lexsort((ids[part], b[part], a[part]))]
    return order


def growing(least: int, most: int, total: int) -> int:
    """least, growing with the square root of the input's bytes up to most."""
    return min(most, int(least * max(1.0, (total / GROWS_FROM) ** 0.5)))


class Chunk:
    """The windows of some documents: ids[i] is the document of window i, keys its 128 bits in two parts.
    Places of windows are the same whenever the chunk is read: rows are ordered by id, and then by text."""

    def __init__(self, pdf: pd.DataFrame, window: int):
        pdf = pdf.sort_values(["id", "words"] if pdf["id"].duplicated().any() else "id", kind="stable", na_position="last")
        self.texts = pdf["words"].tolist()
        self.raw_ids = [None if pd.isna(i) else int(i) for i in pdf["id"]]
        self.doc_ids = np.array([LAST if i is None else i for i in self.raw_ids], np.int64)
        hashed = [word_hashes(split_words(t)) for t in self.texts]
        sizes = np.array([len(h) for h in hashed], np.int64)
        self.counts = np.maximum(0, sizes - window + 1)
        hashes = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        # windows that begin in the last words of a document would reach into the next one
        first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(self.counts) - self.counts), self.counts)
        at = first + np.arange(len(first))
        self.keys = tuple(run_hashes(h, window, m)[at] if len(at) else np.zeros(0, np.uint64) for h, m in zip((hashes, mix(hashes)), MULTIPLIERS, strict=True))
        self.ids = np.repeat(self.doc_ids, self.counts)
        self.order = by_key(*self.keys, self.ids)
        a, b = (k[self.order] for k in self.keys)
        self.new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        self.begin = np.flatnonzero(self.new)

    def firsts(self) -> np.ndarray:
        """A window of each key, in the key's least document."""
        return self.order[self.begin]


def cells(keys: tuple[np.ndarray, np.ndarray], row: int, bits: int) -> np.ndarray:
    """The counter of each window in a row of the sketch of 2 ** bits counters."""
    return mix(keys[0] + keys[1] * np.uint64(2 * row + 1)) >> np.uint64(64 - bits)


def sketch(chunk: Chunk, bits: int, range_bits: int) -> Iterable[tuple[int, bytes]]:
    """(range, cells) of the chunk's sketch: a cell for each window and document of it that holds it."""
    ids = chunk.ids[chunk.order]
    new = chunk.order[chunk.new | np.concatenate([[True], ids[1:] != ids[:-1]])] if len(ids) else chunk.order
    a, b = (k[new] for k in chunk.keys)
    for row in range(SKETCH_ROWS):
        at = np.sort(cells((a, b), row, bits))
        ranges = at >> np.uint64(bits - range_bits)
        edges = np.flatnonzero(np.diff(ranges)) + 1
        for part in np.split(at, edges) if len(at) else []:
            k = int(part[0] >> np.uint64(bits - range_bits))
            yield (row << range_bits) + k, pack(part - (np.uint64(k) << np.uint64(bits - range_bits)))


def repeated_cells(parts: list[bytes]) -> list[bytes | None]:
    """Of each sketch, its cells whose count in all of them together is two or more."""
    lists = [unpack(p) for p in parts]
    found, count = np.unique(np.concatenate(lists), return_counts=True)
    found = found[count > 1]
    out: list[bytes | None] = []
    for x in lists:
        x = np.unique(x)
        x = x[found[np.minimum(np.searchsorted(found, x), len(found) - 1)] == x] if len(found) else x[:0]
        out.append(pack(x) if len(x) else None)
    return out


def candidates(chunk: Chunk, hot: list[np.ndarray], bits: int) -> np.ndarray:
    """Places of the chunk's windows whose cells are all in hot, one of each key, in order."""
    at = chunk.firsts()
    for row, have in enumerate(hot):
        if not len(have):
            at = at[:0]
        else:
            c = cells((chunk.keys[0][at], chunk.keys[1][at]), row, bits)
            place = np.minimum(np.searchsorted(have, c), len(have) - 1)
            at = at[have[place] == c]
    return np.sort(at)


def group_exactly(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of each chunk's windows (a, b, document), a mask of those that an earlier document of another chunk has."""
    a, b, d = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = by_key(a, b, d)
    a, b = a[order], b[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    least = d[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    later = np.empty(len(d), bool)
    later[order] = least < d[order]
    return np.split(later, np.cumsum([len(x[0]) for x in parts])[:-1])


def repeated(chunk: Chunk, elsewhere: np.ndarray) -> np.ndarray:
    """Mask of the windows that an earlier document has, of the chunk or elsewhere. elsewhere: places of
    windows (of firsts()) that an earlier document of another chunk has."""
    found = np.zeros(len(chunk.order), bool)
    found[elsewhere] = True
    at = chunk.firsts()
    size = np.diff(np.append(chunk.begin, len(chunk.order)))
    out = np.empty(len(chunk.order), bool)
    out[chunk.order] = np.repeat(found[at], size) | (chunk.ids[chunk.order] > np.repeat(chunk.ids[at], size))
    return out


def kept_words(chunk: Chunk, gone: np.ndarray, window: int) -> list[tuple]:
    """(id, words, words removed, what is left) of each document."""
    ends = np.cumsum(chunk.counts)
    rows = []
    for i, text in enumerate(chunk.texts):
        words = split_words(text)
        at = slice(ends[i] - chunk.counts[i], ends[i])
        hit = np.flatnonzero(gone[at])
        left = words
        if len(hit):
            mask = covered(len(words), hit, window).tolist()
            left = [w for w, g in zip(words, mask, strict=True) if not g]
        rows.append((chunk.raw_ids[i], len(words), len(words) - len(left), b" ".join(left)))
    return rows


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True, chunk_bytes: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]): each document without the passages that an earlier one
    has, its words joined by one space. Runs at once; the result is a written table."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("words"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"]
    chunk_bytes = chunk_bytes or growing(CHUNK_BYTES, MOST_CHUNK_BYTES, total)
    n_chunks = max(1, -(-total // chunk_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(10, int(np.ceil(np.log2(max(1, total / BYTES_PER_WORD * CELLS_PER_WINDOW)))))
    range_bits = int(np.ceil(np.log2(max(8, total // BYTES_PER_WORD // growing(RANGE_CELLS, MOST_RANGE_CELLS, total)))))
    number = F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("words"))), F.lit(n_chunks))
    base = scratch.keep_bucketed(rows.withColumn("chunk", hashes_to(number)), "base", "chunk", min(n_chunks, MOST_FILES))
    scratch.release()

    def sketched(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], k, data) for k, data in sketch(Chunk(pdf, window), bits, range_bits)], columns=["chunk", "range", "cells"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(cells=repeated_cells(pdf["cells"].tolist()))
        return pdf[pdf["cells"].notna()]

    cell_rows = "chunk int, range long, cells binary"
    sketches = base.groupBy("chunk").applyInPandas(sketched, cell_rows)
    hot = scratch.keep(sketches.groupBy("range").applyInPandas(merged, cell_rows), "hot")
    scratch.release()
    bucket_bits = max(3, range_bits - 2)

    def proposed(key: tuple, pdf: pd.DataFrame, cell_pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(cell_pdf):
            have = [[] for _ in range(SKETCH_ROWS)]
            for k, data in zip(cell_pdf["range"], cell_pdf["cells"], strict=True):
                offset = np.uint64(k & ((1 << range_bits) - 1)) << np.uint64(bits - range_bits)
                have[k >> range_bits].append(unpack(data) + offset)
            have = [np.sort(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in have]
            chunk = Chunk(pdf, window)
            at = candidates(chunk, have, bits)
            bucket = (chunk.keys[1][at] >> np.uint64(64 - bucket_bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                # places rise, and so do documents
                own = at[part]
                ids, runs = np.unique(chunk.ids[own], return_counts=True)
                out.append((key[0], bucket[part[0]], pack(own.astype(np.uint64)), chunk.keys[0][own].tobytes() + chunk.keys[1][own].tobytes(), ids.tobytes(), runs.astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["chunk", "bucket", "at", "keys", "ids", "runs"])

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for keys, ids, runs in zip(pdf["keys"], pdf["ids"], pdf["runs"], strict=True):
            a, b = np.frombuffer(keys, np.uint64).reshape(2, -1)
            parts.append((a, b, np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(runs, "<u4"))))
        masks = group_exactly(parts)
        out = [(c, pack(unpack(at)[mask])) for c, at, mask in zip(pdf["chunk"], pdf["at"], masks, strict=True) if mask.any()]
        return pd.DataFrame(out, columns=["chunk", "at"])

    proposals = base.groupBy("chunk").cogroup(hot.groupBy("chunk")).applyInPandas(proposed, "chunk int, bucket long, at binary, keys binary, ids binary, runs binary")
    found = scratch.keep(proposals.groupBy("bucket").applyInPandas(grouped, "chunk int, at binary"), "found")
    scratch.drop("hot")
    scratch.release()

    def removed(key: tuple, pdf: pd.DataFrame, found_pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(pdf, window)
        elsewhere = np.concatenate([np.zeros(0, np.uint64), *map(unpack, found_pdf["at"])]).astype(np.int64)
        out = pd.DataFrame(kept_words(chunk, repeated(chunk, elsewhere), window), columns=["id", "n_words", "n_removed", "kept"])
        out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in out["kept"]]
        out["kept"] = [x.decode("utf-8", "replace") for x in out["kept"]] if with_text else None
        return out.astype({"id": "Int64"})[["id", "n_words", "n_removed", "kept_sha256", "kept"]]

    schema = "id long, n_words long, n_removed long, kept_sha256 string, kept string"
    result = base.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(removed, schema)
    result = Scratch(spark, "substrings_result").keep(result if with_text else result.drop("kept"), "rows")
    scratch.drop()
    return result
