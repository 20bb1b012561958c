"""Tokenised sequences written to binary shards in training order.

Texts are tokenised and cut into sequences of ``length`` tokens. Sequences are numbered from 0 to N - 1,
and a keyed Feistel permutation with cycle-walking gives each number its slot in the training order, with no
table of the permutation anywhere. Slots are dealt out by range: shard k holds the slots from
k * per_shard on, in order, as records of one fixed size. So slot s is in shard s // per_shard at byte
(s % per_shard) * stride, and a training run resumes at any slot by arithmetic.

A record: document id (8 bytes), number of the sequence in its document (4), tokens used (2), ``length``
tokens (2 each, zeros after those used), and a line feed; integers are little-endian.

Defined results: null and empty texts have no tokens and so no sequence; a missing id is written as -1;
repeated rows are written as often as they come; an empty table gives no shard.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.scratch import Scratch
from trailmark.llm.words import mix, slices

#: Splits a text into the pieces that byte-pair merges stay within; belongs to the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_OF_TEXT = 50256
HEADER, HEADER_BYTES = "<qiH", 14
ROUNDS = 6
#: Characters or bytes of a batch that are in work at a time.
BLOCK_CHARS = 2 << 20


@dataclass(frozen=True)
class Layout:
    length: int = 256
    per_shard: int = 16384
    key: int = 0x5EED

    @property
    def stride(self) -> int:
        return HEADER_BYTES + 2 * self.length + 1


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def half_bits(n: int) -> int:
    """Bits of each half of the smallest Feistel domain that holds n numbers."""
    return max(1, -(-(max(n - 1, 1)).bit_length() // 2))


def feistel(x: np.ndarray, bits: int, key: int, backward: bool = False) -> np.ndarray:
    """A permutation of the numbers below 4 ** bits."""
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    for k in keys[::-1] if backward else keys:
        if backward:
            left, right = right ^ (mix(left + k) & mask), left
        else:
            left, right = right, left ^ (mix(right + k) & mask)
    return (left << shift) | right


def permute(x: np.ndarray, n: int, key: int, backward: bool = False) -> np.ndarray:
    """Slots of the numbers x below n (or, backward, the numbers of slots): cycle-walks back below n."""
    bits = half_bits(n)
    out = feistel(x.astype(np.uint64), bits, key, backward)
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = feistel(out[far], bits, key, backward)
    return out.astype(np.int64)


def tokenised(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(id, tokens): the tokens of each text that has any, and the end-of-text token, as 16-bit integers."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for pdf in batches:
            for a, b in slices([len(t) if t else 0 for t in pdf["words"]], BLOCK_CHARS):
                part = pdf.iloc[a:b]
                rows = [(-1 if pd.isna(i) else int(i), np.array([*encode(t), END_OF_TEXT], "<u2").tobytes()) for i, t in zip(part["id"], part["words"], strict=True) if t]
                yield pd.DataFrame(rows, columns=["id", "tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("words"))
    return rows.mapInPandas(tokens, "id long, tokens binary")


def write_training_order(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", layout: Layout | None = None, vocabulary: str = VOCABULARY) -> int:
    """Write the shards below path; returns the number of sequences. The only things that reach the driver
    are counts of sequences, one for each partition of docs."""
    layout = layout or Layout()
    size = 2 * layout.length
    tokens = tokenised(docs, id_col, text_col, vocabulary).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        per_part = tokens.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.ceil(F.octet_length("tokens") / size)).alias("n")).collect()
        counts = {r["part"]: r["n"] for r in per_part}
        total, first = 0, {}
        for part in sorted(counts):
            first[part] = total
            total += counts[part]
        if not total:
            return 0

        def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = TaskContext.get().partitionId()
            number = first.get(part, 0)
            for pdf in batches:
                for a, b in slices(pdf["tokens"].map(len).tolist(), BLOCK_CHARS):
                    rows = []
                    for i, data in zip(pdf["id"].iloc[a:b], pdf["tokens"].iloc[a:b], strict=True):
                        for k, at in enumerate(range(0, len(data), size)):
                            piece = data[at : at + size]
                            rows.append(struct.pack(HEADER, i, k, len(piece) // 2) + piece.ljust(size, b"\0"))
                    slots = permute(np.arange(number, number + len(rows)), total, layout.key)
                    number += len(rows)
                    yield pd.DataFrame({"shard": slots // layout.per_shard, "slot": slots, "record": rows})
            if number != first.get(part, 0) + counts.get(part, 0):
                raise RuntimeError(f"partition {part} has other rows than when it was counted")

        numbered = tokens.mapInPandas(records, "shard long, slot long, record binary")
        shards = -(-total // layout.per_shard)
        (
            numbered.repartitionById(shards, F.col("shard").cast("int"))
            .sortWithinPartitions("shard", "slot")
            .select("shard", F.col("record").cast("string").alias("record"))
            .write.partitionBy("shard")
            .option("lineSep", "\n")
            .text(path)
        )
        return total
    finally:
        tokens.unpersist()


def read_training_order(spark: SparkSession, path: str, layout: Layout | None = None, start: int = 0, stop: int | None = None) -> DataFrame:
    """(slot, shard, id, seq_no, n_tokens, tokens) of the slots from start to before stop. Only shards that
    hold such slots are read."""
    layout = layout or Layout()
    stop = 2**62 if stop is None else stop

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, data in zip(pdf["shard"], pdf["content"], strict=True):
                if len(data) % layout.stride:
                    raise ValueError(f"shard {shard} ends inside a record")
                rows = []
                for k in range(len(data) // layout.stride):
                    slot = shard * layout.per_shard + k
                    if start <= slot < stop:
                        at = k * layout.stride
                        i, seq, n = struct.unpack_from(HEADER, data, at)
                        body = data[at + HEADER_BYTES : at + HEADER_BYTES + 2 * n]
                        rows.append((slot, shard, i, seq, n, body))
                yield pd.DataFrame(rows, columns=["slot", "shard", "id", "seq_no", "n_tokens", "tokens"])

    files = spark.read.format("binaryFile").option("basePath", path).load(f"{path}/shard=*")
    files = files.where(F.col("shard").between(start // layout.per_shard, (stop - 1) // layout.per_shard)).select(F.col("shard").cast("long").alias("shard"), "content")
    return files.mapInPandas(cut, "slot long, shard long, id long, seq_no int, n_tokens int, tokens binary")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: Layout | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes docs in training order to the shared folder and reads the shards back: a row for each sequence."""
    spark = docs.sparkSession
    path = Scratch(spark, "training_order").path("shards")
    if not write_training_order(docs, path, id_col, text_col, layout, vocabulary):
        return spark.createDataFrame([], "slot long, shard long, id long, seq_no int, n_tokens int, tokens binary")
    return read_training_order(spark, path, layout)


def digest(tokens: bytes) -> str:
    return hashlib.sha256(tokens).hexdigest()
