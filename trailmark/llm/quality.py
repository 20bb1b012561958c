"""Quality rules on repetition inside a text, found with suffix arrays of its words.

Every text's words get a suffix array and the longest common prefixes (LCP) of its neighbours. An LCP
interval of at least ``window`` words whose occurrences do not all have the same word before them is a maximal
repeated run: no longer one has the same occurrences. Each suffix begins with the run of the deepest interval
that holds it; the union of these runs is the covered part of the text, that of all occurrences of all maximal
runs. A text fails if that part, or the longest repeat, is too large.

Defined results: null and texts without words have zero words and fail for being short; repeated rows
are judged alike; an empty table gives an empty table; other columns of the input pass through.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.words import covered, slices, split_words, utf8


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    window: int = 8
    #: Per cent of the words that may lie in repeated runs of ``window`` words.
    max_repeat_percent: int = 30
    #: Per cent of the words that one repeated run may have, once it has ``long_repeat`` words.
    max_longest_percent: int = 20
    long_repeat: int = 40


#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
VERDICT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "longest_repeat")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
)
#: UTF-8 bytes that begin no code point.
CONTINUATION = bytes(range(0x80, 0xC0))
#: Bytes of text that are in work at a time.
BLOCK_BYTES = 1 << 20


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ids in order, by prefix doubling."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < n and rank.max() < n:
        key = rank * (n + 2)
        key[: n - step] += rank[step:]
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
    return order


def neighbour_lcp(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Entry i: words that the suffixes order[i - 1] and order[i] share at their start; 0 at first."""
    n = len(ids)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = [0] * n
    words, before, place = ids.tolist(), before.tolist(), place.tolist()
    shared = 0
    for i in range(n):
        j = before[i]
        if j < 0:
            shared = 0
            continue
        limit = n - max(i, j)
        while shared < limit and words[i + shared] == words[j + shared]:
            shared += 1
        out[place[i]] = shared
        shared = max(shared - 1, 0)
    return np.array(out, np.int64)


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Intervals (length, first, last) of suffix array places whose suffixes share length words, at least
    ``least``, and no wider interval shares as many: the repeated runs that no word more on the right has."""
    found, stack = [], []
    for i, shared in enumerate([*lcp.tolist(), 0]):
        left = i - 1
        while stack and stack[-1][0] > shared:
            length, left = stack.pop()
            if length >= least:
                found.append((length, left, i - 1))
        if i and (not stack or stack[-1][0] < shared):
            stack.append((shared, left))
    return found


def maximal_runs(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The LCP intervals whose suffixes do not all have the same word before them."""
    before = np.concatenate([[-1], ids[:-1]])[order]
    changes = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
    return [x for x in lcp_intervals(lcp, least) if changes[x[2]] > changes[x[1]]]


def repeats(ids: np.ndarray, least: int) -> tuple[np.ndarray, int, int]:
    """Mask of the words in runs of at least ``least`` words that occur again; how many maximal runs there
    are; the longest one's words."""
    order = suffix_array(ids)
    lcp = neighbour_lcp(ids, order)
    found = maximal_runs(ids, order, lcp, least)
    # the length of the deepest interval that holds a suffix is what it shares with a neighbour
    deepest = np.maximum(lcp, np.append(lcp[1:], 0))
    hit = deepest >= least
    return covered(len(ids), order[hit], deepest[hit]), len(found), max((x[0] for x in found), default=0)


def has_repeats(words: list[list[bytes]], window: int) -> list[bool]:
    """For each text whether some run of ``window`` words may occur twice in it; false only if none does."""
    sizes = np.array([len(w) for w in words], np.int64)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for text in words for w in text), np.int64, int(sizes.sum()))
    n = len(ids) - window + 1
    out = np.zeros(len(words), bool)
    if n <= 0:
        return out.tolist()
    text_of = np.repeat(np.arange(len(words)), sizes)
    key = np.zeros(n, np.uint64)
    for j in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    key = key * np.uint64(0x9E3779B97F4A7C15) + text_of[:n].astype(np.uint64)
    inside = text_of[:n] == text_of[window - 1 :]
    key, text_of = key[inside], text_of[:n][inside]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    out[text_of[order[same]]] = True
    return out.tolist()


def judge(text: str | None, words: list[bytes], look: bool, rules: QualityRules) -> tuple:
    """One row of VERDICT. look: search for repeats; without it there are none."""
    raw = utf8(text)
    n = len(words)
    n_repeat_words = n_repeats = longest = 0
    if look:
        seen: dict[bytes, int] = {}
        mask, n_repeats, longest = repeats(np.array([seen.setdefault(w, len(seen)) for w in words], np.int64), rules.window)
        n_repeat_words = int(mask.sum())
    lines = Counter(line for line in raw.split(b"\n") if not line.isspace() and line)
    base_failed = n < rules.min_words or 100 * n_repeat_words > rules.max_repeat_percent * n
    too_long = longest >= rules.long_repeat and 100 * longest > rules.max_longest_percent * n
    joined = b"".join(words)
    return (
        n,
        len(joined.translate(None, CONTINUATION)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        sum(lines.values()) - len(lines),
        n_repeat_words,
        n_repeats,
        longest,
        base_failed,
        not base_failed and not too_long,
    )


def quality_verdict(text: Column, rules: QualityRules | None = None) -> Column:
    """A struct (VERDICT) for each text."""
    rules = rules or QualityRules()

    def verdicts(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in slices([len(t) if isinstance(t, str) else 0 for t in texts], BLOCK_BYTES):
            part = texts.iloc[a:b].tolist()
            words = [split_words(t) for t in part]
            rows += [judge(*x, rules) for x in zip(part, words, has_repeats(words, rules.window), strict=True)]
        return pd.DataFrame(rows, columns=VERDICT.names)

    return F.pandas_udf(verdicts, VERDICT)(text)


def with_quality(docs: DataFrame, text_col: str = "text", rules: QualityRules | None = None, into: str = "quality_verdict") -> DataFrame:
    """docs with the struct column ``into``; a column of that name is replaced."""
    return docs.withColumn(into, quality_verdict(F.col(f"`{text_col}`"), rules))


def keep_good(docs: DataFrame, text_col: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """The rows of docs whose text passes; same columns."""
    return docs.where(quality_verdict(F.col(f"`{text_col}`"), rules)["kept"])
