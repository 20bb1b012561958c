"""Language identification of texts that mix languages.

A model of character trigrams is counted on a bounded sample of labelled texts. A text's words are scored
once each; the scripts of a word's letters narrow its candidate languages to those whose sample uses the
script; Viterbi over the words with a switching penalty labels spans of one language. The text's language
is the one with most letters, its score that language's share of them.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the language
first in alphabetical order; repeated texts get equal labels; an empty table stays empty. Without any
labelled text every text is ``und``. Numerals (such as a half, or Roman ones of one character) are no letters.
More labels than MOST_LANGUAGES are refused, not cut.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.scratch import Scratch
from trailmark.llm.words import slices

#: Letters' ranges of the scripts that are told apart; other letters are of script "other".
SCRIPTS = (
    ("latin", "A-Za-zªºÀ-ɏḀ-ỿⱠ-Ɀ꜠-ꟿ"),
    ("greek", "Ͱ-Ͽἀ-῿"),
    ("cyrillic", "Ѐ-ԯᲀ-᲏ⷠ-ⷿꙀ-ꚟ"),
    ("armenian", "԰-֏"),
    ("hebrew", "֐-׿"),
    ("arabic", "؀-ۿݐ-ݿࢠ-ࣿ"),
    ("devanagari", "ऀ-ॿ"),
    ("bengali", "ঀ-৿"),
    ("tamil", "஀-௿"),
    ("thai", "฀-๿"),
    ("georgian", "Ⴀ-ჿ"),
    ("ethiopic", "ሀ-፿"),
    ("khmer", "ក-៿"),
    ("kana", "぀-ヿㇰ-ㇿ"),
    ("han", "㐀-䶿一-鿿豈-﫿\U00020000-\U0002ffff"),
    ("hangul", "ᄀ-ᇿ㄰-㆏가-힯"),
)
#: Labelled texts that a language is learned from, about, and languages: these bound the model.
SAMPLE_TEXTS, MOST_LANGUAGES = 1500, 4096
#: Cost of changing language between two words, in nats.
SWITCH = 6.0
#: Share of a language's letters that a script needs to be one of the language's.
SCRIPT_SHARE = 0.01
#: Words whose scores a worker keeps, characters of text in work at a time, and cells up to which a worker
#: holds the model as a full table of trigrams and languages.
CACHED_WORDS, BLOCK_CHARS, TABLE_CELLS = 200_000, 1 << 20, 1 << 22
LABEL = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("lang", T.StringType())]))),
])


def numerals() -> str:
    """A class of the characters that \\w matches but that are neither letters nor decimal digits."""
    found = [k for k in range(0x110000) if (c := chr(k)).isalnum() and not c.isalpha() and not c.isdecimal()]
    cuts = [k for k, x in enumerate(found) if not k or found[k - 1] != x - 1] + [len(found)]
    return "".join(f"{chr(found[a])}-{chr(found[b - 1])}" for a, b in zip(cuts, cuts[1:], strict=False))


#: Letters; the combining marks of several scripts may follow the first.
LETTER = r"\W\d_" + numerals()
MARKS = r"[\u0300-\u036f\u0483-\u0489\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]"
#: Plain letters are tried first, as they are the quickest to tell.
WORD = re.compile(rf"(?:[A-Za-z]++|[^{LETTER}])++(?:{MARKS}++[^{LETTER}]*+)*+")


def script_of(letter: str) -> str:
    for name, pattern in COMPILED:
        if pattern.match(letter):
            return name
    return "other"


COMPILED = [(name, regex.compile(f"[{chars}]")) for name, chars in SCRIPTS]


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def count_grams(texts: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, kind, key, n): trigrams of words, and letters by script."""

    def counted(batches):
        for pdf in batches:
            for language, part in pdf.groupby("lang"):
                words = Counter(w for t in part["words"] for w in WORD.findall(t.lower()))
                found, scripts = Counter(), Counter()
                for w, n in words.items():
                    for g in grams(w):
                        found[g] += n
                    scripts[script_of(w[0])] += n * len(w)
                rows = [(language, kind, k, n) for kind, c in (("gram", found), ("script", scripts)) for k, n in c.items()]
                yield pd.DataFrame(rows, columns=["lang", "kind", "key", "n"])

    rows = texts.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("words")).where("lang IS NOT NULL AND words IS NOT NULL")
    return rows.mapInPandas(counted, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def sample_labelled(docs: DataFrame, id_col: str, lang_col: str, per_lang: int = SAMPLE_TEXTS) -> DataFrame:
    """About per_lang rows of each language, chosen by a hash of the id."""
    lang, key = F.col(f"`{lang_col}`"), F.col(f"`{id_col}`")
    counts = docs.where(lang.isNotNull()).groupBy(lang.alias("__lang")).agg(F.count("*").alias("__n"))
    found = counts.count()
    if found > MOST_LANGUAGES:
        raise ValueError(f"{found} labels, of which at most {MOST_LANGUAGES} can be learned")
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("__n")) * (1 << 20)
    # one row for each of at most MOST_LANGUAGES labels
    joined = docs.join(F.broadcast(counts), lang == F.col("__lang"))
    return joined.where(F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 20)) < share).drop("__lang", "__n")


def gram_number(gram: str) -> int:
    return (ord(gram[0]) << 42) | (ord(gram[1]) << 21) | ord(gram[2])


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict:
    """The model, bounded by the labelled texts: of each trigram the languages that have it, and how far their
    log likelihoods are above what each has for trigrams that it has not."""
    scratch = Scratch(labelled.sparkSession, "languages")
    rows = [tuple(r) for r in scratch.keep(count_grams(labelled, lang_col, text_col), "counts").collect()]
    scratch.drop()
    langs = sorted({lang for lang, kind, _, _ in rows if kind == "gram"})
    number = {lang: k for k, lang in enumerate(langs)}
    grams = sorted((gram_number(key), number[lang], n) for lang, kind, key, n in rows if kind == "gram")
    keys, lang, n = (np.array(x, t) for x, t in zip(zip(*grams, strict=True) if grams else ((), (), ()), (np.uint64, np.int64, float), strict=True))
    kinds = np.bincount(lang, minlength=len(langs))
    spread = float(kinds.max() if len(langs) else 1) * 2
    size = np.bincount(lang, n, len(langs)) + 0.5 * spread
    unseen = np.log(0.5 / size)
    distinct, starts = np.unique(keys, return_index=True)
    letters = Counter()
    for name, kind, _, count in rows:
        letters[name] += count * (kind == "script")
    allowed: dict[str, list[int]] = {}
    for name, kind, script, count in sorted(rows):
        if kind == "script" and name in number and count >= SCRIPT_SHARE * letters[name]:
            allowed.setdefault(script, []).append(number[name])
    return {"langs": langs, "keys": distinct, "starts": np.append(starts, len(keys)), "lang": lang, "gain": np.log((n + 0.5) / size[lang]) - unseen[lang] if len(n) else n, "unseen": unseen, "allowed": allowed}


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word; scores has the words of all texts in order, lengths the words of each
    text. All texts advance together, the long ones alone at the end."""
    total, n_langs = scores.shape
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    back = np.zeros((total, n_langs), np.int32)
    state = np.zeros((len(sizes), n_langs))
    last = np.zeros(len(sizes), np.int64)
    live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    own = np.arange(n_langs, dtype=np.int32)
    for t, n in enumerate(live.tolist()):
        at = begin[:n] + t
        if t:
            top = state[:n].argmax(1)
            best = state[np.arange(n), top] - switch
            stay = state[:n] >= best[:, None]
            back[at] = np.where(stay, own, top[:, None])
            state[:n] = np.where(stay, state[:n], best[:, None])
        state[:n] += scores[at]
    out = np.zeros(total, np.int32)
    last = state.argmax(1) if len(sizes) else last
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        if t + 1 < len(live):
            m = live[t + 1]
            last[:m] = back[begin[:m] + t + 1, last[:m]]
        out[at] = last[:n]
    return out


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the trigrams of the words in order, and where each word's begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(len(words)), sizes)
    return (points[at] << np.uint64(42)) | (points[at + 1] << np.uint64(21)) | points[at + 2], begin


class ScoredWords:
    """Log likelihoods of lower-case words in each language, those of other scripts far below the rest. Keeps
    the words seen before, and forgets all of them once it holds CACHED_WORDS."""

    def __init__(self, model: dict):
        self.model, self.number, self.script = model, {}, {}
        self.scores = np.zeros((0, len(model["langs"])))
        self.table = None
        if (len(model["keys"]) + 1) * len(model["langs"]) <= TABLE_CELLS:
            self.table = np.zeros((len(model["keys"]) + 1, len(model["langs"])))
            self.table[np.repeat(np.arange(len(model["keys"])), np.diff(model["starts"])), model["lang"]] = model["gain"]

    def penalty(self, letter: str) -> np.ndarray:
        """What the languages that do not use the letter's script lose."""
        if letter not in self.script:
            fits = self.model["allowed"].get(script_of(letter))
            self.script[letter] = np.array([0.0 if not fits or k in fits else -1000.0 for k in range(self.scores.shape[1])])
        return self.script[letter]

    def fresh(self, words: list[str]) -> np.ndarray:
        model, n = self.model, self.scores.shape[1]
        keys, begin = gram_keys(words)
        sizes = np.diff(np.append(begin, len(keys)))
        place = np.minimum(np.searchsorted(model["keys"], keys), max(0, len(model["keys"]) - 1))
        found = model["keys"][place] == keys if len(model["keys"]) else np.zeros(len(keys), bool)
        other = sizes[:, None] * model["unseen"] + np.array([self.penalty(w[0]) for w in words])
        if self.table is not None:
            place[~found] = len(self.table) - 1
            return np.add.reduceat(self.table[place], begin) + other
        known = np.flatnonzero(found)
        first, count = model["starts"][place[known]], np.diff(model["starts"])[place[known]]
        entry = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        word = np.repeat(np.repeat(np.arange(len(words)), sizes)[known], count)
        gain = np.bincount(word * n + model["lang"][entry], model["gain"][entry], len(words) * n).reshape(-1, n)
        return gain + other

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.number) > CACHED_WORDS:
            self.number, self.scores = {}, self.scores[:0]
        number, have = self.number, len(self.number)
        ids = [number.setdefault(w, len(number)) for w in words]
        if len(number) > have:
            self.scores = np.concatenate([self.scores, self.fresh(list(number)[have:])])
        return self.scores[ids]


def best_labels(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """viterbi(), which only sees texts that may change language: in the others no stretch of words gains
    more than one switch costs over the language that is best for the whole text."""
    if scores.shape[1] < 2 or not len(scores):
        return np.zeros(len(scores), np.int32)
    begin = np.cumsum(lengths) - lengths
    full = lengths > 0
    main = np.zeros(len(lengths), np.int64)
    main[full] = np.add.reduceat(scores, begin[full]).argmax(1)
    own = np.repeat(main, lengths)
    others = scores.copy()
    others[np.arange(len(own)), own] = -np.inf
    gain = others.max(1) - scores[np.arange(len(own)), own]
    out = own.astype(np.int32)
    mixed = []
    for k, (a, n) in enumerate(zip(begin.tolist(), lengths.tolist(), strict=True)):
        if n:
            total = np.concatenate([[0.0], np.cumsum(gain[a : a + n])])
            if (total - np.minimum.accumulate(total)).max() > switch:
                mixed.append(k)
    if mixed:
        at = np.concatenate([np.arange(begin[k], begin[k] + lengths[k]) for k in mixed])
        out[at] = viterbi(scores[at], lengths[mixed], switch)
    return out


def label_texts(texts: list[str | None], scored: ScoredWords, switch: float = SWITCH) -> list[tuple]:
    """A row of LABEL for each text."""
    langs = scored.model["langs"]
    found = [WORD.findall(t) if isinstance(t, str) and langs else [] for t in texts]
    words = [w for ws in found for w in ws]
    if not words:
        return [("und", 0.0, [])] * len(texts)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    best = best_labels(scored.of(" ".join(words).lower().split(" ")), np.array([len(x) for x in found]), switch)
    out, at = [], 0
    for text, own in zip(texts, found, strict=True):
        if not own:
            out.append(("und", 0.0, []))
            continue
        labels, size = best[at : at + len(own)], sizes[at : at + len(own)]
        at += len(own)
        letters = np.bincount(labels, weights=size, minlength=len(langs))
        top = int(letters.argmax())
        edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        if len(edges) == 2:
            first, last = text.find(own[0]), text.rfind(own[-1]) + len(own[-1])
            runs = [{"start": first, "stop": last, "lang": langs[labels[0]]}]
        else:
            spans = [m.span() for m in WORD.finditer(text)]
            runs = [{"start": spans[x][0], "stop": spans[y - 1][1], "lang": langs[labels[x]]} for x, y in zip(edges, edges[1:], strict=False)]
        out.append((langs[top], float(letters[top] / letters.sum()), runs))
    return out


def language(text: Column, shared, switch: float = SWITCH) -> Column:
    """A struct (LABEL) for each text, by the broadcast model."""

    def labelled(parts):
        scored = ScoredWords(shared.value)
        for texts in parts:
            out = []
            for a, b in slices([len(t) if isinstance(t, str) else 0 for t in texts], BLOCK_CHARS):
                out += label_texts(texts.iloc[a:b].tolist(), scored, switch)
            yield pd.DataFrame(out, columns=LABEL.names)

    labelled.__annotations__ = {"parts": "Iterator[pd.Series]", "return": "Iterator[pd.DataFrame]"}
    return F.pandas_udf(labelled, LABEL, 204)(text)


def with_language(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", into: str = "language") -> DataFrame:
    """docs with the struct column ``into``, by a model of a bounded sample of the labelled rows."""
    model = train(sample_labelled(labelled, id_col, lang_col), lang_col, text_col)
    return docs.withColumn(into, language(F.col(f"`{text_col}`"), docs.sparkSession.sparkContext.broadcast(model)))
