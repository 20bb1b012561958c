"""Mixing of domains to target weights with soft membership.

A labelled table says of some documents which domain they are of. A naive Bayes classifier over binned
features of the text gives every document its domain posteriors p. Nonnegative rates r then are fitted by
projected-gradient least squares, so that the expected tokens of each domain, the sum of r * tokens * p,
match the targets:

    minimise sum over domains of (S_d(r) - T_d)^2,  0 <= r <= max_rate.

A step moves r by p times the residuals and projects onto the bounds. Of a plain gradient step and shorter
and longer ones that the domains' token-weighted Gram matrix preconditions, the best is taken, so the fit
never gets worse. A pass is two aggregations of a narrow table, to a few sums for each pair of domains. Rates are a nested column expression of the passes' residuals, so nothing is stored
between passes and a lost executor costs a rescan of its part.

All of it is DataFrame functions. The classifier is fitted on at most FIT_ROWS labelled documents; words of
the toxic class are found in each language by itself and in all together; token counts and rates are over
all documents. Targets that the bounds or the documents do not allow are not met: how far the delivered copies
miss them is logged, is in the result, and is refused beyond a bound if one is given.

Defined results: a null text has no tokens and rate 0; labels of no known document are ignored, and so are
contradicting ones (most severe wins); documents need no labels; without any labelled document all
posteriors are equal; an empty table gives an empty one. Rows of one id are rated each by itself, and equal
rows alike.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.scratch import Scratch

LOG = logging.getLogger(__name__)
#: Labelled documents that the classifier is fitted on, at most.
FIT_ROWS = 20_000
#: A lexicon word stands in so many different labelled texts of its scope, and so many times as often in the
#: marked ones; that chance would give any word of the scope so many hits has at most this probability.
LEAST_SUPPORT, LEAST_LIFT, CHANCE = 4, 10.0, 0.05
#: Words that a language has anyway are in more than this share of the unmarked documents.
COMMON_SHARE = 0.05
SYMBOLS = "#*$%&|<>!"
#: The column of documents whose values have lexicons of their own.
LANGUAGE = "lang"


@dataclass(frozen=True)
class Targets:
    weights: Mapping[str, float] = field(default_factory=lambda: {"good": 0.95, "poor": 0.05, "toxic": 0.0})
    #: The domain whose expected tokens stay as they are; it sets the token budget.
    anchor: str = "good"
    max_rate: float = 4.0
    passes: int = 10
    #: Rates so near to 1 are 1, so documents are not lost or repeated for a nearly even rate. The fit's report
    #: is of the rates after that.
    steady: float = 0.05
    #: Relative miss of all targets that is refused with an error; none is if it is null.
    most_miss: float | None = None
    #: Relative miss of all targets at which the passes end.
    tolerance: float = 1e-4


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def word_array(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def bins(value: Column, edges: Sequence[float]) -> Column:
    """The number of edges that value is not below."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")


def marked_words(words: Column, language: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """How many different words are in the lexicon of all languages or of the text's own."""
    every = lexicon.get("", [])
    found = lambda listed: F.filter(words, lambda w: w.isin(list(listed)))
    out = found(every) if every else F.slice(words, 1, 0)
    for scope, listed in lexicon.items():
        if scope:
            out = F.when(language == scope, found({*every, *listed})).otherwise(out)
    return F.size(F.array_distinct(out))


def features(text: Column, words: Column, marked: Column) -> dict[str, Column]:
    """Binned features of a text."""
    size = F.greatest(F.length(text), F.lit(1))
    count = F.greatest(F.size(words), F.lit(1))
    share = lambda chars: (size - F.length(F.regexp_replace(text, f"[{chars}]+", ""))) / size
    return {
        "f_marked": bins(marked, [1, 2, 3]),
        "f_symbols": bins(share(SYMBOLS), [0.005, 0.02, 0.06, 0.15]),
        "f_upper": bins(share("A-Z"), [0.05, 0.2, 0.5]),
        "f_distinct": bins(F.size(F.array_distinct(words)) / count, [0.1, 0.25, 0.4, 0.55, 0.7]),
        "f_length": bins(F.size(words), [10, 30, 100, 300, 1000]),
    }


def learn_lexicon(words: DataFrame, scratch: Scratch) -> dict[str, list[str]]:
    """Words of the marked class, from (marked boolean, language, text hash, words array of distinct words) of
    the sample: those of all languages under "", and those of each language. Copies of a text count once."""
    once = words.groupBy("language", "text_hash").agg(F.max("marked").alias("marked"), F.first("words").alias("words"))
    scopes = F.array_distinct(F.array(F.lit(""), F.coalesce("language", F.lit(""))))
    once = scratch.keep(once.select(F.explode(scopes).alias("scope"), "marked", "words"), "once")
    sums = once.groupBy("scope").agg(F.count("*").alias("n"), F.sum(F.col("marked").cast("long")).alias("m")).where("m > 0 AND m < n")
    each = once.select("scope", "marked", F.explode("words").alias("word")).groupBy("scope", "word").agg(F.count("*").alias("docs"), F.sum(F.col("marked").cast("long")).alias("hits"))
    each = scratch.keep(each.where(F.col("docs") >= LEAST_SUPPORT), "words")
    tested = each.groupBy("scope").agg(F.count("*").alias("tested"))
    # one row for each language of the sample
    rated = each.where("hits > 0").join(F.broadcast(sums.join(tested, "scope")), "scope")
    docs, hits, n, m = (F.col(c) for c in ("docs", "hits", "n", "m"))
    lift = ((hits + 0.5) / (m + 1)) / ((docs - hits + 0.5) / (n - m + 1))
    share, base = hits / docs, m / n
    # Chernoff bound of so many hits by chance, for all tested words together
    surprise = docs * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    good = rated.where((docs - hits <= COMMON_SHARE * (n - m)) & (share > base) & (surprise >= F.log(F.col("tested") / CHANCE))).withColumn("lift", lift).where(F.col("lift") >= LEAST_LIFT)
    out: dict[str, list[str]] = {}
    for r in good.select("scope", "word").orderBy("scope", "word").collect():
        out.setdefault(r["scope"], []).append(r["word"])
    return out


def posterior_columns(classes: Sequence[str], counts: Sequence, names: Sequence[str]) -> list[Column]:
    """Naive Bayes posteriors of each class by the feature columns; counts: rows (domain, feature, bin, n)."""
    total = dict.fromkeys(classes, 0)
    table: dict[tuple[str, str], dict[int, int]] = {}
    for r in counts:
        table.setdefault((r["domain"], r["feature"]), {})[r["bin"]] = r["n"]
        if r["feature"] == names[0]:
            total[r["domain"]] += r["n"]
    everything = sum(total.values())
    logs = []
    for c in classes:
        out = F.lit(float(np.log((total[c] + 1) / (everything + len(classes)))))
        for f in names:
            have = table.get((c, f), {})
            spread = [float(np.log((have.get(b, 0) + 0.5) / (total[c] + 4.0))) for b in range(8)]
            out = out + F.element_at(F.array(*map(F.lit, spread)), F.col(f) + 1)
        logs.append(out)
    top = F.greatest(*logs)
    weights = [F.exp(x - top) for x in logs]
    return [w / sum(weights[1:], weights[0]) for w in weights]


def posteriors(docs: DataFrame, labels: DataFrame, classes: Sequence[str], scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, text_hash, tokens, p_<class>...) of each row of docs, written; the row's id passes through."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # without a column of languages all words are of one scope
    language = (F.col(f"`{LANGUAGE}`") if LANGUAGE in docs.columns else F.lit(None)).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("row_id"), text.alias("words"), language.alias("language"))
    severity = F.max(F.struct(F.col("toxic") == 1, F.col("quality") == 0, domain_of(F.col("quality"), F.col("toxic")).alias("domain")))["domain"]
    known = labels.groupBy(F.col("doc_id").alias("row_id")).agg(severity.alias("domain")).where("domain IS NOT NULL AND row_id IS NOT NULL")
    # at most FIT_ROWS rows of two short columns: a size that may be broadcast
    sample = scratch.keep(known.orderBy(F.xxhash64("row_id"), "row_id").limit(FIT_ROWS), "sample")
    labelled = rows.join(F.broadcast(sample), "row_id").select("domain", "language", "words", word_array(F.col("words")).alias("split"))
    labelled = scratch.keep(labelled, "labelled")
    lexicon = learn_lexicon(labelled.select((F.col("domain") == "toxic").alias("marked"), "language", F.xxhash64("words").alias("text_hash"), F.array_distinct("split").alias("words")), scratch)
    of = features(F.col("words"), F.col("split"), marked_words(F.col("split"), F.col("language"), lexicon))
    binned = labelled.select("domain", *[c.alias(n) for n, c in of.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in of]))
    counts = binned.select("domain", pairs.alias("f")).groupBy("domain", "f.feature", "f.bin").agg(F.count("*").alias("n")).collect()
    split = rows.select("row_id", F.xxhash64("words").alias("text_hash"), "language", "words", word_array(F.col("words")).alias("split"), F.size(F.array_remove(F.split("words", "[ \t-\r]+"), "")).cast("long").alias("tokens"))
    binned = split.select("row_id", "text_hash", "tokens", *[c.alias(n) for n, c in of.items()])
    p = posterior_columns(classes, counts, list(of))
    return scratch.keep(binned.select("row_id", "text_hash", "tokens", *[c.alias(f"p_{n}") for n, c in zip(classes, p, strict=True)]), "posteriors")


def rate_column(steps: Sequence[Sequence[float]], classes: Sequence[str], most: float, steady: float = 0.0) -> Column:
    """Rates after the given steps from 1; those that end as near to it as ``steady`` are 1."""
    rate = F.lit(1.0)
    for step in steps:
        move = sum((F.col(f"p_{c}") * F.lit(float(z)) for c, z in zip(classes, step, strict=True)), F.lit(0.0))
        rate = F.least(F.greatest(rate - move, F.lit(0.0)), F.lit(most))
    return F.when(F.col("tokens") > 0, F.when(F.abs(rate - 1) <= steady, F.lit(1.0)).otherwise(rate) if steady else rate).otherwise(F.lit(0.0))


def fit_rates(table: DataFrame, classes: Sequence[str], targets: Targets) -> tuple[Column, dict]:
    """The column of rates for a table of posteriors, and what the fit came to."""
    names = [f"p_{c}" for c in classes]
    tokens = F.col("tokens").cast("double")
    sums = [F.coalesce(F.sum(tokens * F.col(n)), F.lit(0.0)).alias(n) for n in names]
    have = np.array(table.agg(*sums).first(), float)
    weights = np.array([targets.weights[c] for c in classes], float)
    weights = weights / weights.sum()
    anchor = list(classes).index(targets.anchor)
    budget = have[anchor] / weights[anchor] if weights[anchor] else have.sum()
    goal = weights * budget
    steps: list[list[float]] = []
    reached = have
    miss = lambda x: float(np.abs(x - goal).max() / max(goal.sum(), 1.0))
    for _ in range(targets.passes):
        if miss(reached) <= targets.tolerance:
            break
        rate = rate_column(steps, classes, targets.max_rate)
        # documents that the bounds hold where they are do not move, so they count in the step's length only
        free = F.when((rate > 0) & (rate < targets.max_rate), tokens).otherwise(F.lit(0.0))
        grams = [F.coalesce(F.sum(w * F.col(a) * F.col(b)), F.lit(0.0)) for w in (free, tokens) for a in names for b in names]
        moving, full = np.array(table.agg(*[g.alias(f"g{i}") for i, g in enumerate(grams)]).first(), float).reshape(2, len(names), -1)
        off = reached - goal
        newton = np.linalg.solve(moving + np.eye(len(names)) * max(1e-9, 1e-6 * np.trace(moving)), off)
        plain = off / max(np.linalg.eigvalsh(full)[-1], 1e-9)
        tried = [newton * x for x in (1.0, 0.5, 0.2, 0.05)] + [plain]
        rates = [rate_column([*steps, z.tolist()], classes, targets.max_rate) for z in tried]
        sums = [F.coalesce(F.sum(tokens * F.col(n) * r), F.lit(0.0)).alias(f"s{i}_{n}") for i, r in enumerate(rates) for n in names]
        got = np.array(table.agg(*sums).first(), float).reshape(len(tried), -1)
        best = int(((got - goal) ** 2).sum(1).argmin())
        if ((got[best] - goal) ** 2).sum() >= (off**2).sum() * (1 - 1e-6):
            break
        steps.append(tried[best].tolist())
        reached = got[best]
    rate = rate_column(steps, classes, targets.max_rate, targets.steady)
    if steps and targets.steady:
        reached = np.array(table.agg(*[F.coalesce(F.sum(tokens * F.col(n) * rate), F.lit(0.0)).alias(n) for n in names]).first(), float)
    return rate, {"steps": steps, "goal": goal.tolist(), "reached": reached.tolist(), "miss": miss(reached)}


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: Targets | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, text_hash, tokens, p_<class>..., rate, copies, miss) of each row of docs. copies: the rate rounded
    up or down by a hash of the id, so that it is the rate on average; miss: the greatest miss of a domain's
    target by the rates, relative to all targets. Runs at once; the result is a written table."""
    targets = targets or Targets()
    classes = sorted(targets.weights)
    scratch = Scratch(docs.sparkSession, "mixing")
    table = posteriors(docs, labels, classes, scratch, id_col, text_col)
    rate, fit = fit_rates(table, classes, targets)
    if fit["miss"] > targets.tolerance:
        LOG.warning("targets are missed by %.4f: %s for %s of %s", fit["miss"], fit["reached"], fit["goal"], classes)
    if targets.most_miss is not None and fit["miss"] > targets.most_miss:
        scratch.drop()
        raise ValueError(f"targets are missed by {fit['miss']:.4f}: {fit['reached']} for {fit['goal']} of {classes}")
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col("row_id")), F.lit(1 << 30)) / float(1 << 30)
    rated = table.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))
    rated = rated.withColumn("rate", F.round("rate", 6)).withColumn("miss", F.lit(round(fit["miss"], 9)))
    out = Scratch(docs.sparkSession, "mixing_result").keep(rated, "rows")
    scratch.drop()
    return out


def mixed(docs: DataFrame, labels: DataFrame, targets: Targets | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as its copies say; same columns."""
    rates = mixing_rates(docs, labels, targets, id_col, text_col)
    # equal rows have equal copies, so any of theirs will do
    by_row = rates.groupBy(F.col("row_id").alias("__row_id"), F.col("text_hash").alias("__text_hash")).agg(F.max("copies").alias("__copies")).where("__copies <> 1")
    own = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    joined = docs.join(by_row, F.col(f"`{id_col}`").eqNullSafe(F.col("__row_id")) & (own == F.col("__text_hash")), "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    repeated = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(F.col("__copies") > 0, F.col("__copies").cast("int")))))
    return repeated.drop("__copy", "__copies", "__row_id", "__text_hash")
