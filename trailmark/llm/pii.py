"""Personal data: base patterns, and further spans that boosted trees pick among candidates.

Base spans are what fixed patterns and checks (octets, Luhn, digit counts) find. High-recall generators
propose further spans, which may overlap: addresses that are spelled out, dotted quads in brackets, numbers
with other separators as cards and as phones, and tokens of letters and digits as secrets. Candidates have
binned format features (digits, separators, groups, letter case, changes between letters and digits) and
context features (cue words before, neighbouring characters).

The trees do not learn the base rules again. Their positives are base spans and, since those have the one
form that the rules know, each base span once more in other forms in its own context: spelled out, with
other separators, without its plus sign or country code. The checks are hidden from them. Positives of
secrets are tokens that a name such as password is assigned to or that begin like a known provider's keys,
each once more with no context, so that the form alone may tell. All other candidates are negatives. The
trees are fitted on one half of the documents, and each kind's threshold is calibrated on the other half:
the lowest score at which a candidate is positive with probability PRECISION. Candidates from there on that
overlap no base span are added.

All of it is column functions. The fit sees a contingency table of binned features, whose size the bins
bound whatever the data, counted over all documents; the trees become a column expression.

Patterns are possessive where that changes no match, so long runs need no stack and no backtracking. Context
is cut from the text between two candidates of a generator, so time is in proportion to a text's length.

Defined results: a null text is empty; repeated rows have equal results; an empty table gives an empty one;
positions are code points, ends exclusive; a candidate's context ends at the one before it. Spans of one text
are gathered and compared in blocks, so that many spans in one text do not take time by the square of their
number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
#: Base patterns. A match can begin within a run of its first characters only where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators: (kind, pattern). Their repetitions are bounded.
GENERATORS = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[a-z0-9-]{2,63}){1,6}"),
    ("ip", r"(?<![0-9.])[0-9]{1,4}(?:(?:\.| ?\[(?:\.|dot)\] ?| ?\((?:\.|dot)\) ?)[0-9]{1,4}){3}(?![0-9])"),
    ("card", r"(?<![0-9A-Za-z.@_-])[0-9](?:[ ./-]{0,2}[0-9]){11,23}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z.@_-])\+?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])"),
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,255}+[0-9])(?=[0-9+/_-]{0,255}+[A-Za-z])[A-Za-z0-9+/_-]{12,256}+(?![A-Za-z0-9+/_-])"),
)
#: Other forms of a base span: (pattern, replacement) pairs for each of them.
AT, DOT = r" ?@ ?", r"\."
FORMS = {
    "email": (((AT, " (at) "), (DOT, " (dot) ")), ((AT, "[at]"), (DOT, "[dot]")), ((AT, " at "), (DOT, " dot "))),
    "ip": (((DOT, "[.]"),), ((DOT, " (dot) "),)),
    "card": ((("[ -]", ""), ("(.{4})(?=.)", "$1.")), (("[ -]", ""), ("(.{4})(?=.)", "$1/"))),
    "phone": (((r"^\+", ""),), ((r"^\+", "00"),), ((r"^\+[0-9]{1,3}[ .-]?", ""),), (("[ ()-]+", "."), (r"^[+.]+", ""))),
}
#: Names that a secret is assigned to, and how keys of known providers begin: weak labels of secrets.
ASSIGNED = r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)s?[\"']?\s{0,3}(?::|=|:=)\s{0,3}[\"']?$"
KEY_STARTS = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xox[abp]-|AIza)"
#: Words before a candidate that speak for a kind of data, or against all.
CUES = (
    r"(?i)(?:phone|tel|call|fax|mobile|cell)[^a-z]*$",
    r"(?i)(?:card|visa|credit|debit|iban|account|payment)[^a-z]*$",
    r"(?i)(?:mail|contact|write to)[^a-z]*$",
    r"(?i)(?:ip|host|server|addr|address)[^a-z]*$",
    r"(?i)(?:hash|id|order|invoice|isbn|version|commit|sha|md5|uuid)[^a-z]*$",
    ASSIGNED,
)
CONTEXT = 24
#: size: bins of digits, or of a secret's characters; changes: bins of groups of digits, or of a secret's
#: changes between letters and digits.
FEATURES = ("kind", "size", "signs", "changes", "plus", "cue", "before", "after")
DIGIT_EDGES, GROUP_EDGES = (4, 7, 8, 10, 12, 14, 16, 17, 20), (2, 3, 4, 5, 6)
LENGTH_EDGES, CHANGE_EDGES = (14, 16, 18, 20, 24, 32, 36, 40, 41, 64), (2, 3, 5, 8, 12)
#: Trees, their depth, the step, the weight a leaf needs, and what calibration asks for.
TREES, DEPTH, STEP, LEAST_WEIGHT, PRECISION = 40, 3, 0.3, 2.0, 0.9


#: Types of spans, and the spans in a block of them: of those that are searched, and that are summed up.
SPAN = "struct<start:int,stop:int,match:string,before:string,after:string>"
EMPTY, PLACES, BLOCK, SMALL_BLOCK = f"array<{SPAN}>", "array<struct<kind:int,start:int,stop:int>>", 256, 64


def spans_of(text: Column, pattern: str) -> Column:
    """array<SPAN> of the leftmost matches that do not overlap, each with the text before it (CONTEXT
    characters, back to the last match) and the character after it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return once(F.split(text, pattern, -1), lambda pieces: located(F.arrays_zip(found.alias("match"), F.slice(pieces, 1, F.size(found)).alias("piece"), F.slice(pieces, 2, F.size(found)).alias("next"))))


def located(pairs: Column) -> Column:
    """Spans of matches, each with the pieces of text before and after it. Starts are sums within a block, added
    to those of the blocks before; nothing that grows is carried from span to span, as it would be copied."""
    light = F.transform(pairs, lambda x: F.struct(
        x["match"].alias("match"), F.length(x["piece"]).alias("skip"), F.length(x["match"]).alias("size"),
        F.right(x["piece"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"),
    ))
    total = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["skip"] + x["size"])
    step = lambda acc, b: F.struct((acc["at"] + total(b)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
    starts = lambda blocks: F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step, lambda acc: acc["starts"])

    def span(x: Column, first: Column) -> Column:
        return F.struct(first.alias("start"), (first + x["size"]).alias("stop"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))

    within = lambda b, at: F.transform(b, lambda x, i: span(x, at + total(F.slice(b, F.lit(1), i)) + x["skip"]))
    return once(in_blocks(light, SMALL_BLOCK), lambda blocks: once(starts(blocks), lambda at: F.flatten(F.transform(blocks, lambda b, k: within(b, at[k])))))


def in_blocks(items: Column, size: int) -> Column:
    """The items in arrays of so many; none of no items."""
    blocks = lambda x: F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / size).cast("int"))
    cut = lambda x: F.transform(blocks(x), lambda k: F.slice(x, k * size + 1, F.lit(size)))
    return once(items, lambda x: F.filter(cut(x), lambda b: F.size(b) > 0))


def bounded(spans: Column) -> Column:
    """array<struct<lo, hi, spans>>: spans in blocks, with the bounds of each block; none of no spans."""
    bounds = lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(b, lambda s: s["stop"])).alias("hi"), b.alias("spans"))
    return F.transform(in_blocks(spans, BLOCK), bounds)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once and not for each element of a loop within."""
    return F.element_at(F.transform(F.array(value), use), 1)


def touched(blocks: Column, c: Column, also: Callable[[Column], Column]) -> Column:
    """Whether a span of the blocks overlaps c and meets a condition; only blocks that reach c are searched."""
    return F.exists(blocks, lambda k: (k["lo"] < c["stop"]) & (c["start"] < k["hi"]) & F.exists(k["spans"], lambda s: overlaps(s, c) & also(s)))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def octets_fit(match: Column) -> Column:
    def fits(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(plain) <= 3, plain.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(match, r"\."), fits)


def passes(kind: str, match: Column) -> Column:
    """Whether a base match stays."""
    digits = digits_of(match)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return octets_fit(match) if kind == "ip" else F.lit(True)


def guarded(text: Column, needs: str, spans: Column) -> Column:
    """spans where the text has a character that every match needs; an empty array elsewhere."""
    have = F.contains(text, F.lit("@")) | text.rlike(r"(?i)[\[( ]at[\]) ]") if needs == "@" else text.rlike("[0-9]") if needs == "0" else F.contains(text, F.lit(needs))
    return F.when(have, spans).otherwise(F.array().cast(EMPTY))


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, stop, match>> of the base spans of a kind."""
    found = F.filter(spans_of(text, BASE[kind]), lambda s: passes(kind, s["match"]))
    return F.when(F.contains(text, F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") else text.rlike("[0-9]"), found).otherwise(F.array().cast(EMPTY))


def bin_of(value: Column, edges: Sequence[int]) -> Column:
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def character_class(c: Column) -> Column:
    """0 text's end or white space, 1 quote or bracket, 2 other punctuation, 3 a letter or anything else."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"""^["'()\[\]{}<>]"""), 1).when(c.rlike(r"^\p{Punct}"), 2).otherwise(3)


def email_signs(m: Column) -> Column:
    """How an address writes @ (itself, in brackets, as a word) and its dots (themselves, spelled, spaced)."""
    at = F.when(F.contains(m, F.lit("@")), 0).when(m.rlike(r"(?i)[(\[]at[)\]]"), 1).otherwise(2)
    dot = F.when(m.rlike(r"(?i)[(\[]dot[)\]]| dot "), 1).when(m.rlike(r" \.|\. "), 2).otherwise(0)
    return at * 3 + dot


def number_signs(m: Column) -> Column:
    """The separators of a number: none, one kind of them, brackets, several."""
    space, dash, dot, bracket = (F.contains(m, F.lit(" ")).cast("int"), F.contains(m, F.lit("-")).cast("int"), m.rlike("[./]").cast("int"), m.rlike(r"[()\[\]]").cast("int"))
    return F.when(bracket == 1, 4 + dot).when(space + dash + dot > 1, 6).otherwise(space + 2 * dash + 3 * dot)


def secret_signs(m: Column) -> Column:
    """The alphabet of a token: hexadecimal or not, its letter case, other characters."""
    return F.when(m.rlike("^[0-9a-f]+$"), 0).when(m.rlike("^[0-9A-F]+$"), 1).when(m.rlike("^[0-9a-z]+$"), 2).when(m.rlike("^[0-9A-Z]+$"), 3).when(m.rlike("^[0-9A-Za-z]+$"), 4).otherwise(5)


def described(kind: int, span: Column, match: Column | None = None, alone: bool = False) -> Column:
    """The place and the features of a candidate; match stands for its own if given. alone: as if it stood
    between spaces, with no cue before it."""
    m = span["match"] if match is None else match
    if KINDS[kind] == "secret":
        size, signs = bin_of(F.length(m), LENGTH_EDGES), secret_signs(m)
        changes = bin_of(F.size(F.split(m, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")), CHANGE_EDGES)
    else:
        size, signs = bin_of(F.length(digits_of(m)), DIGIT_EDGES), (email_signs if KINDS[kind] == "email" else number_signs)(m)
        changes = bin_of(F.size(F.split(m, "[^0-9]+")), GROUP_EDGES)
    cue = F.lit(0)
    for k, pattern in reversed(list(enumerate(CUES, 1))):
        cue = F.when(span["before"].rlike(pattern), k).otherwise(cue)
    context = [F.lit(0)] * 3 if alone else [cue, character_class(F.right(span["before"], F.lit(1))), character_class(span["after"])]
    values = (F.lit(kind), size, signs, changes, F.startswith(m, F.lit("+")), *context)
    return F.struct(span["start"].alias("start"), span["stop"].alias("stop"), *[v.cast("int").alias(f) for f, v in zip(FEATURES, values, strict=True)])


def other_forms(kind: str, spans: Column) -> Column:
    """Features of the spans in other forms, in their own context: positives that the base patterns miss."""
    k = KINDS.index(kind)
    if kind == "secret":
        return F.transform(F.filter(spans, marked), lambda s: described(k, s, alone=True))

    def in_form(form: Sequence[tuple[str, str]]) -> Column:
        def changed(span: Column) -> Column:
            match = span["match"]
            for pattern, new in form:
                match = F.regexp_replace(match, pattern, new)
            return described(k, span, match)

        return F.transform(spans, changed)

    return F.concat(*map(in_form, FORMS[kind]))


def marked(span: Column) -> Column:
    """Whether a token is a secret by its name or by how it begins."""
    return span["before"].rlike(ASSIGNED) | span["match"].rlike(KEY_STARTS)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base: array<struct<kind, start, stop>>, candidates with features and whether they are positive,
    forms: features of positives in other forms)."""
    text = F.col("words")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("words"))
    rows = rows.select("id", *[base_spans(text, k).alias(k) for k in BASE], *[guarded(text, "@" if k == "email" else "0", spans_of(text, p)).alias(f"g_{k}") for k, p in GENERATORS])
    of_kind = lambda i: lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    judged = lambda i, positive: lambda s: F.struct(positive(s).alias("is_positive"), described(i, s).alias("of"))
    base = F.concat(*[F.transform(k, of_kind(i)) for i, k in enumerate(BASE)])
    proposed = [F.transform(f"g_{k}", judged(KINDS.index(k), marked if k == "secret" else lambda s: F.lit(False))) for k, _ in GENERATORS]
    forms = F.concat(*[other_forms(k, F.col(k if k in BASE else f"g_{k}")) for k, _ in GENERATORS])
    rows = rows.select("id", base.alias("base"), F.concat(*proposed).alias("proposed"), forms.alias("forms"))
    seen = lambda blocks, c: touched(blocks, c, lambda b: b["kind"] == c["kind"])
    flat = lambda blocks: F.transform("proposed", lambda c: F.struct(*[c["of"][f].alias(f) for f in ("start", "stop", *FEATURES)], (c["is_positive"] | seen(blocks, c["of"])).alias("is_positive")))
    return rows.select("id", "base", "forms", once(bounded(F.col("base")), flat).alias("candidates"))


def contingency(table: DataFrame) -> list[tuple[tuple[int, ...], int, float, float]]:
    """(features, half, positives, negatives): a bounded number of rows, counted over all documents."""
    half = F.pmod(F.xxhash64(F.col("id")), F.lit(2)).cast("int").alias("half")
    of = lambda c, y: F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in FEATURES], y(x).cast("long").alias("y")))
    every = F.concat(of("candidates", lambda x: x["is_positive"]), of("forms", lambda x: F.lit(1)))
    rows = table.select(half, F.inline(every)).groupBy(*FEATURES, "half").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()
    return sorted((tuple(r[f] for f in FEATURES), r["half"], float(r["pos"]), float(r["n"] - r["pos"])) for r in rows)


def grow(rows: list, grads: list, depth: int) -> tuple | float:
    """A regression tree by Newton steps: (feature, value, below, from value on) or a leaf's score."""
    g, h = sum(x[0] for x in grads), sum(x[1] for x in grads)
    leaf = STEP * g / (h + 1.0)
    if not depth or h < 2 * 1e-6:
        return leaf
    best = (1e-6, None)
    for f in range(len(FEATURES)):
        by: dict[int, list[float]] = {}
        for (x, _, pos, neg), (a, b) in zip(rows, grads, strict=True):
            s = by.setdefault(x[f], [0.0, 0.0, 0.0])
            s[0] += a
            s[1] += b
            s[2] += pos + neg
        whole = sum(s[2] for s in by.values())
        lg = lh = lw = 0.0
        for v in sorted(by)[:-1]:
            lg, lh, lw = lg + by[v][0], lh + by[v][1], lw + by[v][2]
            if min(lw, whole - lw) >= LEAST_WEIGHT:
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                cut = min(x for x in by if x > v)
                best = max(best, (gain, (f, cut)), key=lambda x: x[0])
    if best[1] is None:
        return leaf
    f, cut = best[1]
    sides = []
    for upper in (False, True):
        own = [(r, d) for r, d in zip(rows, grads, strict=True) if (r[0][f] >= cut) == upper]
        sides.append(grow([r for r, _ in own], [d for _, d in own], depth - 1))
    return f, cut, *sides


def value(tree: tuple | float, x: Sequence[int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[3] if x[tree[0]] >= tree[1] else tree[2]
    return tree


def boost(rows: list) -> tuple[float, list]:
    """(first score, trees) of the boosted model for the log-odds of a positive."""
    pos, neg = sum(r[2] for r in rows), sum(r[3] for r in rows)
    first = math.log((pos + 1) / (neg + 1))
    scores, trees = [first] * len(rows), []
    for _ in range(TREES):
        grads = []
        for (_, _, p, n), s in zip(rows, scores, strict=True):
            q = 1 / (1 + math.exp(-s))
            grads.append((p * (1 - q) - n * q, (p + n) * q * (1 - q)))
        tree = grow(rows, grads, DEPTH)
        trees.append(tree)
        scores = [s + value(tree, r[0]) for s, r in zip(scores, rows, strict=True)]
    return first, trees


def thresholds(rows: list, model: tuple[float, list]) -> list[float | None]:
    """Of each kind, the lowest score at which a candidate is positive with probability PRECISION, by isotonic
    regression, so that of all candidates from there on, and one negative more, as many are positive; None if
    there is none."""
    first, trees = model
    out: list[float | None] = []
    for kind in range(len(KINDS)):
        by: dict[float, list[float]] = {}
        for x, _, p, n in rows:
            if x[0] == kind:
                s = by.setdefault(round(first + sum(value(t, x) for t in trees), 9), [0.0, 0.0])
                s[0] += p
                s[1] += p + n
        # runs of scores, from low to high; a run that is not above the one before is joined to it
        runs: list[tuple[float, float, float]] = []
        for score in sorted(by):
            low, pos, total = score, *by[score]
            while runs and runs[-1][1] * total >= pos * runs[-1][2]:
                low, p, n = runs.pop()
                pos, total = pos + p, total + n
            runs.append((low, pos, total))
        pos = total = 0.0
        best = None
        for low, p, n in reversed(runs):
            if p < PRECISION * n:
                break
            pos, total = pos + p, total + n
            if pos >= PRECISION * (total + 1):
                best = low
        out.append(best)
    return out


def tree_column(tree: tuple | float, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(c[FEATURES[f]] >= cut, tree_column(high, c)).otherwise(tree_column(low, c))


def chosen(c: Column, model: tuple[float, list], limits: Sequence[float | None]) -> Column:
    """Whether a candidate's score reaches its kind's threshold."""
    score = F.round(sum((tree_column(t, c) for t in model[1]), F.lit(model[0])), 9)
    limit = F.lit(math.inf)
    for k, t in enumerate(limits):
        if t is not None:
            limit = F.when(c["kind"] == k, F.lit(t - 1e-9)).otherwise(limit)
    return score >= limit


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added) of each row: arrays of struct<kind, start, stop>, kinds numbered as in KINDS, by kind
    and start. Runs at once; the result is a written table."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    table = scratch.keep(scanned(docs, id_col, text_col), "scanned")
    rows = contingency(table)
    model = boost([r for r in rows if r[1] == 0]) if rows else (0.0, [])
    limits = thresholds([r for r in rows if r[1] == 1], model)
    place = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))
    if any(t is not None for t in limits):
        passed = F.transform(F.filter("candidates", lambda c: chosen(c, model, limits)), place)
    else:
        passed = F.array().cast(PLACES)
    stage = table.select("id", "base", passed.alias("passed"))
    fresh = lambda blocks: F.filter("passed", lambda c: ~touched(blocks, c, lambda b: F.lit(True)))
    first = lambda blocks: F.filter("fresh", lambda c: ~touched(blocks, c, lambda o: o["kind"] < c["kind"]))
    stage = stage.select("id", "base", "passed", once(bounded(F.col("base")), fresh).alias("fresh"))
    added = F.array_sort(once(bounded(F.col("passed")), first))
    out = Scratch(spark, "pii_result").keep(stage.select("id", "base", added.alias("added")), "rows")
    scratch.drop()
    return out


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def spans_text(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans by start, not overlapping."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.aggregate(
        ordered, start,
        lambda acc, s: F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(name, s["kind"] + 1))).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.coalesce(body, text)
