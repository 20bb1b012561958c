"""Time series: deltas, gaps, runs, downsampling, filling, spines, resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(key: str | Sequence[str], *order):
    """The window of a participant's rows in order."""
    return W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def seconds(later: Column, earlier: Column) -> Column:
    """Float seconds between timestamps without time zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def with_delta(df: DataFrame, key: str, time: str, tiebreak: str, into: str = "delta") -> DataFrame:
    """Seconds since the participant's previous row; null at first."""
    return df.withColumn(into, seconds(F.col(time), F.lag(time).over(ordered(key, time, tiebreak))))


def data_gaps(df: DataFrame, key: str, time: str, tiebreak: str, longer_than: float) -> DataFrame:
    """(key, start_time, stop_time) of spaces longer than a limit, one second before the rows that bound them."""
    rows = with_delta(df, key, time, tiebreak, "gap").where(F.col("gap") > longer_than)
    stop = F.col(time) - F.expr("INTERVAL 1 SECOND")
    return rows.select(key, F.timestamp_add("SECOND", -F.col("gap").cast("long"), stop).alias("start_time"), stop.alias("stop_time"))


def with_runs(df: DataFrame, key: str, value: Column, order: Sequence, into: str = "run") -> DataFrame:
    """Number, per participant from 1, of the run of equal consecutive values that a row is in."""
    w = ordered(key, *order)
    changed = (~value.eqNullSafe(F.lag(value).over(w)) | F.row_number().over(w).eqNullSafe(1)).cast("long")
    return df.withColumn("__new", changed).withColumn(into, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def with_breaks(df: DataFrame, key: str, breaks: Column, order: Sequence, into: str) -> DataFrame:
    """Number, per participant from 0, of the island that begins wherever breaks is true."""
    w = ordered(key, *order)
    flag = df.withColumn("__new", F.coalesce(breaks, F.lit(False)).cast("long"))
    return flag.withColumn(into, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def run_lengths(df: DataFrame, key: str, value: str, time: str, tiebreak: str) -> DataFrame:
    """One row for each run: its value, first and last time, and rows."""
    runs = with_runs(df, key, F.col(value), [time, tiebreak])
    return runs.groupBy(key, "run").agg(F.first(value).alias(value), F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count("*").alias("duration"))


def movement(df: DataFrame, key: str, cell: str, time: str, tiebreak: str, longer_than: int) -> DataFrame:
    """Dwells and trips. Runs of a cell first; runs of more rows than the limit, and what follows one, begin a
    new segment, so short runs in a row make one trip. duration counts rows, trip_length runs."""
    runs = run_lengths(df, key, cell, time, tiebreak)
    w = ordered(key, "run")
    new = (F.col("duration") > longer_than) | (F.lag("duration").over(w) > longer_than)
    marked = with_breaks(runs.withColumn("__cut", new), key, F.col("__cut"), ["run"], "segment")
    return marked.groupBy(key, "segment").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.min_by(cell, "run").alias("grid_cell"),
        F.sum("duration").alias("duration"), F.count("*").alias("trip_length"),
    )


def downsample(df: DataFrame, key: str, time: str, tiebreak: str, frequency: int) -> DataFrame:
    """All rows that come more than ``frequency`` seconds after the previous one, and every frequency-th of
    the others."""
    rows = with_delta(df, key, time, tiebreak, "__delta").withColumn("__far", F.coalesce(F.col("__delta") > frequency, F.lit(False)))
    place = F.row_number().over(W.partitionBy(key, "__far").orderBy(time, tiebreak))
    return rows.withColumn("__place", place).where(F.col("__far") | ((F.col("__place") - 1) % frequency == 0)).drop("__delta", "__far", "__place")


def every_nth(df: DataFrame, key: str, order: Sequence, n: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(ordered(key, *order))).where((F.col("__k") - 1) % n == 0).drop("__k")


def forward_fill(df: DataFrame, key: str, order: Sequence, column: str) -> DataFrame:
    w = ordered(key, *order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def known_neighbours(df: DataFrame, key: str, order: Sequence, time: str, column: str) -> DataFrame:
    """Each row with the values and times of the nearest rows before and after (itself included) that have one."""
    before, after = ordered(key, *order).rowsBetween(W.unboundedPreceding, 0), ordered(key, *order).rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(column).isNotNull(), F.col(time))
    return df.select(
        "*", F.last(column, True).over(before).alias(f"prev_{column}"), F.last(at, True).over(before).alias("prev_time"),
        F.first(column, True).over(after).alias(f"next_{column}"), F.first(at, True).over(after).alias("next_time"),
    )


def spine(df: DataFrame, key: str, time: str, step: str = "1 minute") -> DataFrame:
    """(key, time) at every step from the participant's first to last row, cut to the step."""
    unit = step.split()[1]
    ends = df.groupBy(key).agg(F.min(F.date_trunc(unit, time)).alias("a"), F.max(F.date_trunc(unit, time)).alias("b"))
    return ends.select(key, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias(time))


def interpolate_gaps(df: DataFrame, key: str, time: str, tiebreak: str, columns: Sequence[str], longer_than: float, at_most: float, within: float | None, step: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Rows between neighbours that are more than ``longer_than`` and at most ``at_most`` seconds and less than
    ``within`` apart in the plane, on a line between them every ``step`` seconds, and all rows of df."""
    w = ordered(key, time, tiebreak)
    pairs = df.select(key, F.col(time).alias("t0"), F.lead(time).over(w).alias("t1"), *[x for c in columns for x in (F.col(c).alias(f"{c}0"), F.lead(c).over(w).alias(f"{c}1"))])
    pairs = pairs.withColumn("span", seconds(F.col("t1"), F.col("t0"))).where((F.col("span") > longer_than) & (F.col("span") <= at_most))
    if within is not None:
        pairs = pairs.where(F.sqrt(sum((F.pow(F.col(f"{c}1") - F.col(f"{c}0"), 2) for c in columns), F.lit(0.0))) < within)
    steps = pairs.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("span") / step) - 1, F.lit(1)).cast("int")))).where(F.col("k") * step < F.col("span"))
    jitter = (lambda i: noise * F.randn(seed + i)) if noise else (lambda i: F.lit(0.0))
    line = [(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("k") * step / F.col("span") + jitter(i)).alias(c) for i, c in enumerate(columns)]
    filled = steps.select(key, F.timestamp_add("SECOND", (F.col("k") * step).cast("int"), F.col("t0")).alias(time), *line, F.lit(True).alias("interpolated"))
    return df.select(key, time, *columns, F.lit(False).alias("interpolated")).unionByName(filled)


def convolve(df: DataFrame, key: str | Sequence[str], order: Sequence, column: str, weights: Sequence[float], into: str) -> DataFrame:
    """Weighted sum of a row and its neighbours, zeros beyond the ends; weights are symmetric in effect with
    the last applied to the earliest row."""
    w, half = ordered(key, *order), len(weights) // 2
    terms = [F.coalesce(F.lag(column, i - half).over(w), F.lit(0.0)) * float(x) for i, x in enumerate(weights)]
    return df.withColumn(into, sum(terms[1:], terms[0]))


def resample(df: DataFrame, key: str, epoch: Column, median: Sequence[str] = (), first: Mapping[str, Column] | Sequence[str] = (), total: Sequence[str] = (), mean: Sequence[str] = (), order: Sequence[str] = (), into: str = "epoch") -> DataFrame:
    """One row for each participant and epoch: medians, first values that are not null, sums, means."""
    place = F.struct(*order) if order else None
    aggs = [F.median(c).alias(c) for c in median] + [F.sum(c).alias(c) for c in total] + [F.avg(c).alias(c) for c in mean]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in first]
    return df.groupBy(key, epoch.alias(into)).agg(*aggs)


def thin_minutes(df: DataFrame, key: str, time: str, skip: int, columns: Sequence[str]) -> DataFrame:
    """Every (skip+1)-th recorded minute, copied over the skipped ones; where copies and rows of one minute
    meet, the first stays."""
    minute = F.date_trunc("minute", time)
    rows = df.withColumn("__m", minute).withColumn("__k", F.dense_rank().over(W.partitionBy(key).orderBy("__m")))
    kept = rows.where((F.col("__k") - 1) % (skip + 1) == 0).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(skip))))
    moved = kept.withColumn("minute", F.timestamp_add("MINUTE", F.col("__copy"), F.col("__m")))
    best = F.row_number().over(W.partitionBy(key, "minute").orderBy("__copy", time, *columns))
    return moved.withColumn("__best", best).where("__best = 1").select(key, "minute", *columns)


def halves(df: DataFrame, key: str, order: Sequence, into: str = "half") -> DataFrame:
    """before for the first floor(n/2) rows of a participant, after for the rest."""
    n = F.count("*").over(W.partitionBy(key))
    return df.withColumn(into, F.when(F.row_number().over(ordered(key, *order)) <= F.floor(n / 2), "before").otherwise("after"))
