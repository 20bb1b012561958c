"""Activity minutes, wear time, valid days, distributions of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.scalar import LEVELS, activity_level
from trailmark.operators.series import ordered, seconds

WEAR_FRAME, WEAR_ALLOWANCE = 90, 2


def bouts(df: DataFrame, key: str, epoch: Column, count: str, wearing: Column, epoch_minutes: int, into: str = "epoch") -> DataFrame:
    """Worn minutes of each level in each epoch, and non-wear, the epoch's other minutes."""
    level = activity_level(F.col(count))
    sums = [F.sum(F.when(wearing & (level == n), 1).otherwise(0)).alias(n) for n in LEVELS]
    out = df.groupBy(key, epoch.alias(into)).agg(*sums)
    return out.withColumn("non_wear", F.lit(epoch_minutes) - sum((F.col(n) for n in LEVELS[1:]), F.col(LEVELS[0])))


def dominant(bout: DataFrame, order: Sequence[str] = ("non_wear", *LEVELS), into: str = "dominant") -> DataFrame:
    """The level with most time, the first of ``order`` on a tie."""
    top = F.greatest(*order)
    out = F.lit(order[-1])
    for n in reversed(order[:-1]):
        out = F.when(F.col(n) == top, n).otherwise(out)
    return bout.withColumn(into, out)


def daily_report(df: DataFrame, key: str, day: Column, count: str, least_rows: int = 50, recommended: int = 22) -> DataFrame:
    """Minutes of each level on days with enough rows, the total, and the recommended minutes."""
    level = activity_level(F.col(count))
    aggs = [F.count(F.when(level == n, 1)).alias(n) for n in LEVELS]
    return df.groupBy(key, day.alias("day")).agg(*aggs, F.count("*").alias("total")).where(F.col("total") >= least_rows).withColumn("recommended", F.lit(recommended))


def span_report(df: DataFrame, key: str, time: str, count: str, first: str, last: str, least_rows: int = 50) -> DataFrame:
    """The daily report of the days from first to last, both included. The bounds are plain comparisons of
    the time column, so scans can skip what lies outside."""
    at = lambda d: F.to_timestamp_ntz(F.lit(f"{d} 00:00:00"))
    inside = df.where((F.col(time) >= at(first)) & (F.col(time) < at(last) + F.expr("INTERVAL 1 DAY")))
    return daily_report(inside, key, F.date_trunc("day", time).cast("timestamp_ntz"), count, least_rows)


def rounded_day(time: Column) -> Column:
    """The nearest midnight; noon goes to the even day since 1970."""
    half = seconds(time, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))) / 86400
    return F.date_add(F.lit("1970-01-01").cast("date"), F.rint(half).cast("int"))


def valid_participants(df: DataFrame, key: str, day: Column, more_rows_than: int, more_days_than: int) -> DataFrame:
    """Rows of participants with more than so many rows on more than so many days."""
    days = df.groupBy(key, day.alias("__day")).agg(F.count("*").alias("n")).where(F.col("n") > more_rows_than)
    good = days.groupBy(key).agg(F.count("*").alias("days")).where(F.col("days") > more_days_than)
    return df.join(good, key, "left_semi")


def valid_days(df: DataFrame, key: str, day: Column, minute: Column, more_minutes_than: int, more_days_than: int) -> DataFrame:
    """Rows on days with more than so many distinct minutes, of participants with more than so many such days."""
    rows = df.withColumn("__day", day)
    days = rows.groupBy(key, "__day").agg(F.countDistinct(minute).alias("n")).where(F.col("n") > more_minutes_than).select(key, "__day")
    good = days.groupBy(key).agg(F.count("*").alias("days")).where(F.col("days") > more_days_than)
    return rows.join(days.join(good, key, "left_semi"), [key, "__day"], "left_semi").drop("__day")


def histogram(df: DataFrame, keys: Sequence[str], column: str, low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin, n) of a fixed-width histogram whose last bin holds its upper edge; empty bins included."""
    width = (high - low) / bins
    inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
    counted = inside.groupBy(*keys, F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    dense = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return dense.join(counted, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def trimmed_tail(hist: DataFrame, keys: Sequence[str], block: int = 7) -> DataFrame:
    """Bins before the tail: in blocks of ``block`` bins counted from the end, those up to the last block of
    which at least half are not empty. The last bin always goes."""
    top = F.max("bin").over(W.partitionBy(*keys))
    rows = hist.withColumn("__block", F.floor((top - F.col("bin")) / block)).withColumn("__top", top)
    full = rows.groupBy(*keys, "__block").agg(F.sum((F.col("n") > 0).cast("int")).alias("filled")).where(F.col("filled") >= block / 2)
    first = full.groupBy(*keys).agg(F.min("__block").alias("__first"))
    out = rows.join(first, list(keys)).where((F.col("__block") >= F.col("__first")) & (F.col("bin") < F.col("__top")))
    return out.drop("__block", "__first", "__top")


def log_frequencies(hist: DataFrame, keys: Sequence[str], low: float, width: float) -> DataFrame:
    """(keys, bin, centre, y): logarithm of the bins' shares, one added to each count."""
    share = (F.col("n") + 1) / F.sum(F.col("n") + 1).over(W.partitionBy(*keys))
    return hist.select(*keys, "bin", (low + (F.col("bin") + 0.5) * width).alias("centre"), F.log(share).alias("y"))


def quartiles(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Box plot numbers: quartiles and the furthest values within 1.5 quartile distances of them."""
    q = df.groupBy(*keys).agg(*[F.percentile(column, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    joined = df.join(q, list(keys))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return joined.groupBy(*keys).agg(*[F.first(n).alias(n) for n in ("q1", "q2", "q3")], F.min(F.when(F.col(column) >= low, F.col(column))).alias("low"), F.max(F.when(F.col(column) <= high, F.col(column))).alias("high"))


def wear_marks(df: DataFrame, key: str, position: str, count: str, frame: int = WEAR_FRAME, allowance: int = WEAR_ALLOWANCE, few_runs_worn: bool = True) -> DataFrame:
    """df with ``wearing``. Runs of nonzero counts of at most ``allowance`` rows that have no other nonzero
    count within half a frame on either side are spikes and go; runs at most a frame apart are joined; what
    the joined runs span is worn. With fewer than two runs all is worn, if asked for. position counts rows."""
    w = ordered(key, position)
    flag = df.select(key, position, (F.col(count) > 0).alias("on"))
    starts = flag.withColumn("__new", (F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("long"))
    runs = starts.withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("on").groupBy(key, "run").agg(F.min(position).alias("a"), F.max(position).alias("b"))
    half, wr = round(frame / 2), ordered(key, "a")
    alone = (F.coalesce(F.col("a") - F.lag("b").over(wr), F.lit(frame * 2)) > half) & (F.coalesce(F.lead("a").over(wr) - F.col("b"), F.lit(frame * 2)) > half)
    kept = runs.withColumn("__spike", alone & (F.col("b") - F.col("a") + 1 <= allowance)).where(~F.col("__spike"))
    joined = kept.withColumn("__new", F.coalesce(F.col("a") - F.lag("b").over(wr) > frame, F.lit(False)).cast("long"))
    joined = joined.withColumn("span", F.sum("__new").over(wr.rowsBetween(W.unboundedPreceding, 0)))
    spans = joined.groupBy(key, "span").agg(F.min("a").alias("__a"), F.max("b").alias("__b"), F.count("*").alias("n")).select(F.col(key).alias("__k"), "__a", "__b")
    count_runs = runs.groupBy(F.col(key).alias("__k2")).agg(F.count("*").alias("__runs"))
    inside = df.join(spans, (F.col(key) == F.col("__k")) & F.col(position).between(F.col("__a"), F.col("__b")), "left").join(count_runs, F.col(key) == F.col("__k2"), "left")
    few = (F.coalesce("__runs", F.lit(0)) < 2) & F.lit(few_runs_worn)
    return inside.withColumn("wearing", (few | F.col("__a").isNotNull()).cast("int")).drop("__k", "__a", "__b", "__k2", "__runs")


def span_totals(df: DataFrame, key: str, position: str, flag: str, spans: DataFrame) -> DataFrame:
    """(key, total): nonzero rows in the half-open spans (key, start, stop)."""
    s = spans.select(F.col(key).alias("__k"), "start", "stop")
    inside = df.join(s, (F.col(key) == F.col("__k")) & (F.col(position) >= F.col("start")) & (F.col(position) < F.col("stop")))
    return inside.groupBy(key).agg(F.sum((F.col(flag) != 0).cast("long")).alias("total"))
