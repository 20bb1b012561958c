"""Piecewise exponential fits of count distributions, tails, errors of fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLAT = -1e-12
STARTS, BOUNDS = (100.0, 1951.0, 5725.0), ((20.0, 200.0), (1500.0, 2500.0), (4000.0, 7000.0))


def fixed_breaks(x: np.ndarray, y: np.ndarray, breaks: Sequence[float]) -> tuple[np.ndarray, float]:
    """Coefficients of the continuous piecewise-linear least squares line (first value, first slope, changes
    of slope at the inner breaks), and its squared error."""
    columns = [np.ones_like(x), x - breaks[0], *[np.maximum(x - b, 0) for b in breaks[1:-1]]]
    a = np.stack(columns, 1)
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    return beta, float(((y - a @ beta) ** 2).sum())


def search_breaks(x: np.ndarray, y: np.ndarray, bounds: Sequence[tuple[float, float]], starts: Sequence[float], rounds: int = 6) -> list[float]:
    """Inner breaks by coordinate search within the bounds, on ever finer grids."""
    inner = list(starts)
    for k in range(rounds):
        for i, (low, high) in enumerate(bounds):
            reach = (high - low) / 2**k
            grid = np.unique(np.clip(np.linspace(inner[i] - reach / 2, inner[i] + reach / 2, 17), low, high))
            errors = [fixed_breaks(x, y, [x[0], *sorted([*inner[:i], g, *inner[i + 1 :]]), x[-1]])[1] for g in grid]
            inner[i] = float(grid[int(np.argmin(errors))])
    return sorted(inner)


def predict(x: np.ndarray, beta: np.ndarray, breaks: Sequence[float]) -> np.ndarray:
    return beta[0] + beta[1] * (x - breaks[0]) + sum((c * np.maximum(x - b, 0) for c, b in zip(beta[2:], breaks[1:-1], strict=True)), np.zeros_like(x))


def segment_area(start: Column, slope: Column, length: Column) -> Column:
    """Area under start * exp(slope * x) over a length; a slope beyond 1 counts as flat."""
    s = F.when(slope > 1, F.lit(FLAT)).otherwise(slope)
    return start / s * (F.exp(s * length) - 1)


def areas(values: np.ndarray, slopes: np.ndarray, breaks: Sequence[float]) -> np.ndarray:
    s = np.where(slopes > 1, FLAT, slopes)
    s = np.where(s == 0, FLAT, s)
    return values[:-1] / s * (np.exp(s * np.diff(breaks)) - 1)


def errors(y: np.ndarray, fit: np.ndarray, parameters: int) -> tuple[float, ...]:
    """r2, mean squared error, explained variance, aic, bic."""
    off, spread = y - fit, float(((y - y.mean()) ** 2).sum()) or 1.0
    sse = max(float((off**2).sum()), 1e-300)
    return 1 - sse / spread, sse / len(y), 1 - off.var() / (spread / len(y)), 2 * parameters - np.log(sse), parameters * np.log(len(y)) - np.log(sse)


def piecewise_fits(hist: DataFrame, key: str, x: str = "centre", y: str = "y", starts: Sequence[float] = STARTS, bounds: Sequence[tuple[float, float]] = BOUNDS, search: bool = True) -> DataFrame:
    """(key, breaks, slopes, areas, r2, mse, exp_var, aic, bic): fits of y, logarithms of frequencies, against x.
    A rising tail is made flat. Participants with fewer points than coefficients are left out."""
    schema = f"{key} long, breaks array<double>, slopes array<double>, areas array<double>, r2 double, mse double, exp_var double, aic double, bic double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        xs, ys = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        inside = [(s, b) for s, b in zip(starts, bounds, strict=True) if xs[0] < s < xs[-1]]
        if len(xs) < len(inside) + 3:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        inner = search_breaks(xs, ys, [b for _, b in inside], [s for s, _ in inside]) if search else [s for s, _ in inside]
        breaks = [xs[0], *inner, xs[-1]]
        beta, _ = fixed_breaks(xs, ys, breaks)
        slopes, at = np.cumsum(beta[1:]), predict(np.array(breaks), beta, breaks)
        line = predict(xs, beta, breaks)
        if slopes[-1] > 0:
            slopes[-1] = FLAT
            line = np.where(xs > breaks[-2], FLAT * xs + at[-2], line)
        row = (pdf[key].iloc[0], breaks, slopes.tolist(), areas(np.exp(at), slopes, breaks).tolist(), *errors(np.exp(ys), np.exp(line), 2 * len(slopes)))
        return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

    return hist.select(key, x, y).groupBy(key).applyInPandas(fit, schema)


def error_metrics(df: DataFrame, keys: Sequence[str], y: str, fit: str, parameters: int) -> DataFrame:
    """r2, mse, exp_var, aic and bic of a fit, by sums."""
    off = F.col(y) - F.col(fit)
    sse, n = F.sum(off * off), F.count("*")
    out = df.groupBy(*keys).agg(sse.alias("sse"), n.alias("n"), F.var_pop(y).alias("vy"), F.var_pop(off).alias("vo"))
    return out.select(
        *keys, (1 - F.col("sse") / (F.col("vy") * F.col("n"))).alias("r2"), (F.col("sse") / F.col("n")).alias("mse"), (1 - F.col("vo") / F.col("vy")).alias("exp_var"),
        (F.lit(2.0 * parameters) - F.log("sse")).alias("aic"), (parameters * F.log("n") - F.log("sse")).alias("bic"),
    )


def quadratic(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, a, b, c) of y = a + b x + c x^2 by least squares; x is centred first for stable sums."""
    w = W.partitionBy(*keys)
    d = df.withColumn("__m", F.avg(x).over(w)).withColumn("__x", F.col(x) - F.col("__m"))
    s = {f"s{k}": F.sum(F.pow("__x", F.lit(float(k)))) for k in range(1, 5)} | {f"t{k}": F.sum(F.pow("__x", F.lit(float(k))) * F.col(y)) for k in range(3)}
    g = d.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.first("__m").alias("m"), *[e.alias(k) for k, e in s.items()])
    c = {k: F.col(k) for k in ("n", "m", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}

    def det(a, b, e):
        return a[0] * (b[1] * e[2] - e[1] * b[2]) - b[0] * (a[1] * e[2] - e[1] * a[2]) + e[0] * (a[1] * b[2] - b[1] * a[2])

    one, two, three, t = (c["n"], c["s1"], c["s2"]), (c["s1"], c["s2"], c["s3"]), (c["s2"], c["s3"], c["s4"]), (c["t0"], c["t1"], c["t2"])
    whole = det(one, two, three)
    p, q, r = det(t, two, three) / whole, det(one, t, three) / whole, det(one, two, t) / whole
    return g.select(*keys, (p - q * c["m"] + r * c["m"] * c["m"]).alias("a"), (q - 2 * r * c["m"]).alias("b"), r.alias("c"))


def gaussian_tail(coefficients: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, scale, mu, sigma) of the bell curve whose logarithm is a + b x + c x^2; null unless c < 0."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    ok = lambda e: F.when(c < 0, e)
    return coefficients.select(*keys, ok(F.exp(a - b * b / c / 4)).alias("scale"), ok(-b / c / 2).alias("mu"), ok(F.sqrt(-1 / (2 * c))).alias("sigma"))


def smoothed_peak(df: DataFrame, keys: Sequence[str], x: str, y: str, window: int) -> DataFrame:
    """(keys, x, y) of the highest local maximum of the rolling mean; the first on a tie."""
    w = W.partitionBy(*keys).orderBy(x)
    rows = df.withColumn("__n", F.count("*").over(w.rowsBetween(1 - window, 0))).withColumn("smooth", F.when(F.col("__n") == window, F.avg(y).over(w.rowsBetween(1 - window, 0))))
    top = rows.withColumn("before", F.lag("smooth").over(w)).withColumn("after", F.lead("smooth").over(w)).where("smooth > before AND smooth > after")
    return top.groupBy(*keys).agg(F.min_by(x, F.struct((-F.col("smooth")).alias("k"), x)).alias(x), F.max("smooth").alias(y))
