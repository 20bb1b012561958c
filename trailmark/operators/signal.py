"""Activity counts of raw acceleration."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published coefficients of the device's filter.
A = (
    1, -4.1637, 7.5712, -7.9805, 5.385, -2.4636, 0.89238, 0.06361, -1.3481, 2.4734, -2.9257, 2.9298, -2.7816, 2.4777,
    -1.6847, 0.46483, 0.46565, -0.67312, 0.4162, -0.13832, 0.019852,
)
B = (
    0.049109, -0.12284, 0.14356, -0.11269, 0.053804, -0.02023, 0.0063778, 0.018513, -0.038154, 0.048727, -0.052577,
    0.047847, -0.046015, 0.036283, -0.012977, -0.0046262, 0.012835, -0.0093762, 0.0034485, -0.00080972, -0.00019623,
)
RATE, DEADBAND, PEAK, STEP, BLOCK, GAIN = 30, 0.068, 2.13, 0.0164, 10, 0.965
BAND, ORDER = (0.01, 7.0), 4


def butterworth(order: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Band-pass numerator and denominator; edges as shares of half the sampling rate."""
    w = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    width, centre = w[1] - w[0], math.sqrt(w[0] * w[1])
    poles = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre**2)
    poles = np.concatenate([poles + root, poles - root])
    gain = width**order * np.real(4.0**order / np.prod(4 - poles))
    z = np.concatenate([np.ones(order), -np.ones(order)])
    return np.real(gain * np.poly(z)), np.real(np.poly((4 + poles) / (4 - poles)))


def iir(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """A direct transposed filter, with an initial state if given."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    z = np.zeros(n - 1) if state is None else state.copy()
    out = np.empty(len(x))
    for i, v in enumerate(x):
        y = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * y
        z[-1] = b[-1] * v - a[-1] * y
        out[i] = y
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter forwards and backwards, with odd extension of the ends and steady initial states."""
    n = max(len(a), len(b))
    edge = min(3 * n, len(x) - 1)
    if edge < 1:
        return x.copy()
    long = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2 : -edge - 2 : -1]])
    companion = np.zeros((n - 1, n - 1))
    companion[:, 0] = -a[1:] / a[0]
    companion[:-1, 1:] += np.eye(n - 2)
    steady = np.linalg.solve(np.eye(n - 1) - companion, b[1:] / a[0] - a[1:] / a[0] * b[0] / a[0])
    out = iir(b, a, long, steady * long[0])[::-1]
    return iir(b, a, out, steady * out[0])[::-1][edge : edge + len(x)]


def to_rate(x: np.ndarray, rate: int, target: int = RATE, half_width: int = 32) -> np.ndarray:
    """Band-limited resampling by a windowed sinc."""
    if rate <= target:
        return x
    at = np.arange(int(len(x) * target / rate)) * rate / target
    near = np.floor(at).astype(int)[:, None] + np.arange(-half_width + 1, half_width + 1)
    cut = target / rate
    t = near - at[:, None]
    kernel = cut * np.sinc(cut * t) * np.where(np.abs(t) < half_width, 0.5 + 0.5 * np.cos(np.pi * t / half_width), 0)
    values = np.where((near >= 0) & (near < len(x)), x[np.clip(near, 0, len(x) - 1)], 0)
    return (values * kernel).sum(1)


def counts(x: np.ndarray, rate: int) -> np.ndarray:
    """Counts of each second of one axis, sampled at a rate."""
    if len(x) < 2:
        return np.zeros(0)
    at_rate = to_rate(np.asarray(x, float), rate)
    b, a = butterworth(ORDER, BAND[0] / (RATE / 2), BAND[1] / (RATE / 2))
    shaped = iir(np.array(B) * GAIN, np.array(A, float), zero_phase(b, a, at_rate))[::3]
    size = np.abs(np.clip(shaped, -PEAK, PEAK))
    steps = np.floor(np.where(size < DEADBAND, 0, size) / STEP)
    return np.add.reduceat(steps, np.arange(0, len(steps), BLOCK))


def activity_counts(samples: DataFrame, key: str, time: str, rate: int = 50) -> DataFrame:
    """(key, second, x_count, y_count, z_count, summary_count) of samples (key, time, x, y, z). Samples of
    equal time are all dropped; the others are put on the grid of the rate by medians. Counts of a key are
    made together, since the filters have long memories."""
    step = 1_000_000 // rate
    micros = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col(time))
    single = samples.groupBy(key, time).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in "xyz"]).where("n = 1")
    grid = single.groupBy(key, F.floor(micros / step).alias("tick")).agg(*[F.median(c).alias(c) for c in "xyz"])

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        axes = [counts(pdf[c].to_numpy(float), rate) for c in "xyz"]
        n = min(map(len, axes))
        out = pd.DataFrame({f"{c}_count": a[:n].astype(int) for c, a in zip("xyz", axes, strict=True)})
        out["summary_count"] = np.sqrt(sum((out[f"{c}_count"].astype(float) ** 2 for c in "xyz"), np.zeros(n)))
        out.insert(0, "second", pdf["tick"].iloc[0] // rate + np.arange(n))
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return grid.groupBy(key).applyInPandas(make, f"{key} long, second long, x_count long, y_count long, z_count long, summary_count double")


def axes(counted: DataFrame, key: str) -> DataFrame:
    """(key, second, axis1, axis2, axis3): the counts of x, y and z as whole numbers."""
    return counted.select(key, "second", *[F.col(f"{c}_count").cast("int").alias(f"axis{k}") for k, c in enumerate("xyz", 1)])
