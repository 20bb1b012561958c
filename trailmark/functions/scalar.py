"""Column expressions on scalars: filters, classes, lookups, rounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds per minute of sedentary, light and moderate activity.
CUT_POINTS = (100.0, 2020.0, 5999.0)
LEVELS = ("sedentary", "light", "moderate", "vigorous")
#: Seconds of a unit of time.
UNIT_SECONDS = {"S": 1, "min": 60, "T": 60, "H": 3600, "D": 86400}


def strictly_between(c: Column, low, high) -> Column:
    """Whether c lies in the open interval."""
    return (c > low) & (c < high)


def cut_points(quantity: int = 1, unit: str = "min", counts_per_second_divisor: float = 1.0) -> tuple[float, ...]:
    """The cut points for epochs of so many units; divisor 5 for the phone's counts."""
    return tuple(p * quantity * UNIT_SECONDS[unit] / 60 / counts_per_second_divisor for p in CUT_POINTS)


def activity_level(count: Column, points: Sequence[float] = CUT_POINTS) -> Column:
    """The level of a count; null and anything beyond the last point is vigorous."""
    out = F.lit(LEVELS[-1])
    for level, point in reversed(list(zip(LEVELS, points, strict=False))):
        out = F.when(count < point, level).otherwise(out)
    return out


def city_number(participant: Column) -> Column:
    """First digit of a nine-digit participant id."""
    return F.floor(participant / 100_000_000).cast("int")


def label(code: Column, names: Mapping, other: str = "really unknown") -> Column:
    """The name of a code."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, code), F.lit(other))


def joined_labels(codes: Column, names: Mapping[str, str], separator: str = ",") -> Column:
    """Names of the codes in a text like ``[1, 3]``, in the text's order."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_join(F.transform(F.regexp_extract_all(codes, F.lit("[0-9]+"), F.lit(0)), lambda c: F.element_at(table, c)), separator)


def age(taken: Column, born: Column, stated: Column) -> Column:
    """Difference of years, else the stated age, else -1."""
    return F.coalesce(F.year(taken) - F.year(born), stated, F.lit(-1))


def round_to(c: Column, resolution: float) -> Column:
    """The nearest multiple of resolution, halves to the even one."""
    return F.rint(c / resolution) * resolution


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as DuckDB's and C's round() do: the binary product with the power of ten, halves away
    from zero. Spark's round() takes the shortest decimal instead, which differs for values that end in 5."""
    power = float(10**digits)
    scaled = F.abs(c * power)
    whole = F.floor(scaled).cast("double")
    near = F.signum(c) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / power
    # beyond 2^53 a double has no fraction, and the floor would not fit a long
    return F.when(scaled < 2.0**53, near).otherwise(c)


def service_hour(time: Column) -> Column:
    """A timetable's HH:MM:SS with hours 24 to 26 as 00 to 02."""
    hour = F.substring(time, 1, 2).cast("int")
    wrapped = F.when(hour.between(24, 26), F.lpad((hour - 24).cast("string"), 2, "0")).otherwise(F.substring(time, 1, 2))
    return F.concat(wrapped, F.substring(time, 3, 6))


def magnitude(*axes: Column) -> Column:
    return F.sqrt(sum((a * a for a in axes[1:]), axes[0] * axes[0]))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def deadband(c: Column, width: float, otherwise: float = 0.0) -> Column:
    """Values below width become ``otherwise``."""
    return F.when(c < width, F.lit(otherwise)).otherwise(c)


def inverse_cost(probability: Column) -> Column:
    """1 - p for 0 < p < 1, else 0."""
    return F.when(strictly_between(probability, 0, 1), 1 - probability).otherwise(F.lit(0.0))


def initial_token(name: Column, length: Column) -> Column:
    """First character and a length, as d12."""
    return F.concat(F.substring(name, 1, 1), length.cast("string"))


def rescaled(c: Column, low: Column, high: Column) -> Column:
    """c from [low, high] to [0, 1]; 0 where there is no spread."""
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(0.0))


def grid_index(c: Column, least: Column, size: float) -> Column:
    """Number of the cell of c counted from the least coordinate, rounded up."""
    return F.ceil((c - least) / size)


def axis_value(position: Column, first: float, step: float) -> Column:
    """Coordinate at a fractional index of an evenly spaced axis."""
    below, above = F.floor(position), F.ceil(position)
    return (first + below * step) + (position - below) * ((above - below) * step)
