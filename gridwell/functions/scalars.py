"""Scalar expressions; all are built in, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NOMINAL_DEPTHS, SURFACE_DEPTH


def finite(x: Column) -> Column:
    """Whether x is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def nan_to_null(x: Column) -> Column:
    return F.when(finite(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def floored_root(x: Column, floor: float = 1e-20) -> Column:
    return F.sqrt(F.greatest(x, F.lit(floor)))


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def pressure_to_depth(p: Column, lat: Column) -> Column:
    """Depth in metres of pressure p in dbar at latitude lat in degrees, by the UNESCO polynomial (Fofonoff and Millard 1983)."""
    # The polynomial's coefficients, from the highest power down.
    numerator = [-1.82e-15, 2.279e-10, -2.2512e-5, 9.72659, 0.0]
    p, s = p.cast("double"), F.pow(F.sin(F.radians(lat.cast("double"))), 2)
    total = F.lit(numerator[0])
    for c in numerator[1:]:
        total = total * p + F.lit(c)
    return total / (F.lit(9.780318) * (1 + (F.lit(5.2788e-3) + F.lit(2.36e-5) * s) * s) + F.lit(1.092e-6) * p)


def julian_to_timestamp(days: Column) -> Column:
    """Days since 1950-01-01 as a timestamp, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(F.lit("1950-01-01").cast("timestamp")) + F.round(days * F.lit(86_400_000_000)).cast("long"))


def season(day: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year's angle."""
    angle = F.lit(2 * math.pi / 365.25) * F.dayofyear(day)
    return F.sin(angle), F.cos(angle)


def centred(x: Column, low: float, high: float) -> Column:
    """x from low to high brought to -1 to 1."""
    return (x - F.lit((low + high) / 2)) / F.lit((high - low) / 2)


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def level_depth(nominal: Column) -> Column:
    """The depth that a product stores for a nominal level: its surface level for 0, else the level itself."""
    return F.when(nominal == NOMINAL_DEPTHS[0], F.lit(SURFACE_DEPTH)).otherwise(nominal.cast("double"))


def encode_time(at: Column, units: str) -> Column:
    """at as a number of "days|hours|seconds since EPOCH"; whole days, else fractions."""
    unit, _, epoch = units.split(" ", 2)
    if unit == "days":
        return F.datediff(at, F.lit(epoch).cast("date"))
    if unit not in ("hours", "seconds"):
        raise ValueError(f"no unit of time: {unit}")
    seconds = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.lit(epoch).cast("timestamp"))) / F.lit(1e6)
    return seconds / 3600 if unit == "hours" else seconds


def decode_time(number: Column, units: str) -> Column:
    unit, _, epoch = units.split(" ", 2)
    size = {"days": 86400, "hours": 3600, "seconds": 1}
    if unit not in size:
        raise ValueError(f"no unit of time: {unit}")
    return F.timestamp_micros(F.unix_micros(F.lit(epoch).cast("timestamp")) + F.round(number * F.lit(float(size[unit] * 10**6))).cast("long"))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def squared_hinge(x: Column, margin: float = 0.0) -> Column:
    return F.pow(relu(x + F.lit(margin)), 2)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """ln(1 + e**x), without overflow."""
    return relu(x) + F.log1p(F.exp(-F.abs(x)))


def swish(x: Column) -> Column:
    return x * sigmoid(x)


def half_bin(x: Column, start: float, step: float) -> Column:
    """The index of the half-open bin [c - step/2, c + step/2) around the centres c = start + i * step that x is in."""
    return F.floor((x - F.lit(start) + F.lit(step / 2)) / F.lit(step)).cast("int")


def flag_text(raw: Column) -> Column:
    """Binary or padded text as trimmed text."""
    return F.trim(F.decode(raw.cast("binary"), "US-ASCII"))


def monotonic_profile(raw: Column, mean: list[float], std: list[float], first: int) -> Column:
    """Standardised levels (array): as given to level first, below it each is the one above less softplus of its raw value."""
    levels = [raw[k] for k in range(first + 1)]
    above = raw[first] * std[first] + mean[first]
    for k in range(first + 1, len(mean)):
        above = above - softplus(raw[k])
        levels.append((above - mean[k]) / std[k])
    return F.array(*levels)
