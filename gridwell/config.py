"""What describes a record: grid, calendar, product coverage, split modes, levels. Plain values on the driver."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Axis:
    start: float
    stop: float
    step: float

    @property
    def size(self) -> int:
        return int(round((self.stop - self.start) / self.step)) + 1


@dataclass(frozen=True)
class Grid:
    lat: Axis = Axis(5.0, 25.0, 0.25)
    lon: Axis = Axis(50.0, 100.0, 0.25)
    #: Degrees that sources are read beyond the grid's edges.
    pad: float = 0.2

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self.lat.start - self.pad, self.lat.stop + self.pad, self.lon.start - self.pad, self.lon.stop + self.pad


#: The versions of the record: the whole grid, and its eastern half from 75 degrees on.
VERSIONS = {"v2": Grid(), "v3": Grid(lon=Axis(75.0, 100.0, 0.25))}


# The record's period and the products' coverage.
RECORD = (dt.date(1993, 1, 1), dt.date(2024, 12, 15))
COVERAGE = {
    "era5": (dt.date(1940, 1, 1), dt.date(2026, 6, 30)),
    "glorys": (dt.date(1993, 1, 1), dt.date(2026, 6, 23)),
    "oisst": (dt.date(1981, 9, 1), dt.date(2026, 6, 30)),
    "sla": (dt.date(1993, 1, 1), dt.date(2026, 1, 16)),
    "sss": (dt.date(1993, 1, 1), dt.date(2024, 12, 15)),
}

# Input variables, levels with their nominal and actual depths in metres, weights of level pairs.
INPUTS = ["sst", "sla", "sss", "ugos", "vgos"]
NOMINAL_DEPTHS = [0, 5, 10, 20, 30, 50, 75, 100, 125, 150, 200, 300, 500, 700, 1000]
ACTUAL_DEPTHS = [0.4940, 5.0782, 9.5730, 18.4956, 29.4447, 47.3737, 77.8539, 92.3261, 130.6660, 155.8507, 186.1256, 318.1274, 541.0889, 643.5668, 1062.4399]
GATE = [0.0, 0.0, 0.0, 0.0, 0.0, 0.3, 0.3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]
SURFACE_DEPTH = 0.494025


@dataclass(frozen=True)
class SplitMode:
    """Calendar years that are held out, and the days beside them that belong to no split."""

    val_years: Sequence[int]
    test_years: Sequence[int]
    buffer_days: int = 0

    def __post_init__(self) -> None:
        if both := set(self.val_years) & set(self.test_years):
            raise ValueError(f"years in two splits: {sorted(both)}")

    @property
    def held(self) -> list[int]:
        return sorted({*self.val_years, *self.test_years})

    def checked(self, history: int) -> SplitMode:
        """Itself; a buffer that is shorter than the days that inputs reach back would leak."""
        if 0 < self.buffer_days < history:
            raise ValueError(f"a buffer of {self.buffer_days} days is less than the {history} days that inputs reach back")
        return self


# The modes.
SPLIT_MODES = {
    "chronological": SplitMode((2021, 2022), (2023, 2024)),
    "interleaved": SplitMode((2000, 2013), (2004, 2017), 45),
    "legacy": SplitMode((2021,), (2022,)),
}


def split_mode(name: str) -> SplitMode:
    if name not in SPLIT_MODES:
        raise KeyError(f"{name} is none of {sorted(SPLIT_MODES)}")
    return SPLIT_MODES[name]


@dataclass(frozen=True)
class Inputs:
    """How a sample's channels are made: offsets and trailing windows of each variable."""

    lags: Sequence[int] = (0, 3, 7)
    windows: Sequence[int] = (30, 90)
    variables: Sequence[str] = field(default_factory=lambda: tuple(INPUTS))

    @property
    def history(self) -> int:
        """Days before a target day that its inputs reach back."""
        return max([0, *self.lags, *(w - 1 for w in self.windows)])

    @property
    def channels(self) -> int:
        """Per variable one for each lag and window; one for the mask, two for the place, two for the season."""
        return (len(self.lags) + len(self.windows)) * len(self.variables) + 5

    def only(self, names: Sequence[str]) -> Inputs:
        """With these variables alone, in the declared order."""
        if not names or (unknown := set(names) - set(self.variables)):
            raise ValueError(f"unknown variables: {sorted(unknown)}" if names else "no variables")
        return Inputs(self.lags, self.windows, tuple(v for v in self.variables if v in set(names)))


def is_leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


@dataclass(frozen=True)
class Period:
    """Days from first to last; none if last is before first."""

    first: dt.date
    last: dt.date

    def __and__(self, other: Period) -> Period:
        return Period(max(self.first, other.first), min(self.last, other.last))

    def __len__(self) -> int:
        return max(0, (self.last - self.first).days + 1)


def covered(year: int, product: str) -> Period:
    """The days of year that product and record both have."""
    return Period(dt.date(year, 1, 1), dt.date(year, 12, 31)) & Period(*COVERAGE[product]) & Period(*RECORD)


def expected_days(year: int, product: str) -> int:
    return len(covered(year, product))


def norm_groups(filters: int, most: int = 8) -> int:
    """The largest number of most, most/2, ... that divides filters."""
    return next(g for g in (most >> k for k in range(most.bit_length())) if filters % g == 0)
