"""The whole preparation of a record, in phases that are skipped while their inputs and settings are the same.

mask -> regridded years -> statistics of training days -> one record. Each phase is a table under one folder
with a note of the settings that it was made with; a phase is made anew if the note differs or an
earlier phase was. All that needs the driver are the statistics, a row per variable, and the days.

What would silently shrink or spoil the record is refused: sources without a common day, gaps in the common days, years that
are shorter than expected, a half of the grid without ocean, statistics over held-out years, and a buffer between
splits that is shorter than the inputs' history. Every cell has a row on every day.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RECORD, Axis, Grid, SplitMode
from ..operators import grids, series, splits
from ..sources import tables

PHASES = ("mask", "years", "stats", "record")


@dataclass(frozen=True)
class Product:
    """A product's table: where it is, its variables by the names in it, and how it comes to the grid."""

    path: str
    columns: Mapping[str, str]
    how: str = "bilinear"
    lat: Axis | None = None
    lon: Axis | None = None


def _block(table: DataFrame, product: Product, grid: Grid, name: str) -> DataFrame:
    return grids.block_average(grids.with_bins(table, grid), ["day"], name).drop("n")


def _bilinear(table: DataFrame, product: Product, grid: Grid, name: str) -> DataFrame:
    spark = table.sparkSession
    weights = grids.stencil(grids.cells(spark, grid), product.lat, product.lon)
    index = {"src_i": (product.lat, "lat"), "src_j": (product.lon, "lon")}
    placed = table.withColumns({k: F.round((F.col(c) - F.lit(a.start)) / F.lit(a.step)).cast("int") for k, (a, c) in index.items()})
    return grids.bilinear(placed, weights, ["day"], name).drop("n")


#: Ways to the grid, by name.
REGRID: dict[str, Callable[[DataFrame, Product, Grid, str], DataFrame]] = {"block": _block, "bilinear": _bilinear}


@dataclass
class Record:
    spark: SparkSession
    folder: str
    products: Mapping[str, Product]
    mode: SplitMode
    grid: Grid = field(default_factory=Grid)
    #: The variable whose first day makes the mask; inputs are zero-filled, the others are targets.
    mask_variable: str = "thetao_0m"
    inputs: Sequence[str] = ()
    #: Days that inputs reach back, which a buffer between splits must not be shorter than.
    history: int = 0
    #: How many days a year must have; without it, years are only held to have no gaps.
    expected: Callable[[int], int] | None = None
    #: The share of ocean that each half of the grid must have.
    least_ocean: float = 0.0

    def _settings(self) -> str:
        own = {"products": {k: [p.path, dict(p.columns), p.how, str(p.lat), str(p.lon)] for k, p in sorted(self.products.items())}, "mode": str(self.mode), "grid": str(self.grid), "mask": self.mask_variable, "inputs": list(self.inputs), "history": self.history}
        own |= {"least_ocean": self.least_ocean, "expected": self.expected and {y: self.expected(y) for y in range(RECORD[0].year, RECORD[1].year + 1)}}  # a guard that is tightened makes its phase anew
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()

    def _made(self, phase: str) -> bool:
        try:
            return self.spark.read.text(f"{self.folder}/notes/{phase}").first().value == self._settings()
        except Exception as e:  # no such note
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return False

    def _write(self, phase: str, table: DataFrame) -> None:
        if phase == "years":
            tables.write_years(table.withColumn("year", F.year("day")), f"{self.folder}/{phase}")
        else:
            table.write.mode("overwrite").parquet(f"{self.folder}/{phase}")
        self.spark.range(1).select(F.lit(self._settings()).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.folder}/notes/{phase}")

    def read(self, phase: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{phase}")

    def variables(self) -> list[str]:
        return [v for p in self.products.values() for v in p.columns.values()]

    def gridded(self, name: str) -> DataFrame:
        """A product's variables on the grid: day, lat_i, lon_j and each variable."""
        product = self.products[name]
        table = tables.read_product(self.spark, product.path, product.columns, grid=self.grid, required=list(product.columns.values()))
        out = None
        for variable in product.columns.values():
            own = REGRID[product.how](table, product, self.grid, variable)
            out = own if out is None else out.join(own, ["day", "lat_i", "lon_j"], "full")
        return out

    def mask(self) -> DataFrame:
        product = next(p for p in self.products.values() if self.mask_variable in p.columns.values())
        table = tables.read_product(self.spark, product.path, product.columns, grid=self.grid)
        binned = grids.checked_overlap(grids.with_bins(table, self.grid))
        mask = grids.land_mask(binned, grids.cells(self.spark, self.grid), self.mask_variable)
        return grids.checked_mask(mask, self.grid.lon.size, self.least_ocean) if self.least_ocean else mask

    def days(self) -> DataFrame:
        """The common days of all products within the record's period, if they have no gaps and years are as long as expected."""
        own = [tables.read_product(self.spark, p.path, p.columns, grid=self.grid).select("day") for p in self.products.values()]
        days = series.common_days(*own, first=RECORD[0], last=RECORD[1])
        held = sorted(r.day for r in days.collect())  # a row per day
        days = series.checked_days(self.spark.createDataFrame([(d,) for d in held], "day date"))
        if self.expected:
            found = {y: sum(d.year == y for d in held) for y in sorted({d.year for d in held})}
            if short := {y: (n, self.expected(y)) for y, n in found.items() if n != self.expected(y)}:
                raise ValueError(f"years with other numbers of days than expected: {short}")
        return days

    def years(self) -> DataFrame:
        """All products on their common days, masked; one plan for all years."""
        parts = [self.gridded(n) for n in self.products]
        days = self.days()
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, ["day", "lat_i", "lon_j"], "full")
        whole = grids.complete(out, grids.cells(self.spark, self.grid), days)
        return grids.apply_mask(whole, self.read("mask"), self.variables())

    def _labelled(self, table: DataFrame) -> DataFrame:
        first, last = table.agg(F.min("day"), F.max("day")).first()
        days = splits.day_labels(series.calendar(self.spark, first, last), self.mode, self.history)
        return table.drop("year").join(days.select("day", "t", "year", "doy", "split"), "day")  # a row per day, which Spark broadcasts while it is small

    def stats(self) -> DataFrame:
        """Mean and deviation of each variable over the ocean's training days."""
        train = splits.checked_training(self._labelled(self.read("years")).where("split = 'train'"), self.mode)
        return series.moments(series.long_form(train, [], self.variables()), ["var"])

    def record(self) -> DataFrame:
        """Standardised values of all days; inputs without nulls, targets with theirs."""
        stats = {r["var"]: (r["mean"], r["std"]) for r in self.read("stats").collect() if r["mean"] is not None}
        return series.zero_filled(series.standardise(self._labelled(self.read("years")), stats), list(self.inputs))

    def run(self, from_phase: str = "mask") -> DataFrame:
        """Makes what isn't made with these settings, and everything from from_phase on; returns the record."""
        stale = False
        for phase in PHASES:
            stale = stale or PHASES.index(phase) >= PHASES.index(from_phase) and from_phase != "mask" or not self._made(phase)
            if stale:
                self._write(phase, getattr(self, phase)())
        return self.read("record")
