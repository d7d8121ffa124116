"""A remote archive as a source of Spark: filters on box, level and time become requests, and each request is a task.

    register(spark, "archive", "day date, lat double, lon double, depth double, value double", fetch)
    spark.read.format("archive").option("products", "sea").option("years", "2000,2001").load().where("day >= '2000-06-01' AND lat < 10")

The archive answers a request (product, variables, south, north, west, east, least and most depth, start and end) with a pandas DataFrame or a pyarrow
table, or None where it has nothing. Requests that no filter leaves anything of aren't made. A request's end is midnight of its last day, since
archives take the nearest time, which would be a day later for the day's last second.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from ..config import Grid

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need the libraries only

#: Columns that filters narrow, with the ends of the request that they are.
ENDS = {"lat": ("south", "north"), "lon": ("west", "east"), "depth": ("least", "most"), "day": ("first", "last")}


@dataclass(frozen=True)
class Request(D.InputPartition):
    """What one task asks for; depth None: a product without levels."""

    product: str
    variables: tuple[str, ...]
    first: dt.date
    last: dt.date
    south: float
    north: float
    west: float
    east: float
    least: float | None = None
    most: float | None = None

    def narrowed(self, column: str, low: object = None, high: object = None) -> Request:
        """With the ends of column no further than low and high; a product without levels has none to narrow."""
        names = ENDS[column]
        ends = dict(zip(names, (getattr(self, n) for n in names), strict=True))
        if ends[names[0]] is None:
            return self
        if low is not None:
            ends[names[0]] = max(ends[names[0]], low)
        if high is not None:
            ends[names[1]] = min(ends[names[1]], high)
        return replace(self, **ends)

    @property
    def empty(self) -> bool:
        return any(getattr(self, a) is not None and getattr(self, a) > getattr(self, b) for a, b in ENDS.values())

    def asked(self) -> dict:
        """The request as the archive gets it."""
        own = {k: v for k, v in asdict(self).items() if k not in ("first", "last", "value")}
        return own | {"variables": list(self.variables), "start": f"{self.first}T00:00:00", "end": f"{self.last}T00:00:00"}


def bounds(f: D.Filter) -> tuple[str, object, object] | None:
    """The column that a filter narrows and its least and largest value; None for filters that narrow nothing. Open ends count as closed ones: Spark filters again."""
    column = ".".join(f.attribute) if hasattr(f, "attribute") else None
    if column not in (*ENDS, "product"):
        return None
    if isinstance(f, D.EqualTo):
        return column, f.value, f.value
    if isinstance(f, D.In):
        held = [v for v in f.value if v is not None]
        return (column, min(held), max(held)) if held else None
    if isinstance(f, (D.GreaterThan, D.GreaterThanOrEqual)):
        return column, f.value, None
    if isinstance(f, (D.LessThan, D.LessThanOrEqual)):
        return column, None, f.value
    return None


class SubsetReader(D.DataSourceReader):
    def __init__(self, requests: Sequence[Request], schema: T.StructType, fetch: Callable[[dict], object]) -> None:
        self.requests, self.schema, self.fetch = list(requests), schema, fetch

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if found := bounds(f):
                column, low, high = found
                if column == "product":
                    self.requests = [r for r in self.requests if (low is None or r.product >= low) and (high is None or r.product <= high)]
                else:
                    self.requests = [r.narrowed(column, low, high) for r in self.requests]
            yield f  # what an archive gives is held against all filters again

    def partitions(self) -> Sequence[Request]:
        return [r for r in self.requests if not r.empty]

    def read(self, partition: Request | None) -> Iterator:
        import pyarrow as pa

        if partition is None:
            return
        got = self.fetch(partition.asked())
        if got is None:
            return
        table = got if isinstance(got, pa.Table) else pa.Table.from_pandas(got, preserve_index=False)
        if "product" in self.schema.names and "product" not in table.column_names:
            table = table.append_column("product", pa.array([partition.product] * table.num_rows, pa.string()))
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from table.select(self.schema.names).cast(to_arrow_schema(self.schema)).to_batches()


def _requests(options: dict, variables: Sequence[str]) -> list[Request]:
    """A request for each product, year and level of the options; products without levels have one a year."""
    south, north, west, east = (float(x) for x in options["box"].split(",")) if "box" in options else Grid().box
    years = [int(y) for y in options["years"].split(",")]
    depths = [float(d) for d in options["depths"].split(",")] if options.get("depths") else [None]
    chosen = tuple(options["variables"].split(",")) if "variables" in options else tuple(variables)
    return [Request(p, chosen, dt.date(y, 1, 1), dt.date(y, 12, 31), south, north, west, east, d, d) for p in options["products"].split(",") for y in years for d in depths]


def register(spark: SparkSession, name: str, schema: str, fetch: Callable[[dict], object]) -> None:
    """Makes an archive a format that spark.read takes, and lets filters reach it.

    Options: products, years and depths (lists with commas; depths may lack), box (south,north,west,east; by default the grid's), variables. fetch runs on the executors.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    fields = T.DataType.fromDDL(schema)
    given = [f.name for f in fields if f.name not in (*ENDS, "product")]
    title = name

    class Archive(D.DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> T.StructType:
            chosen = self.options["variables"].split(",") if "variables" in self.options else given
            return T.StructType([f for f in fields if f.name not in given or f.name in chosen])

        def reader(self, schema: T.StructType) -> SubsetReader:
            return SubsetReader(_requests(self.options, given), schema, fetch)

    spark.dataSource.register(Archive)
