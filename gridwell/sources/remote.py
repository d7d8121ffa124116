"""Fetching from services by plan: a row of the plan is a request, and requests run on executors.

A fetcher is a function of a request (a dict) that returns rows as a pandas DataFrame, or None where the service
has nothing (a gap). Box, levels, times and variables are in the request, so that the service prunes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Grid

Fetcher = Callable[[dict], object]


def requests(plan: DataFrame, grid: Grid, variables: Mapping[str, list[str]]) -> DataFrame:
    """plan (product, first, last and any others) with the box and the product's variables; products without any go."""
    south, north, west, east = grid.box
    names = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in variables.items() for x in (k, list(v))])
    boxed = plan.withColumns({"south": F.lit(south), "north": F.lit(north), "west": F.lit(west), "east": F.lit(east), "variables": names[F.col("product")]})
    return boxed.where(F.col("variables").isNotNull())


def fetch(plan: DataFrame, fetchers: Mapping[str, Fetcher], schema: str, tries: int = 3, wait: float = 1.0, parallel: int = 8) -> DataFrame:
    """The rows of all requests with columns product, status ("ok", "missing", "failed") and detail.

    A gap and a request that failed tries times have one row with nulls for the fetched columns, so that a
    run tells what lacks instead of ending. At most parallel requests run at once.
    """
    fields = T.DataType.fromDDL(schema)
    names = [f.name for f in fields]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for request in frame.to_dict("records"):
                status, detail, rows = "missing", "", None
                for attempt in range(tries):
                    try:
                        rows = fetchers[request["product"]](request)
                        status, detail = ("ok" if rows is not None else "missing"), ""
                        break
                    except Exception as e:  # what a service does is no error of the run
                        status, detail = "failed", f"{type(e).__name__}: {e}"
                        time.sleep(wait * attempt)
                out = rows[names].copy() if status == "ok" else pd.DataFrame([[None] * len(names)], columns=names)
                yield out.assign(product=request["product"], status=status, detail=detail)

    full = T.StructType([*fields, T.StructField("product", T.StringType()), T.StructField("status", T.StringType()), T.StructField("detail", T.StringType())])
    return plan.repartition(parallel).mapInPandas(run, full)
