"""The catalogue: each query runs operators over the test tables, and has a twin in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ACTUAL_DEPTHS, COVERAGE, Axis, Grid, Inputs, expected_days
from ..functions import scalars
from ..operators import audit, features, grids, learning, profiles, scores, series, splits
from ..sources import tables as sources
from . import requests
from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a function as a query by its name; sql may use the tables of tables.SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{T.SQL.strip()} {sql}"
        return f

    return register


def rounded(table: DataFrame, places: int = 4) -> DataFrame:
    return table.withColumns({c: F.round(c, places) + 0.0 for c, kind in table.dtypes if kind == "double"})


def longs(table: DataFrame) -> DataFrame:
    return table.withColumns({c: F.col(c).cast("long") for c, kind in table.dtypes if kind == "int"})


FINE = Grid(Axis(5.0, 7.0, 0.25), Axis(50.0, 52.0, 0.25))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on a grid of 1/12 degree with values, some null."""
    return T.read(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("day"), (F.lit(5.0) + F.col("l_partkey") % 24 / F.lit(12.0)).alias("lat"), (F.lit(50.0) + F.col("l_suppkey") % 24 / F.lit(12.0)).alias("lon"),
        F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity").cast("double")).alias("value"),
    )


POINTS = """, points AS (
    SELECT CAST(l_shipdate AS DATE) AS day, CAST(floor((5.0::DOUBLE + (l_partkey % 24) / 12.0::DOUBLE - 5.0 + 0.125) / 0.25) AS INTEGER) AS lat_i, CAST(floor((50.0::DOUBLE + (l_suppkey % 24) / 12.0::DOUBLE - 50.0 + 0.125) / 0.25) AS INTEGER) AS lon_j,
        CASE WHEN l_orderkey % 17 <> 0 THEN CAST(l_quantity AS DOUBLE) END AS value FROM lineitem
), binned AS (SELECT * FROM points WHERE lat_i BETWEEN 0 AND 8 AND lon_j BETWEEN 0 AND 8)"""

# --- grids ---------------------------------------------------------------------------------------------------------


@query(f"""{POINTS}, seen AS (SELECT lat_i, lon_j, count(*) AS n FROM points WHERE lat_i BETWEEN 0 AND 80 AND lon_j BETWEEN 0 AND 200 GROUP BY ALL)
    SELECT CAST(i AS BIGINT) AS lat_i, CAST(j AS BIGINT) AS lon_j, 5.0::DOUBLE + i * 0.25::DOUBLE AS lat, 50.0::DOUBLE + j * 0.25::DOUBLE AS lon,
    round((5.0::DOUBLE + i * 0.25 - 15.0) / 10.0, 4) AS lat_plane, round((50.0::DOUBLE + j * 0.25 - 75.0) / 25.0, 4) AS lon_plane, COALESCE(n, 0) AS n
    FROM (SELECT unnest(range(0, 81)) AS i), (SELECT unnest(range(0, 201)) AS j) LEFT JOIN seen ON lat_i = i AND lon_j = j""")
def q_grid_dims(spark, sf_dir):
    """All cells of the grid, with how many points lie in each."""
    seen = grids.with_bins(_points(spark, sf_dir), Grid()).groupBy("lat_i", "lon_j").agg(F.count("*").alias("n"))
    return longs(rounded(grids.cells(spark, Grid()).join(seen, ["lat_i", "lon_j"], "left").fillna(0, ["n"])))


_BINNED = "SELECT day, CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, round(avg(value), 4) AS value, count(value) AS n FROM binned GROUP BY ALL"


@query(f"{POINTS} {_BINNED}")
def q_block_average(spark, sf_dir):
    return longs(rounded(grids.block_average(grids.with_bins(_points(spark, sf_dir), FINE), ["day"])))


SOURCE = (Axis(0.0, 7.0, 1.0), Axis(0.0, 7.0, 1.0))
TARGETS = Grid(Axis(0.0, 7.5, 0.25), Axis(0.0, 7.5, 0.25))


def _source(spark, sf_dir):
    own = T.cube(spark, sf_dir).groupBy(F.col("year").alias("year"), F.col("lat_i").alias("src_i"), F.col("lon_j").alias("src_j")).agg(F.sum("value").alias("value"))
    return own.withColumn("value", F.when((F.col("src_i") * 3 + F.col("src_j") * 5 + F.col("year")) % 11 != 0, F.col("value")))


@query("""
    , src AS (SELECT year, si, sj, CASE WHEN (si * 3 + sj * 5 + year) % 11 <> 0 THEN total END AS value FROM (SELECT year, lat_i AS si, lon_j AS sj, sum(value) AS total FROM cube GROUP BY year, lat_i, lon_j)),
    tgt AS (SELECT i, j, i * 0.25::DOUBLE AS y, j * 0.25::DOUBLE AS x FROM (SELECT unnest(range(0, 31)) AS i), (SELECT unnest(range(0, 31)) AS j)),
    low AS (SELECT *, least(floor(y), 6) AS i0, least(floor(x), 6) AS j0 FROM tgt WHERE y <= 7 AND x <= 7),
    corner AS (SELECT *, unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b FROM low),
    wts AS (SELECT i, j, i0 + a AS si, j0 + b AS sj, (CASE a WHEN 1 THEN y - i0 ELSE 1 - (y - i0) END) * (CASE b WHEN 1 THEN x - j0 ELSE 1 - (x - j0) END) AS w,
        (CASE WHEN y - i0 > 0.5 THEN 1 ELSE 0 END) = a AND (CASE WHEN x - j0 > 0.5 THEN 1 ELSE 0 END) = b AS nearest FROM corner)
    SELECT CAST(year AS BIGINT) AS year, CAST(i AS BIGINT) AS lat_i, CAST(j AS BIGINT) AS lon_j,
        round(COALESCE(CASE WHEN count(value) = 4 THEN sum(w * value) END, max(CASE WHEN nearest THEN value END)), 4) AS value, count(value) AS n
    FROM wts JOIN src USING (si, sj) GROUP BY ALL""")
def q_bilinear_nn(spark, sf_dir):
    targets = grids.cells(spark, TARGETS)
    return longs(rounded(grids.bilinear(_source(spark, sf_dir), grids.stencil(targets, *SOURCE), ["year"])))


def _mask(spark, sf_dir):
    sparse = T.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 8).cast("int").alias("lat_i"), (F.col("l_suppkey") % 8).cast("int").alias("lon_j"), F.when((F.col("l_partkey") + F.col("l_suppkey") * 3) % 7 > 2, F.col("l_quantity")).alias("value"))
    return grids.land_mask(sparse, grids.cells(spark, Grid(Axis(0.0, 8.0, 1.0), Axis(0.0, 8.0, 1.0))), share=0.57)


MASK = """, mask AS (
    SELECT i AS lat_i, j AS lon_j, COALESCE(ocean, FALSE) AS ocean FROM (SELECT unnest(range(0, 9)) AS i), (SELECT unnest(range(0, 9)) AS j)
    LEFT JOIN (SELECT l_partkey % 8 AS a, l_suppkey % 8 AS b, count(CASE WHEN (l_partkey + l_suppkey * 3) % 7 > 2 THEN 1 END) / count(*) >= 0.57 AS ocean FROM lineitem GROUP BY ALL) ON a = i AND b = j
)"""


@query(f"{MASK} SELECT CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, ocean FROM mask")
def q_land_mask(spark, sf_dir):
    return longs(_mask(spark, sf_dir))


@query(f"""{MASK}, parts AS (SELECT * FROM (VALUES ('all', 0.0, 8.0), ('quarter1', 0.0, 2.0), ('quarter2', 2.0, 4.0), ('quarter3', 4.0, 6.0), ('quarter4', 6.0, 8.0), ('west', 0.0, 3.0), ('east', 4.0, 8.0)) p(part, a, b))
    SELECT part, round(avg(CASE WHEN ocean THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS share, count(*) AS cells FROM parts JOIN mask ON lon_j BETWEEN a AND b GROUP BY part""")
def q_ocean_fraction(spark, sf_dir):
    return rounded(grids.ocean_fractions(_mask(spark, sf_dir), 9))


@query(f"{MASK} SELECT CAST(year AS BIGINT) AS year, count(*) AS n, count(CASE WHEN ocean THEN value END) AS kept, round(sum(CASE WHEN ocean THEN value END), 4) AS total FROM cube LEFT JOIN mask USING (lat_i, lon_j) GROUP BY year")
def q_apply_mask(spark, sf_dir):
    masked = grids.apply_mask(T.cube(spark, sf_dir), _mask(spark, sf_dir), ["value"])
    return longs(rounded(masked.groupBy("year").agg(F.count("*").alias("n"), F.count("value").alias("kept"), F.sum("value").alias("total"))))


# --- calendars -----------------------------------------------------------------------------------------------------


@query("""SELECT product, CAST(y AS BIGINT) AS year, greatest(0, date_diff('day', greatest(make_date(y, 1, 1), s, DATE '1993-01-01'), least(make_date(y, 12, 31), e, DATE '2024-12-15')) + 1) AS days, held
    FROM (VALUES ('era5', DATE '1940-01-01', DATE '2026-06-30'), ('glorys', DATE '1993-01-01', DATE '2026-06-23'), ('oisst', DATE '1981-09-01', DATE '2026-06-30'), ('sla', DATE '1993-01-01', DATE '2026-01-16'), ('sss', DATE '1993-01-01', DATE '2024-12-15')) p(product, s, e),
    (SELECT CAST(year(day) AS INTEGER) AS y, count(*) AS held FROM daily GROUP BY 1)""")
def q_calendar_expected_days(spark, sf_dir):
    """The days that each product should have in the years of the orders, and how many days have orders."""
    held = T.daily(spark, sf_dir).groupBy(F.year("day").alias("year")).agg(F.count("*").alias("held"))
    rows = [(p, r.year, expected_days(r.year, p)) for p in COVERAGE for r in held.select("year").collect()]  # a row per year
    return longs(spark.createDataFrame(rows, "product string, year int, days long").join(held, "year"))


@query("SELECT days.day FROM days ANTI JOIN daily USING (day)")
def q_coverage_missing(spark, sf_dir):
    own = T.daily(spark, sf_dir)
    return audit.missing_keys(T.calendar(spark, own).select("day"), own, ["day"])


@query("SELECT day, CAST(count(*) AS BIGINT) AS n, CAST(max(value) AS DOUBLE) AS value FROM daily WHERE day IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem) AND day IN (SELECT day FROM cube WHERE lat_i = 0) AND day BETWEEN DATE '1995-01-01' AND DATE '2000-12-31' GROUP BY day")
def q_align_days(spark, sf_dir):
    import datetime as dt

    own, cube = T.daily(spark, sf_dir), T.cube(spark, sf_dir)
    days = series.common_days(own, cube, cube.where("lat_i = 0"), first=dt.date(1995, 1, 1), last=dt.date(2000, 12, 31))
    return series.align(own, days).groupBy("day").agg(F.count("*").alias("n"), F.max("value").alias("value"))


@query("SELECT before AS after, day AS next, CAST(date_diff('day', before, day) - 1 AS BIGINT) AS missing FROM (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM daily) WHERE date_diff('day', before, day) <> 1")
def q_gap_report(spark, sf_dir):
    return longs(series.gaps(T.daily(spark, sf_dir)))


@query("SELECT min(day) AS first, max(day) AS last, count(*) AS n FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS run FROM daily) GROUP BY run")
def q_islands(spark, sf_dir):
    return series.islands(T.daily(spark, sf_dir))


@query("""SELECT event_type, count(*) AS n, CAST(min(s) AS BIGINT) AS least, CAST(max(s) AS BIGINT) AS most, count(*) - count(DISTINCT ts) AS repeated, COALESCE(min(s) = max(s) AND min(s) IN (3600, 86400), FALSE) AS regular
    FROM (SELECT event_type, ts, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - CAST(floor(epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) / 1000000) AS BIGINT) AS s FROM events) GROUP BY event_type""")
def q_time_steps(spark, sf_dir):
    return series.uneven_steps(T.read(spark, sf_dir, "events"), "ts", ["event_type"])


@query("""SELECT day, CAST(date_diff('day', DATE '1950-01-01', day) AS BIGINT) AS days, CAST(date_diff('day', DATE '1950-01-01', day) AS DOUBLE) * 24 AS hours, CAST(date_diff('day', DATE '1950-01-01', day) AS DOUBLE) * 86400 AS seconds, TRUE AS same,
    round(sin(2 * pi() / 365.25 * doy), 4) AS season_sin, round(cos(2 * pi() / 365.25 * doy), 4) AS season_cos, year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0) AS leap FROM days""")
def q_time_codes(spark, sf_dir):
    days = T.calendar(spark, T.daily(spark, sf_dir))
    code = {u: scalars.encode_time(F.col("day"), f"{u} since 1950-01-01") for u in ("days", "hours", "seconds")}
    same = F.lit(True)
    for u, c in code.items():
        same = same & (F.to_date(scalars.decode_time(c, f"{u} since 1950-01-01")) == F.col("day"))
    sine, cosine = scalars.season(F.col("day"))
    return longs(days.select("day", *[c.alias(u) for u, c in code.items()], same.alias("same"), F.round(sine, 4).alias("season_sin"), F.round(cosine, 4).alias("season_cos"), scalars.is_leap_year(F.col("year")).alias("leap")))


# --- statistics and climatology --------------------------------------------------------------------------------------


@query("SELECT CAST(year AS BIGINT) AS year, count(value) AS n, round(avg(value), 4) AS mean, round(CASE WHEN count(value) < 2 THEN 1.0 ELSE sqrt(greatest(var_pop(value), 1e-20)) END, 4) AS std FROM cube GROUP BY year")
def q_moments(spark, sf_dir):
    return longs(rounded(series.moments(T.cube(spark, sf_dir), ["year"])))


@query("SELECT count(value) AS n, round(avg(value), 4) AS mean, round(sqrt(var_pop(value)), 4) AS std FROM cube")
def q_merged_moments(spark, sf_dir):
    whole = series.merge_moments(series.accumulated(T.cube(spark, sf_dir), ["year"]), [])
    return rounded(whole.select("n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std")))


_Z = "(SELECT avg(l_quantity) AS mq, sqrt(var_pop(l_quantity)) AS sq, avg(l_tax) AS mt, sqrt(var_pop(l_tax)) AS st FROM lineitem)"


@query(f"""SELECT l_linenumber, count(*) AS n, round(sum(CASE WHEN l_orderkey % 17 = 0 THEN 0 ELSE (l_quantity - mq) / sq END), 4) AS quantity, count(CASE WHEN l_orderkey % 13 <> 0 THEN 1 END) AS taxed, round(sum(CASE WHEN l_orderkey % 13 <> 0 THEN (l_tax - mt) / st END), 4) AS tax
    FROM lineitem, {_Z} GROUP BY l_linenumber""")
def q_zscore_zero_fill(spark, sf_dir):
    lines = T.read(spark, sf_dir, "lineitem")
    stats = {r["var"]: (r["mean"], r["std"]) for r in series.moments(series.long_form(lines, [], ["l_quantity", "l_tax"]), ["var"]).collect()}
    holes = lines.withColumn("l_quantity", F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity").cast("double"))).withColumn("l_tax", F.when(F.col("l_orderkey") % 13 != 0, F.col("l_tax")))
    filled = series.zero_filled(series.standardise(holes, stats), ["l_quantity"])
    return rounded(filled.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.count("l_tax").alias("taxed"), F.sum("l_tax").alias("tax")))


@query("SELECT CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, CAST(doy AS BIGINT) AS doy, round(clim, 4) AS clim, n FROM doym")
def q_doy_climatology(spark, sf_dir):
    return longs(rounded(series.doy_means(T.split_cube(spark, sf_dir).where("split = 'train'"), series.CELL)))


@query("""SELECT CAST(d AS BIGINT) AS doy, CAST(COALESCE(min(n), 0) AS BIGINT) AS n FROM (SELECT unnest(range(1, 367)) AS d)
    LEFT JOIN (SELECT lat_i, lon_j, doy, count(*) AS n FROM cube WHERE split = 'train' AND doy NOT BETWEEN 200 AND 209 GROUP BY ALL) ON d = doy GROUP BY d HAVING COALESCE(min(n), 0) < 3""")
def q_thin_days(spark, sf_dir):
    train = T.split_cube(spark, sf_dir).where("split = 'train' AND doy NOT BETWEEN 200 AND 209")  # ten days of the year have no row
    return longs(series.thin_days(series.doy_means(train, series.CELL), 3))


@query("SELECT CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, CAST(doy AS BIGINT) AS doy, round(clim, 4) AS clim FROM smooth")
def q_circular_smooth(spark, sf_dir):
    return longs(rounded(T.smooth_climatology(spark, sf_dir).select("lat_i", "lon_j", "doy", "clim")))


@query("SELECT day, CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, round(anom, 4) + 0.0 AS anom, round(clim + anom * 2 + 1, 4) + 0.0 AS back FROM anoms")
def q_anomaly(spark, sf_dir):
    own = T.cube_anomalies(spark, sf_dir)
    return longs(rounded(own.select("day", "lat_i", "lon_j", "anom", series.absolute(F.col("anom"), F.col("clim"), 2.0, 1.0).alias("back"))))


@query("SELECT CAST(lat_i AS BIGINT) AS lat_i, count(anom) AS n, round(avg(anom), 4) + 0.0 AS mean, round(sqrt(greatest(var_pop(anom), 1e-20)), 4) AS std FROM anoms WHERE split = 'train' GROUP BY lat_i")
def q_anomaly_stats(spark, sf_dir):
    return longs(rounded(series.moments(T.cube_anomalies(spark, sf_dir).where("split = 'train'"), ["lat_i"], "anom")))


@query("""SELECT CAST(lat_i AS BIGINT) AS lat_i, round(a / s, 4) AS anom_std, round(a / s * s, 4) AS scale, round(100 * (1 - (a / s) * (a / s)), 4) AS share
    FROM (SELECT lat_i, stddev_pop(value) AS s, stddev_pop(anom) AS a FROM anoms WHERE split = 'train' GROUP BY lat_i)""")
def q_seasonal_share(spark, sf_dir):
    train = T.cube_anomalies(spark, sf_dir).where("split = 'train'")
    whole = series.moments(train, ["lat_i"])
    scaled = train.join(whole.select("lat_i", "std"), "lat_i").withColumn("z", F.col("anom") / F.col("std"))
    return longs(rounded(series.seasonal_share(series.moments(scaled, ["lat_i"], "z"), whole, ["lat_i"])))


def _rm(w: int) -> str:
    return f"CASE WHEN row_number() OVER (PARTITION BY lat_i, lon_j ORDER BY t) < {w} THEN 0.0 ELSE sum(anom) OVER (PARTITION BY lat_i, lon_j ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) / {w}.0 END"


@query(f"SELECT day, CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, round({_rm(30)}, 4) + 0.0 AS rm30 FROM anoms")
def q_running_mean_w30(spark, sf_dir):
    return longs(rounded(series.running_mean(T.cube_anomalies(spark, sf_dir), series.CELL, 30).select("day", "lat_i", "lon_j", "rm30")))


@query(f"SELECT day, CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, round({_rm(90)}, 4) + 0.0 AS rm90 FROM anoms")
def q_running_mean_w90(spark, sf_dir):
    return longs(rounded(series.running_mean(T.cube_anomalies(spark, sf_dir), series.CELL, 90).select("day", "lat_i", "lon_j", "rm90")))


@query(f"""SELECT CAST(w AS BIGINT) AS w, count(m) AS n, round(avg(m), 4) AS mean, round(sqrt(var_pop(m)), 4) AS std, round(sqrt(var_pop(m)) / sqrt(var_pop(anom)), 4) AS ratio
    FROM (SELECT anom, t, unnest([30, 90]) AS w, unnest([rm30, rm90]) AS m FROM (SELECT anom, t, split, {_rm(30)} AS rm30, {_rm(90)} AS rm90 FROM anoms) WHERE split = 'train' AND t >= 89) GROUP BY w""")
def q_rm_stats(spark, sf_dir):
    own = T.cube_anomalies(spark, sf_dir)
    for w in (30, 90):
        own = series.running_mean(own, series.CELL, w)
    history = Inputs((0, 3, 7), (30, 90)).history
    return longs(rounded(series.window_stats(own.where((F.col("split") == "train") & (F.col("t") >= history)), [30, 90])))


@query("SELECT day, value AS value_lag0, lag(value, 3) OVER (ORDER BY t) AS value_lag3, lag(value, 7) OVER (ORDER BY t) AS value_lag7 FROM dense")
def q_lags(spark, sf_dir):
    return series.lagged(T.dense(spark, sf_dir), [], [0, 3, 7], ["value"]).select("day", "value_lag0", "value_lag3", "value_lag7")


# --- splits ----------------------------------------------------------------------------------------------------------


def _labelled(spark, sf_dir, mode=T.MODE):
    return splits.day_labels(T.calendar(spark, T.daily(spark, sf_dir)), mode, 7)


@query("SELECT day, CAST(t AS BIGINT) AS t, CAST(year AS BIGINT) AS year, CAST(doy AS BIGINT) AS doy, split FROM labelled")
def q_day_labels(spark, sf_dir):
    return longs(_labelled(spark, sf_dir).select("day", "t", "year", "doy", "split"))


@query("SELECT CAST(b.t AS BIGINT) AS t, b.split, CAST(min(abs(b.t - h.t)) AS BIGINT) AS distance FROM labelled b, labelled h WHERE b.split = 'buffer' AND h.split IN ('val', 'test') GROUP BY b.t, b.split")
def q_buffer_days(spark, sf_dir):
    return longs(splits.buffer_distance(_labelled(spark, sf_dir)))


@query("SELECT split, CAST(min(t) AS BIGINT) AS start, CAST(max(t) + 1 AS BIGINT) AS stop FROM (SELECT t, split, t - row_number() OVER (PARTITION BY split ORDER BY t) AS run FROM labelled) GROUP BY split, run")
def q_split_blocks(spark, sf_dir):
    return longs(splits.blocks(_labelled(spark, sf_dir)))


@query("SELECT split, count(*) AS n, CAST(min(t) AS BIGINT) AS first, CAST(max(t) AS BIGINT) AS last FROM labelled WHERE t >= 89 GROUP BY split")
def q_split_indices(spark, sf_dir):
    chosen = splits.split_rows(_labelled(spark, sf_dir), "any", Inputs().history)
    return longs(chosen.groupBy("split").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")))


_REACHED = "SELECT DISTINCT unnest([t, t - 3, t - 7]) AS t FROM marked WHERE own = '{}' AND t >= 7"


@query(f""", r AS (SELECT 'train' AS s, t FROM ({_REACHED.format("train")}) UNION ALL SELECT 'val', t FROM ({_REACHED.format("val")}) UNION ALL SELECT 'test', t FROM ({_REACHED.format("test")}))
    SELECT a.s AS a, b.s AS b, count(CASE WHEN a.t = b.t THEN 1 END) AS shared FROM r a JOIN r b ON (a.s, b.s) IN (('train', 'val'), ('train', 'test'), ('val', 'test')) AND a.t = b.t GROUP BY ALL""")
def q_split_leakage(spark, sf_dir):
    """Days that the inputs of two splits share where no buffer parts them."""
    labelled = _labelled(spark, sf_dir, T.PLAIN_MODE)
    reached = {s: splits.reached(splits.split_rows(labelled, s, 7), (0, 3, 7)) for s in splits.NAMES}
    return splits.shared_days(**reached).where("shared > 0")


@query("SELECT split, count(*) AS n, min(day) AS first, max(day) AS last FROM labelled GROUP BY split")
def q_split_summary(spark, sf_dir):
    return splits.summary(_labelled(spark, sf_dir))


@query("SELECT DISTINCT CAST(year AS BIGINT) AS year, own AS split FROM marked")
def q_split_years(spark, sf_dir):
    return longs(splits.split_years(T.calendar(spark, T.daily(spark, sf_dir)), T.MODE))


@query("SELECT CAST(t AS BIGINT) AS t, row_number() OVER (ORDER BY t) - 1 AS place, (row_number() OVER (ORDER BY t) - 1) // 16 AS batch FROM labelled WHERE split = 'train' AND t >= 89")
def q_batches(spark, sf_dir):
    return longs(splits.batches(splits.split_rows(_labelled(spark, sf_dir), "train", Inputs().history).select("t"), 16))


# --- profiles --------------------------------------------------------------------------------------------------------


def _levels(spark, sf_dir):
    return profiles.tidy_levels(T.raw_levels(spark, sf_dir))


@query("SELECT prof_key, round(lat, 4) AS lat, round(lon, 4) AS lon, round(pres, 4) AS pres, round(temp, 4) AS temp, adjusted, CAST(epoch_us(time) AS BIGINT) AS micros FROM levels")
def q_argo_qc(spark, sf_dir):
    return rounded(_levels(spark, sf_dir).select("prof_key", "lat", "lon", "pres", "temp", "adjusted", F.unix_micros("time").alias("micros")))


@query("SELECT pres, lat, round(depth_m, 4) AS depth_m FROM deep")
def q_depth_from_pressure(spark, sf_dir):
    return _levels(spark, sf_dir).select("pres", "lat", F.round("depth_m", 4).alias("depth_m"))


@query("SELECT DISTINCT prof_key, CAST(dense_rank() OVER (ORDER BY prof_key) - 1 AS BIGINT) AS profile_id, platform, CAST(cycle AS BIGINT) AS cycle FROM levels")
def q_profile_ids(spark, sf_dir):
    return longs(profiles.profiles(_levels(spark, sf_dir), ("platform", "cycle")))


#: Eight by eight cells over the levels' places, as the stand-in has.
COARSE = Grid(Axis(5.0, 26.0, 3.0), Axis(50.0, 102.5, 7.5))


@query("""SELECT prof_key, round(depth_m, 4) AS depth_m, CAST(d.depth_k AS BIGINT) AS depth_k, round(c.value, 4) AS grid_value
    FROM (SELECT *, CAST(floor((lat - 5.0 + 1.5) / 3.0) AS INTEGER) AS li, CAST(floor((lon - 50.0 + 3.75) / 7.5) AS INTEGER) AS lj, CASE WHEN depth_m <= 150 THEN 0 WHEN depth_m <= 500 THEN 1 ELSE 2 END AS depth_k FROM deep) d
    JOIN (SELECT t % 5 AS n, lat_i, lon_j, depth_k, avg(truth) AS value FROM predictions GROUP BY ALL) c ON c.depth_k = d.depth_k AND li = lat_i AND lj = lon_j AND CAST(floor(juld) AS INTEGER) = 27028 + n""")
def q_argo_colocate(spark, sf_dir):
    """Levels beside the mean of all months of the stand-in, dealt to the five days that the levels have."""
    day = F.date_add(F.lit("1950-01-01").cast("date"), F.lit(27028) + F.col("t") % 5)
    cube = T.predictions(spark, sf_dir).groupBy(day.alias("day"), "lat_i", "lon_j", "depth_k").agg(F.avg("truth").alias("value"))
    met = profiles.colocated(_levels(spark, sf_dir), cube, COARSE, [0.0, 300.0, 700.0])
    return longs(rounded(met.select("prof_key", "depth_m", "depth_k", "grid_value")))


# --- features --------------------------------------------------------------------------------------------------------

SMALL = Inputs((0, 3), (30,), ("sst", "sla"))


def _features(spark, sf_dir, inputs):
    own = T.dense(spark, sf_dir).select("t", "day", F.col("value").alias("sst"), (F.col("value") * 2 + 1).alias("sla"), F.col("value").alias("anom"))
    own = series.lagged(own, [], inputs.lags, inputs.variables)
    for w in inputs.windows:
        for v in inputs.variables:
            own = series.running_mean(own, [], w, v).withColumnRenamed(f"rm{w}", f"{v}_rm{w}")
    own = features.with_season(own).withColumns({"ocean": F.lit(1.0), "lat_plane": F.lit(0.5), "lon_plane": F.lit(-0.5)})
    return features.channels(own.where(F.col("t") >= inputs.history), inputs, ["day"])


def _feature_sql(variables: dict[str, str]) -> str:
    parts = [x for n in (0, 3) for x in [f"lag({v}, {n}) OVER (ORDER BY t)" for v in variables.values()]] + [f"sum({v}) OVER (ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) / 30" for v in variables.values()]
    parts += ["1.0", "0.5", "-0.5", "sin(2 * pi() / 365.25 * doy)", "cos(2 * pi() / 365.25 * doy)"]
    return f"SELECT day, CAST({len(parts)} AS BIGINT) AS n, {', '.join(f'round(CAST(CAST({p} AS FLOAT) AS DOUBLE), 3) AS x{i}' for i, p in enumerate(parts))} FROM dense QUALIFY t >= 29"


def _flat(samples, n):
    return samples.select("day", F.size("x").cast("long").alias("n"), *[F.round(F.col("x")[i].cast("double"), 3).alias(f"x{i}") for i in range(n)])


@query(_feature_sql({"sst": "value", "sla": "(value * 2 + 1)"}))
def q_features(spark, sf_dir):
    return _flat(_features(spark, sf_dir, SMALL), SMALL.channels)


@query(_feature_sql({"sla": "(value * 2 + 1)"}))
def q_feature_subset(spark, sf_dir):
    only = SMALL.only(["sla"])
    return _flat(_features(spark, sf_dir, only), only.channels)


@query("SELECT CAST(t AS BIGINT) AS t, CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, " + ", ".join(f"round(max(CASE WHEN depth_k = {k} THEN truth END), 4) AS y{k}" for k in range(7)) + " FROM predictions GROUP BY t, lat_i, lon_j")
def q_profile_arrays(spark, sf_dir):
    wide = features.profile_arrays(T.predictions(spark, sf_dir), ["t", "lat_i", "lon_j"], 7, "truth")
    return longs(rounded(wide.select("t", "lat_i", "lon_j", *[F.col("y")[k].alias(f"y{k}") for k in range(7)])))


# --- scores ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(t AS BIGINT) AS t, CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, CAST(depth_k AS BIGINT) AS depth_k, round(d_truth, 4) AS d_truth, round(d_pred, 4) AS d_pred FROM steps")
def q_depth_pairs(spark, sf_dir):
    steps = scores.level_steps(T.predictions(spark, sf_dir), ("t", "lat_i", "lon_j"), ("truth", "pred"))
    return longs(rounded(steps.select("t", "lat_i", "lon_j", "depth_k", "d_truth", "d_pred")))


@query("""SELECT of, round(avg(warm), 4) AS all_pairs, round(avg(CASE WHEN gate > 0 THEN warm END), 4) AS gated, count(warm) AS n
    FROM (SELECT gate, unnest(['truth', 'pred']) AS of, unnest([CAST(d_truth > 0 AS INTEGER)::DOUBLE, CAST(d_pred > 0 AS INTEGER)::DOUBLE]) AS warm FROM steps JOIN gate USING (depth_k)) GROUP BY of""")
def q_violation_rate(spark, sf_dir):
    steps = scores.level_steps(T.predictions(spark, sf_dir), ("t", "lat_i", "lon_j"), ("truth", "pred"))
    return rounded(scores.violations(steps, T.gate(spark), ("truth", "pred")))


@query("SELECT CAST(t AS BIGINT) AS t, round(sum((truth - pred) * (truth - pred)) / 448.0, 4) AS loss FROM predictions GROUP BY t")
def q_masked_mse(spark, sf_dir):
    return longs(rounded(scores.masked_mse(T.predictions(spark, sf_dir), 448)))


@query("""SELECT CAST(t AS BIGINT) AS t, round(loss + 0.5 * COALESCE(physics, 0), 4) AS loss FROM (SELECT t, sum((truth - pred) * (truth - pred)) / 448.0 AS loss FROM predictions GROUP BY t)
    LEFT JOIN (SELECT t, sum(gate * greatest(0.0, d_pred) * greatest(0.0, d_pred)) / 166.4 AS physics FROM steps JOIN gate USING (depth_k) GROUP BY t) USING (t)""")
def q_combined_loss(spark, sf_dir):
    return longs(rounded(scores.combined_loss(T.predictions(spark, sf_dir), T.gate(spark), 448, 166.4, 0.5)))


@query("SELECT round(avg((pred - truth) * (pred - truth)), 3) AS mse, round(avg(abs(pred - truth)), 4) AS mae, round(sqrt(avg(4.0 * (pred - truth) * (pred - truth))), 4) AS rmse_scaled, count(*) AS n FROM predictions")
def q_masked_rmse_mae(spark, sf_dir):
    return rounded(scores.pooled_errors(T.predictions(spark, sf_dir), 2.0)).withColumn("mse", F.round("mse", 3))


_METRICS = ["sigma", "rmse", "mae", "bias", "pearson_r", "anomaly_corr", "anom_sd_ratio", "rmse_clim", "skill"]


@query(f"SELECT CAST(depth_k AS BIGINT) AS depth_k, n_cells, {', '.join(f'round({c}, 4) AS {c}' for c in _METRICS)} FROM metrics")
def q_depth_metrics(spark, sf_dir):
    return longs(rounded(scores.level_metrics(T.predictions(spark, sf_dir))))


_LINEAR = ["mae", "bias", "pearson_r", "anomaly_corr", "anom_sd_ratio", "skill"]


@query(f"SELECT CAST(sum(n_cells) AS BIGINT) AS n_cells, {', '.join(f'round(sqrt(sum({c} * {c} * n_cells) / sum(n_cells)), 4) AS {c}' for c in ('rmse', 'rmse_clim'))}, {', '.join(f'round(CASE WHEN count({c}) = count(*) THEN sum({c} * n_cells) / sum(n_cells) END, 4) AS {c}' for c in _LINEAR)} FROM metrics")
def q_overall_metrics(spark, sf_dir):
    return rounded(scores.overall(scores.level_metrics(T.predictions(spark, sf_dir))))


@query("SELECT CAST(depth_k AS BIGINT) AS depth_k, count(DISTINCT lat_i * 8 + lon_j) AS cells, CAST(64 AS BIGINT) AS expected, count(DISTINCT lat_i * 8 + lon_j) = 64 AS passed FROM predictions GROUP BY depth_k")
def q_valid_counts(spark, sf_dir):
    own = T.predictions(spark, sf_dir).groupBy("depth_k").agg(F.count_distinct("lat_i", "lon_j").alias("cells"))
    return longs(own.withColumn("expected", F.lit(64)).withColumn("passed", F.col("cells") == F.col("expected")))


@query("SELECT *, round(1 / (1 + exp(-x)), 4) AS sigmoid, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 4) AS softplus, round(x / (1 + exp(-x)), 4) AS swish, round(greatest(0.0, x), 4) AS relu, round(pow(greatest(0.0, x + 0.5), 2), 4) AS hinge FROM (SELECT DISTINCT (l_quantity - 25) / 5.0::DOUBLE AS x FROM lineitem)")
def q_activations(spark, sf_dir):
    x = F.col("x")
    own = T.read(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 25) / F.lit(5.0)).alias("x")).distinct()
    return own.select("x", *[F.round(f, 4).alias(n) for n, f in (("sigmoid", scalars.sigmoid(x)), ("softplus", scalars.softplus(x)), ("swish", scalars.swish(x)), ("relu", scalars.relu(x)), ("hinge", scalars.squared_hinge(x, 0.5)))])


@query("""SELECT q AS raw, round(q, 4) AS y0, round((q * 2 + 10 - sp - 9) / 3, 4) AS y1, round((q * 2 + 10 - sp - sp - 8) / 4, 4) AS y2
    FROM (SELECT q, greatest(q, 0) + ln(1 + exp(-abs(q))) AS sp FROM (SELECT DISTINCT l_quantity / 10.0::DOUBLE AS q FROM lineitem))""")
def q_monotonic_profile(spark, sf_dir):
    own = T.read(spark, sf_dir, "lineitem").select((F.col("l_quantity") / F.lit(10.0)).alias("raw")).distinct()
    levels = scalars.monotonic_profile(F.array("raw", "raw", "raw"), [10.0, 9.0, 8.0], [2.0, 3.0, 4.0], 0)
    return own.withColumn("y", levels).select("raw", *[F.round(F.col("y")[k], 4).alias(f"y{k}") for k in range(3)])


# --- audit -----------------------------------------------------------------------------------------------------------


@query("""SELECT var, count(CASE WHEN x IS NULL THEN 1 END) AS nulls, count(CASE WHEN isnan(x) THEN 1 END) AS nans, count(CASE WHEN isinf(x) THEN 1 END) AS infinite, min(CASE WHEN isfinite(x) THEN x END) AS least, max(CASE WHEN isfinite(x) THEN x END) AS most, count(CASE WHEN isfinite(x) AND abs(x) > 25 THEN 1 END) AS beyond
    FROM (SELECT unnest(['q', 'r']) AS var, unnest([CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity::DOUBLE END, CASE WHEN l_orderkey % 19 = 0 THEN 'nan'::DOUBLE WHEN l_orderkey % 23 = 0 THEN 'inf'::DOUBLE ELSE l_tax END]) AS x FROM lineitem) GROUP BY var""")
def q_value_profile(spark, sf_dir):
    lines = T.read(spark, sf_dir, "lineitem")
    own = lines.select(F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity").cast("double")).alias("q"), F.when(F.col("l_orderkey") % 19 == 0, F.lit(float("nan"))).when(F.col("l_orderkey") % 23 == 0, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("r"))
    return audit.value_profile(own, ["q", "r"])


@query("SELECT CAST(year AS BIGINT) AS year, count(DISTINCT day) AS days, min(day) AS first, max(day) AS last, CAST(0 AS BIGINT) AS repeated, count(value) AS finite, count(CASE WHEN NOT value BETWEEN 1 AND 100 THEN 1 END) AS value_beyond, count(value) > 3000 AS enough FROM cube GROUP BY year")
def q_year_checkpoint_audit(spark, sf_dir):
    return longs(audit.year_audit(T.cube(spark, sf_dir), ["value"], 3000, {"value": (1, 100)}))


@query("""SELECT var, round(mean, 4) AS mean, round(std, 4) AS std, COALESCE(mean BETWEEN lo AND hi AND std BETWEEN slo AND shi AND std > 0, FALSE) AS passed FROM (VALUES ('l_quantity', 20.0, 30.0, 10.0, 20.0), ('l_tax', 0.0, 0.01, 0.0, 1.0), ('absent', 0.0, 1.0, 0.0, 1.0)) b(var, lo, hi, slo, shi)
    LEFT JOIN (SELECT 'l_quantity' AS var, avg(l_quantity) AS mean, sqrt(var_pop(l_quantity)) AS std FROM lineitem UNION ALL SELECT 'l_tax', avg(l_tax), sqrt(var_pop(l_tax)) FROM lineitem) USING (var)""")
def q_stats_plausibility(spark, sf_dir):
    rows = [("l_quantity", 20.0, 30.0, 10.0, 20.0), ("l_tax", 0.0, 0.01, 0.0, 1.0), ("absent", 0.0, 1.0, 0.0, 1.0)]
    bounds = spark.createDataFrame(rows, "var string, mean_lo double, mean_hi double, std_lo double, std_hi double")
    return rounded(audit.stats_plausibility(series.moments(series.long_form(T.read(spark, sf_dir, "lineitem"), [], ["l_quantity", "l_tax"]), ["var"]), bounds))


_HOLES = "(SELECT DISTINCT split, lat_i, lon_j FROM cube WHERE (lat_i * 5 + lon_j + CASE WHEN split = 'test' THEN 1 ELSE 0 END) % 6 = 0)"


@query(f"SELECT CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j FROM {_HOLES} WHERE split IN ('train', 'test') GROUP BY lat_i, lon_j HAVING count(*) = 1")
def q_mask_consistency(spark, sf_dir):
    shift = (F.col("split") == "test").cast("int")
    holes = T.split_cube(spark, sf_dir).withColumn("value", F.when((F.col("lat_i") * 5 + F.col("lon_j") + shift) % 6 != 0, F.col("value")))
    return longs(audit.same_null_places(audit.null_places(holes, "split"), "split", "train", "test"))


@query("""SELECT CAST(lat_i AS BIGINT) AS lat_i, round(max(CASE WHEN day = lo THEN share END), 4) AS first, round(max(CASE WHEN day = hi THEN share END), 4) AS last
    FROM (SELECT lat_i, day, avg(CASE WHEN lon_j % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS share, min(day) OVER (PARTITION BY lat_i) AS lo, max(day) OVER (PARTITION BY lat_i) AS hi FROM cube GROUP BY lat_i, day) GROUP BY lat_i""")
def q_edge_shares(spark, sf_dir):
    own = T.cube(spark, sf_dir).withColumn("value", F.when(F.col("lon_j") % 3 != 0, F.col("value")))
    return longs(rounded(audit.edge_shares(own, ["lat_i"])))


@query("SELECT o_orderpriority AS source, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS ok, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS missing, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS failed FROM orders GROUP BY 1")
def q_status_counts(spark, sf_dir):
    own = T.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "missing").when(F.col("o_orderstatus") == "P", "failed").alias("status"))
    return audit.status_counts(own)


@query("SELECT CAST(year AS BIGINT) AS year, count(CASE WHEN d.day IS NULL THEN 1 END) AS missing, count(CASE WHEN d.day IS NULL THEN 1 END) = 0 AS ready FROM days LEFT JOIN daily d USING (day) GROUP BY year")
def q_year_ready(spark, sf_dir):
    own = T.daily(spark, sf_dir)
    return longs(audit.ready(T.calendar(spark, own), own, ["day"]))


@query("""SELECT 'no gaps' AS rule, (SELECT count(*) FROM days ANTI JOIN daily USING (day)) = 0 AS passed, CAST((SELECT count(*) FROM days ANTI JOIN daily USING (day)) AS VARCHAR) AS detail
    UNION ALL SELECT 'days once', TRUE, CAST((SELECT count(*) FROM daily) AS VARCHAR) UNION ALL SELECT 'ids once', (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders), '' """)
def q_ledger(spark, sf_dir):
    own = T.daily(spark, sf_dir)
    return audit.ledger(
        audit.nothing(audit.missing_keys(T.calendar(spark, own), own, ["day"]), "no gaps"),
        audit.rule(own, "days once", F.count("*") == F.countDistinct("day"), F.count("*")),
        audit.rule(T.read(spark, sf_dir, "orders"), "ids once", F.count("*") == F.countDistinct("o_orderkey")),
    )


@query(f"""{MASK} SELECT 'every cell once' AS rule, count(*) = 81 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM mask UNION ALL SELECT 'ocean or land', TRUE, '0'
    UNION ALL SELECT 'ocean cells plausible', count(CASE WHEN ocean THEN 1 END) BETWEEN 30 AND 50, CAST(count(CASE WHEN ocean THEN 1 END) AS VARCHAR) FROM mask""")
def q_mask_rules(spark, sf_dir):
    return audit.mask_rules(_mask(spark, sf_dir), 81, (30, 50))


@query("""SELECT unnest(['first day', 'last day', 'no gaps in days', 'every cell once a day', 'x has no nulls', 'y keeps nulls']) AS rule,
        unnest([min(day) = DATE '1999-01-01', max(day) = DATE '1999-12-31', count(DISTINCT day) = 365, count(*) = 365 * 64, count(x) = count(*), count(y) < count(*)]) AS passed,
        unnest([CAST(min(day) AS VARCHAR), CAST(max(day) AS VARCHAR), CAST(count(DISTINCT day) AS VARCHAR), CAST(count(*) AS VARCHAR), CAST(count(*) - count(x) AS VARCHAR), CAST(count(*) - count(y) AS VARCHAR)]) AS detail
    FROM (SELECT day, value AS x, CASE WHEN lat_i % 2 = 0 THEN value END AS y FROM cube WHERE split = 'val')""")
def q_split_rules(spark, sf_dir):
    own = T.split_cube(spark, sf_dir).where("split = 'val'").select("day", "lat_i", "lon_j", F.col("value").alias("x"), F.when(F.col("lat_i") % 2 == 0, F.col("value")).alias("y"))
    return audit.split_rules(own, 64, ("1999-01-01", "1999-12-31"), ["x"], ["y"])


@query("""SELECT CAST(COALESCE(a.k, b.k) AS BIGINT) AS k, round(COALESCE(b.mean, a.mean), 4) AS mean FROM (SELECT l_linenumber AS k, avg(l_quantity) AS mean FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1) a
    FULL JOIN (SELECT l_linenumber AS k, avg(l_tax * 100) AS mean FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1) b ON a.k = b.k""")
def q_merged_stats(spark, sf_dir):
    lines = T.read(spark, sf_dir, "lineitem").withColumn("k", F.col("l_linenumber").cast("long"))
    old = lines.where("k <= 5").groupBy("k").agg(F.avg("l_quantity").alias("mean"))
    new = lines.where("k >= 3").groupBy("k").agg(F.avg(F.col("l_tax") * 100).alias("mean"))
    return rounded(sources.merged_stats(old, new, ["k"]))


@query("SELECT p_brand AS setting, objective FROM (SELECT p_brand, round(avg(p_retailprice), 4) AS objective FROM part GROUP BY 1) ORDER BY objective, setting LIMIT 1")
def q_best_setting(spark, sf_dir):
    trials = T.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("setting")).agg(F.round(F.avg("p_retailprice"), 4).alias("objective"))
    return learning.best_setting(trials, "objective", "setting")


def _years(spark, sf_dir) -> list[int]:
    """The years of the orders."""
    return sorted(r.year for r in T.daily(spark, sf_dir).select(F.year("day").alias("year")).distinct().collect())  # a row per year


_PRODUCTS = ["glorys", "oisst", "sla", "sss"]


@query("""SELECT product, CAST(y AS BIGINT) AS year, depth, row_number() OVER (ORDER BY CASE product WHEN 'glorys' THEN 0 ELSE 1 END, product, y, depth) AS place
    FROM (SELECT DISTINCT CAST(year(day) AS INTEGER) AS y FROM daily WHERE year(day) >= 1993), (SELECT 'glorys' AS product, unnest([0.494025, 5.0, 10.0])::DOUBLE AS depth UNION ALL SELECT unnest(['oisst', 'sla', 'sss']), NULL)""")
def q_download_plan(spark, sf_dir):
    """The files for the years of the orders; years before the record have none."""
    plan = requests.plan(spark, _PRODUCTS, _years(spark, sf_dir), {"glorys": [0, 5, 10]})
    return longs(plan.select("product", "year", "depth", "place"))


@query("SELECT CAST(k AS BIGINT) AS depth_k, count(*) AS n FROM (SELECT arg_min(k, abs(m - x)) AS k FROM (SELECT l_orderkey, l_linenumber, l_quantity * 20.0 AS x, row_number() OVER () AS r FROM lineitem), (SELECT unnest(range(0, 15)) AS k, unnest([" + ", ".join(map(str, ACTUAL_DEPTHS)) + "])::DOUBLE AS m) GROUP BY r) GROUP BY k")
def q_nearest_level(spark, sf_dir):
    levels = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for k, m in enumerate(ACTUAL_DEPTHS)])
    x = F.col("l_quantity") * 20.0
    k = F.array_min(F.transform(levels, lambda v: F.struct(F.abs(v["m"] - x).alias("off"), v["k"].alias("k"))))["k"]
    return longs(T.read(spark, sf_dir, "lineitem").groupBy(k.alias("depth_k")).agg(F.count("*").alias("n")))


# --- learning: rows only ---------------------------------------------------------------------------------------------


@query()
def q_latent_basis(spark, sf_dir):
    return learning.latent_basis(T.read(spark, sf_dir, "embeddings"), 3, 4).select("vec_id", "cluster", F.transform("components", lambda x: F.round(x, 6)).alias("components"))


@query()
def q_linear_probe(spark, sf_dir):
    samples = T.predictions(spark, sf_dir).select(F.array("truth", "clim").alias("x"), F.col("pred").alias("y"))
    return learning.search_ridge(samples, [0.0, 0.1, 1.0])


@query("""SELECT CAST(year AS BIGINT) AS year, count(*) AS n, round(sqrt(avg(anom * anom)), 4) AS rmse_clim, round(sqrt(avg((anom - rm) * (anom - rm))), 4) AS rmse, round(1 - sqrt(avg((anom - rm) * (anom - rm))) / nullif(sqrt(avg(anom * anom)), 0), 4) AS skill
    FROM (SELECT *, """ + _rm(30) + """ AS rm FROM anoms) WHERE t >= 29 GROUP BY year""")
def q_flagship(spark, sf_dir):
    """Climatology of the training years, anomalies, a trailing mean as the forecast, and its skill by year."""
    own = series.running_mean(T.cube_anomalies(spark, sf_dir), series.CELL, 30).where(F.col("t") >= 29)
    rows = own.select("year", "t", F.col("anom").alias("truth"), F.col("rm30").alias("pred"), F.lit(0.0).alias("clim"))
    return longs(rounded(scores.level_metrics(rows, ["year"]).select("year", F.col("n_cells").alias("n"), "rmse_clim", "rmse", "skill")))


from . import assembly  # noqa: E402, F401  registers the rest of the catalogue
from . import access  # noqa: E402, F401
from . import fits  # noqa: E402, F401
