"""Stand-ins for a record's tables, made from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SplitMode
from ..operators import series

MODE = SplitMode((1999,), (2000, 2001), 10)
PLAIN_MODE = SplitMode((1999,), (2000, 2001))
CELLS = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days with the whole units ordered."""
    return read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(F.floor("o_totalprice")).cast("double").alias("value"))


def calendar(spark: SparkSession, days: DataFrame) -> DataFrame:
    first, last = days.agg(F.min("day"), F.max("day")).first()
    return series.calendar(spark, first, last)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the record, days without orders as 0."""
    own = daily(spark, sf_dir)
    return calendar(spark, own).join(own, "day", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cells (t, day, year, doy, lat_i, lon_j, value) of shipped quantities."""
    own = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), (F.col("l_partkey") % CELLS).cast("int").alias("lat_i"), (F.col("l_suppkey") % CELLS).cast("int").alias("lon_j"))
    own = own.agg(F.sum("l_quantity").cast("double").alias("value"))
    return own.withColumns({"t": F.datediff("day", F.lit("1995-01-01").cast("date")), "year": F.year("day"), "doy": F.dayofyear("day")})


def split_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).withColumn("split", F.when(F.col("year") == 1999, "val").when(F.col("year").isin(2000, 2001), "test").otherwise("train"))


def smooth_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = split_cube(spark, sf_dir).where("split = 'train'")
    return series.circular_smooth(series.doy_means(train, series.CELL), series.CELL, 7)


def cube_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.anomalies(split_cube(spark, sf_dir), smooth_climatology(spark, sf_dir), series.CELL)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly truth, prediction and climatology of every cell and level."""
    lines = read(spark, sf_dir, "lineitem").select(
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("int").alias("t"), F.month("l_shipdate").alias("month"), (F.col("l_partkey") % CELLS).cast("int").alias("lat_i"), (F.col("l_suppkey") % CELLS).cast("int").alias("lon_j"),
        (F.col("l_linenumber") - 1).cast("int").alias("depth_k"), F.floor("l_extendedprice").alias("price"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"),
    )
    values = lines.groupBy("t", "month", "lat_i", "lon_j", "depth_k").agg(F.avg("price").alias("truth"), F.avg("paid").alias("pred"))
    clim = lines.groupBy("month", "depth_k").agg(F.avg("price").alias("clim"))
    return values.join(clim, ["month", "depth_k"]).select("t", "lat_i", "lon_j", "depth_k", "truth", "pred", "clim")


def gate(spark: SparkSession) -> DataFrame:
    """Weights of the six pairs of levels."""
    return spark.range(6).select(F.col("id").cast("int").alias("depth_k"), F.when(F.col("id") < 2, 0.0).when(F.col("id") < 4, 0.3).otherwise(1.0).alias("gate"))


def raw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile levels from events: users are platforms, days are cycles."""
    e = read(spark, sf_dir, "events")
    digit = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(9)).cast("string")
    return e.select(
        (F.col("user_id") % 25 + F.col("event_id") % 4 / 4).cast("double").alias("lat"), (F.lit(40) + F.col("event_id") % 270).cast("double").alias("lon"),
        (F.lit(27028.0) + F.col("event_id") % 40 / 8).alias("juld"), F.when(F.col("event_id") % 11 != 0, F.when(F.col("event_id") % 5 == 0, "4").otherwise("1")).alias("position_qc"), F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")).alias("platform"),
        (F.col("event_id") % 40 / 8).cast("int").alias("cycle"), F.when(F.col("event_id") % 3 == 0, "R").when(F.col("event_id") % 3 == 1, "A").otherwise("D").alias("data_mode"),
        (F.col("event_id") % 2000).cast("double").alias("pres"), (F.lit(5.0) + F.col("event_id") % 25).alias("temp"),
        F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("event_id") % 2000 + 1).cast("double")).alias("pres_adj"), (F.lit(4.5) + F.col("event_id") % 25).alias("temp_adj"),
        digit.alias("pres_qc"), F.when(F.col("event_id") % 13 != 0, "1").alias("temp_qc"), F.when(F.col("event_id") % 17 != 0, digit).alias("temp_adj_qc"), F.lit("2").alias("pres_adj_qc"), F.col("event_id"),
    )


#: The same tables in SQL.
SQL = """
daily AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(SUM(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE) AS value FROM orders GROUP BY 1),
bounds AS (SELECT min(day) AS lo, max(day) AS hi FROM daily),
numbers AS (SELECT lo, unnest(range(0, date_diff('day', lo, hi) + 1)) AS n FROM bounds),
cal AS (SELECT CAST(n AS INTEGER) AS t, CAST(lo + CAST(n AS INTEGER) AS DATE) AS day FROM numbers),
days AS (SELECT t, day, CAST(year(day) AS INTEGER) AS year, CAST(dayofyear(day) AS INTEGER) AS doy FROM cal),
dense AS (SELECT days.*, COALESCE(value, 0) AS value FROM days LEFT JOIN daily USING (day)),
marked AS (SELECT *, CASE WHEN year = 1999 THEN 'val' WHEN year IN (2000, 2001) THEN 'test' ELSE 'train' END AS own FROM days),
labelled AS (SELECT t, day, year, doy, CASE WHEN own = 'train' AND max(CASE WHEN own <> 'train' THEN 1 ELSE 0 END) OVER (ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) = 1 THEN 'buffer' ELSE own END AS split FROM marked),
cells AS (
    SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_partkey % 8 AS INTEGER) AS lat_i, CAST(l_suppkey % 8 AS INTEGER) AS lon_j, CAST(SUM(l_quantity) AS DOUBLE) AS value
    FROM lineitem GROUP BY 1, 2, 3
),
cube AS (
    SELECT *, CAST(date_diff('day', DATE '1995-01-01', day) AS INTEGER) AS t, CAST(year(day) AS INTEGER) AS year, CAST(dayofyear(day) AS INTEGER) AS doy,
        CASE WHEN year(day) = 1999 THEN 'val' WHEN year(day) IN (2000, 2001) THEN 'test' ELSE 'train' END AS split FROM cells
),
doym AS (SELECT lat_i, lon_j, doy, avg(value) AS clim, count(value) AS n FROM cube WHERE split = 'train' GROUP BY 1, 2, 3),
ring AS (SELECT lat_i, lon_j, unnest(range(1, 367)) AS doy FROM (SELECT DISTINCT lat_i, lon_j FROM doym)),
padded AS (SELECT ring.lat_i, ring.lon_j, ring.doy + s AS place, COALESCE(clim, 0) AS clim FROM (SELECT *, unnest([-366, 0, 366]) AS s FROM ring) ring LEFT JOIN doym ON doym.lat_i = ring.lat_i AND doym.lon_j = ring.lon_j AND doym.doy = ring.doy),
smoothed AS (SELECT lat_i, lon_j, place, sum(clim) OVER (PARTITION BY lat_i, lon_j ORDER BY place ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15.0 AS clim FROM padded),
smooth AS (SELECT lat_i, lon_j, CAST(place AS INTEGER) AS doy, clim FROM smoothed WHERE place BETWEEN 1 AND 366),
anoms AS (SELECT cube.*, smooth.clim, value - smooth.clim AS anom FROM cube LEFT JOIN smooth USING (lat_i, lon_j, doy)),
lines AS (
    SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS t, month(l_shipdate) AS month, CAST(l_partkey % 8 AS INTEGER) AS lat_i, CAST(l_suppkey % 8 AS INTEGER) AS lon_j, CAST(l_linenumber - 1 AS INTEGER) AS depth_k,
        CAST(floor(l_extendedprice) AS BIGINT) AS price, CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS paid FROM lineitem
),
vals AS (SELECT t, month, lat_i, lon_j, depth_k, avg(price) AS truth, avg(paid) AS pred FROM lines GROUP BY ALL),
lclim AS (SELECT month, depth_k, avg(price) AS clim FROM lines GROUP BY ALL),
predictions AS (SELECT t, lat_i, lon_j, depth_k, truth, pred, clim FROM vals JOIN lclim USING (month, depth_k)),
gate AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.0::DOUBLE), (2, 0.3::DOUBLE), (3, 0.3::DOUBLE), (4, 1.0::DOUBLE), (5, 1.0::DOUBLE)) g(depth_k, gate)),
ahead AS (SELECT *, lead(depth_k) OVER w AS next_k, lead(truth) OVER w - truth AS d_truth, lead(pred) OVER w - pred AS d_pred FROM predictions WINDOW w AS (PARTITION BY t, lat_i, lon_j ORDER BY depth_k)),
steps AS (SELECT * FROM ahead WHERE next_k = depth_k + 1),
metrics AS (
    SELECT depth_k, count(*) AS n_cells, stddev_pop(truth) AS sigma, sqrt(avg((pred - truth) * (pred - truth))) AS rmse, avg(abs(pred - truth)) AS mae, avg(pred - truth) AS bias,
        covar_pop(truth, pred) / nullif(stddev_pop(truth) * stddev_pop(pred), 0) AS pearson_r, covar_pop(truth - clim, pred - clim) / nullif(stddev_pop(truth - clim) * stddev_pop(pred - clim), 0) AS anomaly_corr,
        stddev_pop(pred - clim) / nullif(stddev_pop(truth - clim), 0) AS anom_sd_ratio, sqrt(avg((clim - truth) * (clim - truth))) AS rmse_clim,
        1 - sqrt(avg((pred - truth) * (pred - truth))) / nullif(sqrt(avg((clim - truth) * (clim - truth))), 0) AS skill
    FROM predictions GROUP BY depth_k
),
raw AS (
    SELECT CAST(user_id % 25 + (event_id % 4) / 4.0 AS DOUBLE) AS lat, CAST(40 + event_id % 270 AS DOUBLE) AS lon0, 27028.0::DOUBLE + (event_id % 40) / 8.0 AS juld, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN '4' ELSE '1' END AS position_qc, CASE WHEN event_id % 13 <> 0 THEN '1' END AS temp_qc,
        CAST(user_id AS VARCHAR) AS platform, CAST((event_id % 40) // 8 AS INTEGER) AS cycle, CASE event_id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'D' END AS data_mode,
        CAST(event_id % 2000 AS DOUBLE) AS p, CAST(5.0 + event_id % 25 AS DOUBLE) AS tm, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 2000 + 1 AS DOUBLE) END AS pa, CAST(4.5 + event_id % 25 AS DOUBLE) AS ta,
        CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 9 AS VARCHAR) AS digit, CASE WHEN event_id % 17 <> 0 THEN CAST(CAST(json_extract(props, '$.k') AS INTEGER) % 9 AS VARCHAR) END AS adj_digit FROM events
),
chosen AS (SELECT *, CASE WHEN lon0 > 180 THEN lon0 - 360 ELSE lon0 END AS lon, data_mode IN ('D', 'A') AND pa IS NOT NULL AS adjusted FROM raw),
levels AS (
    SELECT lat, lon, juld, platform, cycle, data_mode, adjusted, CASE WHEN adjusted THEN pa ELSE p END AS pres, CASE WHEN adjusted THEN ta ELSE tm END AS temp, platform || '_' || CAST(cycle AS VARCHAR) AS prof_key,
        make_timestamp(CAST(round(juld * 86400000000) AS BIGINT) - 631152000000000) AS time
    FROM chosen WHERE lat BETWEEN 4.8 AND 25.2 AND lon BETWEEN 49.8 AND 100.2 AND position_qc = '1' AND (CASE WHEN adjusted THEN '2' ELSE digit END) IN ('1', '2') AND (CASE WHEN adjusted THEN adj_digit ELSE temp_qc END) IN ('1', '2')
),
deep AS (
    SELECT *, ((((-1.82e-15 * pres + 2.279e-10) * pres - 2.2512e-5) * pres + 9.72659) * pres) / (9.780318 * (1 + (5.2788e-3 + 2.36e-5 * pow(sin(radians(lat)), 2)) * pow(sin(radians(lat)), 2)) + 1.092e-6 * pres) AS depth_m FROM levels
)
"""
