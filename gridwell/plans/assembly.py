"""More of the catalogue: reading, plans, guards, standardising by flags and windows, assembly of samples, file audits."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..config import SPLIT_MODES, VERSIONS, Axis, Grid, SplitMode
from ..operators import audit, features, grids, profiles, scores, series, splits
from ..sources import tables as sources
from . import requests
from . import tables as T
from .catalogue import FINE, POINTS, longs, query, rounded

# --- reading ---------------------------------------------------------------------------------------------------------


@query("""SELECT CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS n, count(CASE WHEN isfinite(l_tax) THEN 1 END) AS taxed, round(avg(l_extendedprice), 3) AS sst FROM lineitem
    WHERE l_quantity BETWEEN 4.8 AND 25.2 AND l_partkey BETWEEN 49.8 AND 100.2 AND year(l_shipdate) IN (1996, 1998) GROUP BY 1""")
def q_read_product(spark, sf_dir):
    """A table under common names, in the grid's box and in two years; the filters reach the scan."""
    names = {"l_shipdate": "day", "l_quantity": "lat", "l_partkey": "lon", "l_extendedprice": "sst", "l_tax": "tax"}
    own = sources.read_product(spark, f"{sf_dir}/lineitem.parquet", names, grid=Grid(), years=[1996, 1998], required=["sst", "tax"])
    return longs(rounded(own.groupBy(F.year("day").alias("year")).agg(F.count("*").alias("n"), F.count("tax").alias("taxed"), F.avg("sst").alias("sst")), 3))


@query("SELECT c_custkey, c_acctbal AS value FROM customer WHERE c_nationkey = 0")
def q_surface_level(spark, sf_dir):
    return sources.read_product(spark, f"{sf_dir}/customer.parquet", {"c_acctbal": "value"}, first_level="c_nationkey").select("c_custkey", "value")


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region, '' AS region_name FROM nation UNION ALL SELECT -1, '', r_regionkey, r_name FROM region")
def q_read_parts(spark, sf_dir):
    """Tables below each other by name, with nulls for columns that one lacks."""
    own = sources.read_parts(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"])
    return own.select(F.coalesce(F.col("n_nationkey").cast("long"), F.lit(-1)).alias("key"), F.coalesce("n_name", F.lit("")).alias("name"), F.coalesce("n_regionkey", "r_regionkey").cast("long").alias("region"), F.coalesce("r_name", F.lit("")).alias("region_name"))


@query("SELECT prof_key, round(pres, 4) AS pres, CAST(dense_rank() OVER (ORDER BY prof_key) - 1 AS BIGINT) AS profile_id, adjusted FROM levels")
def q_observations(spark, sf_dir):
    own = profiles.observations(profiles.tidy_levels(T.raw_levels(spark, sf_dir)))
    return longs(rounded(own.select("prof_key", "pres", "profile_id", "adjusted")))


@query("""SELECT platform || '_' || CAST(cycle AS VARCHAR) AS prof_key, round(CASE WHEN adjusted THEN pa ELSE p END, 4) AS pres, round(CASE WHEN adjusted THEN ta ELSE tm END, 4) AS temp, adjusted
    FROM chosen WHERE lat BETWEEN 4.8 AND 25.2 AND lon BETWEEN 49.8 AND 100.2 AND position_qc = '1' AND digit IN ('1', '2') AND temp_qc IN ('1', '2')""")
def q_argo_without_adjusted_flags(spark, sf_dir):
    """Without columns of adjusted flags the raw flags count, for adjusted values too."""
    raw = T.raw_levels(spark, sf_dir).drop("temp_adj_qc", "pres_adj_qc")
    return rounded(profiles.tidy_levels(raw).select("prof_key", "pres", "temp", "adjusted"))


# --- plans -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'glorys' AS product, CAST(y AS BIGINT) AS year, m AS nominal, CASE WHEN m = 0 THEN 0.494025 ELSE m END::DOUBLE AS depth, row_number() OVER (ORDER BY y, m) AS place, 'glorys_' || m || 'm_' || y AS file
    FROM (SELECT DISTINCT CAST(year(day) AS INTEGER) AS y FROM daily), (SELECT unnest([100, 125, 150, 200]) AS m) WHERE y >= 1993""")
def q_plan_of_levels(spark, sf_dir):
    """The files of a range of levels for the years of the orders; a year that the product doesn't cover has none."""
    from .catalogue import _years

    plan = requests.files(requests.plan(spark, ["glorys"], _years(spark, sf_dir), requests.all_levels(), (100, 200)))
    return plan.select("product", F.col("year").cast("long").alias("year"), F.col("nominal").cast("long").alias("nominal"), "depth", F.col("place").cast("long").alias("place"), "file")


@query("""SELECT axis, size, padded, seen, n FROM (VALUES ('rows', '81', '96'), ('columns', '101', '112')) x(axis, size, padded)
    JOIN (SELECT unnest(['rows', 'columns']) AS axis, unnest([count(DISTINCT l_partkey % 81), count(DISTINCT l_suppkey % 201)]) AS seen, count(*) AS n FROM lineitem WHERE l_suppkey % 201 >= 100) USING (axis)""")
def q_grid_version(spark, sf_dir):
    """The eastern version of the grid, cropped from the whole one, and padded to sixteens; lines lie on it, and those in the west go."""
    east = VERSIONS["v3"]
    lines = T.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 81).cast("int").alias("lat_i"), (F.col("l_suppkey") % 201).cast("int").alias("lon_j"))
    seen = grids.cropped(lines, VERSIONS["v2"], east).agg(F.count_distinct("lat_i").alias("rows"), F.count_distinct("lon_j").alias("columns"), F.count("*").alias("n"))
    cells = grids.cropped(grids.cells(spark, VERSIONS["v2"]), VERSIONS["v2"], east)
    own = cells.agg(F.count_distinct("lat_i").alias("r"), F.count_distinct("lon_j").alias("c"))
    wide = grids.padded(spark, east, 16).agg(F.count_distinct("pad_i").alias("pr"), F.count_distinct("pad_j").alias("pc"))
    pairs = F.array(*[F.struct(F.lit(k).alias("axis"), F.col(a).cast("string").alias("size"), F.col(b).cast("string").alias("padded"), F.col(k).alias("seen"), F.col("n")) for k, a, b in (("rows", "r", "pr"), ("columns", "c", "pc"))])
    return own.crossJoin(wide).crossJoin(seen).select(F.explode(pairs).alias("x")).select("x.*")  # a row each


@query(f"{POINTS} SELECT day, CAST(lat_i AS BIGINT) - 2 AS lat_i, CAST(lon_j AS BIGINT) - 3 AS lon_j, round(avg(value), 4) AS value FROM binned WHERE lat_i BETWEEN 2 AND 6 AND lon_j BETWEEN 3 AND 8 GROUP BY ALL")
def q_grid_crop(spark, sf_dir):
    from .catalogue import _points

    own = grids.block_average(grids.with_bins(_points(spark, sf_dir), FINE), ["day"])
    return longs(rounded(grids.cropped(own, FINE, Grid(Axis(5.5, 6.5, 0.25), Axis(50.75, 52.0, 0.25))).drop("n")))


@query(f"""{POINTS} SELECT CAST(i AS BIGINT) AS pad_i, CAST(j AS BIGINT) AS pad_j, count(value) AS n, round(COALESCE(avg(value), 0), 4) AS value
    FROM (SELECT unnest(range(0, 16)) AS i), (SELECT unnest(range(0, 16)) AS j) LEFT JOIN binned ON lat_i = i - 4 AND lon_j = j - 4 GROUP BY i, j""")
def q_padded_grid(spark, sf_dir):
    """A mean over all days on the padded grid, 0 in the margin."""
    from .catalogue import _points

    own = grids.block_average(grids.with_bins(_points(spark, sf_dir), FINE), [])
    return longs(rounded(grids.padded(spark, FINE, 16).join(own, ["lat_i", "lon_j"], "left").fillna(0, ["n", "value"]).select("pad_i", "pad_j", "n", "value")))


# --- splits and guards -----------------------------------------------------------------------------------------------


@query("""SELECT mode, split, count(*) AS n FROM (SELECT mode, y, CASE WHEN list_contains(v, y) THEN 'val' WHEN list_contains(te, y) THEN 'test' ELSE 'train' END AS split
        FROM (VALUES ('chronological', [2021, 2022], [2023, 2024]), ('interleaved', [2000, 2013], [2004, 2017]), ('legacy', [2021], [2022])) m(mode, v, te),
        (SELECT year(day + 9131) AS y FROM days)) GROUP BY ALL""")
def q_split_modes(spark, sf_dir):
    """How many days of the orders' calendar, 25 years later, each mode holds out, buffers aside."""
    days = T.calendar(spark, T.daily(spark, sf_dir)).withColumn("day", F.date_add("day", 9131)).withColumn("year", F.year("day"))
    out = None
    for name, mode in SPLIT_MODES.items():
        own = splits.summary(splits.day_labels(days, SplitMode(mode.val_years, mode.test_years))).select(F.lit(name).alias("mode"), "split", "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT CAST(t AS BIGINT) AS t, split FROM labelled WHERE t % 50 = 0")
def q_split_of(spark, sf_dir):
    labelled = splits.day_labels(T.calendar(spark, T.daily(spark, sf_dir)), T.MODE, 7)
    return longs(splits.split_of(labelled, labelled.select("t").where("t % 50 = 0")))


@query("SELECT CAST(t AS BIGINT) AS t, split FROM labelled WHERE split = 'buffer' AND year = 1998")
def q_outside(spark, sf_dir):
    """Days of other splits than the allowed one."""
    labelled = splits.day_labels(T.calendar(spark, T.daily(spark, sf_dir)), T.MODE, 7).select("t", "year", "split")
    return longs(splits.outside(labelled.where("split IN ('buffer', 'train')"), labelled.where("split = 'train' OR year <> 1998")).select("t", "split"))


@query("""SELECT CAST(year AS BIGINT) AS year, count(CASE WHEN d.day IS NOT NULL AND s.day IS NOT NULL THEN 1 END) AS days, count(*) AS expected, count(CASE WHEN d.day IS NULL OR s.day IS NULL THEN 1 END) = 0 AS passed
    FROM days LEFT JOIN daily d USING (day) LEFT JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) s USING (day) GROUP BY year""")
def q_year_alignment(spark, sf_dir):
    """Each year's common days of two sources against those that it should have."""
    own = T.daily(spark, sf_dir)
    days = series.common_days(own, T.cube(spark, sf_dir)).withColumn("there", F.lit(1))
    years = T.calendar(spark, own).join(days, "day", "left").groupBy("year").agg(F.count("there").alias("days"), F.count("*").alias("expected"))
    return longs(years.withColumn("passed", F.col("days") == F.col("expected")))


@query("SELECT after, next, missing FROM (SELECT before AS after, day AS next, CAST(date_diff('day', before, day) - 1 AS BIGINT) AS missing FROM (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM daily) WHERE date_diff('day', before, day) <> 1) ORDER BY after LIMIT 3")
def q_first_gaps(spark, sf_dir):
    """The first three gaps; the limit is the report."""
    return longs(series.gaps(T.daily(spark, sf_dir)).orderBy("after").limit(3))


@query("""SELECT name, COALESCE(CAST(max(CASE WHEN y = 1995 THEN n END) AS VARCHAR), 'None') AS old, COALESCE(CAST(max(CASE WHEN y = 1996 THEN n END) AS VARCHAR), 'None') AS new
    FROM (SELECT CASE WHEN o_orderpriority LIKE '5%' THEN 'least' ELSE o_orderpriority END AS name, year(o_orderdate) AS y, CASE WHEN o_orderpriority LIKE '5%' THEN 7 ELSE count(*) END AS n FROM orders GROUP BY o_orderpriority, year(o_orderdate)) WHERE y IN (1995, 1996)
    GROUP BY name HAVING max(CASE WHEN y = 1995 THEN n END) IS DISTINCT FROM max(CASE WHEN y = 1996 THEN n END)""")
def q_changed_settings(spark, sf_dir):
    """Orders of each priority as settings of two years, and one that stays the same."""
    least = F.col("o_orderpriority").startswith("5")
    own = T.read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderpriority").agg(F.count("*").alias("n")).where("y IN (1995, 1996)")
    rows = own.select("y", F.when(least, "least").otherwise(F.col("o_orderpriority")).alias("name"), F.when(least, 7).otherwise(F.col("n")).alias("n")).collect()  # a row per priority and year
    old, new = ({r["name"]: r.n for r in rows if r.y == y} for y in (1995, 1996))
    return audit.changed_settings(spark, old, new)


# --- standardising and assembly --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY ALL")
def q_destandardised(spark, sf_dir):
    """Values that were standardised and brought back."""
    lines = T.read(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    back = series.destandardise(series.standardise(lines, {"l_quantity": (25.5, 14.4)}), {"l_quantity": (25.5, 14.4)})
    return longs(rounded(back.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))))


@query("SELECT CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, count(*) AS n, round(avg((value - clim - 0.3) / 1.7), 4) AS sst, round(avg(value), 4) AS sla FROM anoms GROUP BY ALL")
def q_input_anomalies(spark, sf_dir):
    """One input as a standardised anomaly, by its flag, the other as it is."""
    own = T.cube_anomalies(spark, sf_dir).select("lat_i", "lon_j", F.col("value").alias("sst"), F.col("value").alias("sla"), F.col("clim").alias("sst_clim"), F.col("clim").alias("sla_clim"))
    flagged = series.input_anomalies(own, ["sst_clim", "sla_clim"], {"sst": (0.3, 1.7)})
    return longs(rounded(flagged.groupBy("lat_i", "lon_j").agg(F.count("*").alias("n"), F.avg("sst").alias("sst"), F.avg("sla").alias("sla"))))


_RM = "CASE WHEN row_number() OVER (PARTITION BY lat_i, lon_j ORDER BY t) < {w} THEN 0.0 ELSE sum(anom) OVER (PARTITION BY lat_i, lon_j ORDER BY t ROWS BETWEEN {b} PRECEDING AND CURRENT ROW) / {w}.0 END"


@query(f"""SELECT CAST(w AS BIGINT) AS w, CAST(lat_i AS BIGINT) AS lat_i, count(*) AS n, round(avg((m - CASE w WHEN 30 THEN 0.25 ELSE -0.5 END) / CASE w WHEN 30 THEN 2.0 ELSE 4.0 END), 4) + 0.0 AS m
    FROM (SELECT lat_i, unnest([30, 90]) AS w, unnest([a, b]) AS m FROM (SELECT lat_i, {_RM.format(w=30, b=29)} AS a, {_RM.format(w=90, b=89)} AS b FROM anoms)) GROUP BY ALL""")
def q_standardised_windows(spark, sf_dir):
    """Trailing means by the constants of their own window."""
    own = T.cube_anomalies(spark, sf_dir)
    for w in (30, 90):
        own = series.running_mean(own, series.CELL, w)
    long = own.select("lat_i", F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"rm{w}").alias("m")) for w in (30, 90)])).alias("x")).select("lat_i", "x.w", "x.m", F.lit("sst").alias("var"))
    stats = spark.createDataFrame([(30, "sst", 0.25, 2.0), (90, "sst", -0.5, 4.0)], "w int, var string, mean double, std double")
    return longs(rounded(series.standardise_windows(long, stats).groupBy("w", "lat_i").agg(F.count("*").alias("n"), F.avg("m").alias("m"))))


@query("SELECT CAST(t AS BIGINT) AS t, CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, CAST(7 AS BIGINT) AS levels, round(sum(truth - clim), 3) AS anom, round(sum(clim), 3) AS clim FROM predictions GROUP BY ALL")
def q_target_anomaly(spark, sf_dir):
    """Targets as anomalies with their climatology behind them in one array, and parted again."""
    p = T.predictions(spark, sf_dir)
    keys = ["t", "lat_i", "lon_j"]
    anom = features.profile_arrays(p.withColumn("value", F.col("truth") - F.col("clim")), keys, 7).withColumnRenamed("y", "a")
    both = anom.join(features.profile_arrays(p.withColumn("value", F.col("clim")), keys, 7), keys).select(*keys, features.with_climatology(F.col("a"), F.col("y")).alias("both"))
    a, c = features.split_climatology(F.col("both"), 7)

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))

    return longs(rounded(both.select(*keys, F.size(a).cast("long").alias("levels"), total(a).alias("anom"), total(c).alias("clim")), 3))


@query("SELECT CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, CAST(depth_k AS BIGINT) AS depth_k, (lat_i + lon_j + depth_k) % 4 <> 0 AND (lat_i + lon_j + depth_k + 1) % 4 <> 0 AS valid FROM (SELECT DISTINCT lat_i, lon_j, depth_k FROM predictions) WHERE depth_k < 6")
def q_pair_mask(spark, sf_dir):
    places = T.predictions(spark, sf_dir).select("lat_i", "lon_j", "depth_k").distinct()
    return longs(grids.pair_mask(places.withColumn("valid", (F.col("lat_i") + F.col("lon_j") + F.col("depth_k")) % 4 != 0)))


@query("SELECT CAST(depth_k AS BIGINT) AS depth_k, count(*) AS n, round(sum(truth), 3) AS truth, round(sum(pred), 3) AS pred, round(sum(clim), 3) AS clim FROM predictions WHERE lat_i <> 3 AND depth_k <> 5 GROUP BY depth_k")
def q_co_registered(spark, sf_dir):
    """Truth, prediction and climatology of three tables, where all have the place."""
    p, keys = T.predictions(spark, sf_dir), ("t", "lat_i", "lon_j", "depth_k")
    own = scores.co_registered(p.select(*keys, "truth"), p.select(*keys, "pred").where("lat_i <> 3"), p.select(*keys, "clim").where("depth_k <> 5"), keys)
    return longs(rounded(own.groupBy("depth_k").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("truth", "pred", "clim")]), 3))


@query("SELECT CAST(sum(n_cells) AS BIGINT) AS n_cells, round(sqrt(sum(rmse * rmse * n_cells) / sum(n_cells)), 4) AS rmse, round(sum(mae * n_cells) / sum(n_cells), 4) AS mae, (SELECT round(avg(CASE WHEN d_pred > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 4) FROM steps) AS inversions FROM metrics")
def q_evaluate(spark, sf_dir):
    p, keys = T.predictions(spark, sf_dir), ("t", "lat_i", "lon_j", "depth_k")
    found = scores.evaluate(*(p.select(*keys, c) for c in ("truth", "pred", "clim")), T.gate(spark), keys)
    share = found.violations.where("of = 'pred'").select(F.col("all_pairs").alias("inversions"))
    return rounded(found.overall.select("n_cells", "rmse", "mae").crossJoin(share))  # a row each


@query("""SELECT round(avg((pred - truth) * (pred - truth)), 3) AS mse, round(avg(abs(pred - truth)), 4) AS mae, round(sqrt(avg(4.0 * (pred - truth) * (pred - truth))), 4) AS rmse_scaled, count(*) AS n,
    (SELECT round(avg(CASE WHEN d_pred > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 4) FROM steps) AS all_pairs, (SELECT round(avg(CASE WHEN d_pred > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 4) FROM steps WHERE depth_k >= 2) AS gated FROM predictions""")
def q_metric_bundle(spark, sf_dir):
    return rounded(scores.bundle(T.predictions(spark, sf_dir), T.gate(spark), 2.0)).withColumn("mse", F.round("mse", 3))


@query("SELECT CAST(depth_k AS BIGINT) AS depth_k, round(regr_slope(pred, truth), 4) AS slope, round(regr_intercept(pred, truth), 2) AS intercept, round(regr_r2(pred, truth), 4) AS r2 FROM predictions GROUP BY depth_k")
def q_linear_fit(spark, sf_dir):
    """The least-squares line of the prediction over the truth, by level."""
    own = T.predictions(spark, sf_dir).groupBy("depth_k").agg(F.regr_slope("pred", "truth").alias("slope"), F.round(F.regr_intercept("pred", "truth"), 2).alias("intercept"), F.regr_r2("pred", "truth").alias("r2"))
    return longs(rounded(own))


# --- file audit ------------------------------------------------------------------------------------------------------


@query("""SELECT source, file, CASE WHEN kind IS NULL THEN 'missing' WHEN text OR thin OR twice THEN 'failed' ELSE 'ok' END AS status,
        CASE WHEN kind IS NULL THEN '' ELSE array_to_string(list_sort(list_concat(CASE WHEN thin THEN ['first day has few values of value'] ELSE [] END, CASE WHEN twice THEN ['times repeat'] ELSE [] END, CASE WHEN text THEN ['value is of type string'] ELSE [] END)), ', ') END AS problems
    FROM (SELECT 'orders' AS source, 'orders_' || y AS file, y FROM (SELECT unnest(range(1994, 2003)) AS y))
    LEFT JOIN (SELECT year(day) AS y, CASE WHEN year(day) = 1996 THEN 'string' ELSE 'double' END AS kind, year(day) = 1996 AS text, year(day) = 1997 AS thin, year(day) = 1998 AS twice FROM daily GROUP BY ALL) USING (y)""")
def q_file_audit(spark, sf_dir):
    """Planned files against those that are there: a text column, a first day nearly without values, and repeated times are found."""
    own = T.daily(spark, sf_dir).withColumn("file", F.concat(F.lit("orders_"), F.year("day").cast("string")))
    doubled = own.unionByName(own.where(F.year("day") == 1998))
    steps = series.uneven_steps(doubled, "day", ["file"]).withColumn("regular", F.lit(True))  # the stand-in has gaps
    present = own.select("file", F.lit("value").alias("variable"), F.when(F.year("day") == 1996, "string").otherwise("double").alias("kind")).distinct()
    shares = own.select("file", F.lit("value").alias("variable"), F.when(F.year("day") == 1997, 0.04).otherwise(0.9).alias("first"), F.lit(0.9).alias("last")).distinct()
    planned = spark.range(1994, 2003).select(F.lit("orders").alias("source"), F.concat(F.lit("orders_"), F.col("id").cast("string")).alias("file"))
    found = audit.file_audit(planned, present, audit.file_problems(present, steps, shares))
    return found.withColumn("problems", F.array_join("problems", ", "))
