"""Queries on how a record is laid out and read: blocks of days, shuffled batches, picked days, requests and profile files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import Inputs
from ..operators import permutation, profiles, series, splits, trailing
from ..sources import classic, reuse, subset
from ..sources import tables as sources
from . import tables as T
from .catalogue import ORACLES, _labelled, _rm, longs, query, rounded

BLOCK = 64


@query(f"""SELECT day, CAST(lat_i AS BIGINT) AS lat_i, CAST(lon_j AS BIGINT) AS lon_j, round({_rm(30)}, 4) + 0.0 AS rm30, round({_rm(90)}, 4) + 0.0 AS rm90 FROM anoms""")
def q_running_means_by_block(spark, sf_dir):
    """Both windows in one pass over blocks of 64 days and their halos."""
    own = trailing.running_means(T.cube_anomalies(spark, sf_dir), series.CELL, (30, 90), size=BLOCK)
    return longs(rounded(own.select("day", "lat_i", "lon_j", F.col("rm30") + 0.0, F.col("rm90") + 0.0).toDF("day", "lat_i", "lon_j", "rm30", "rm90")))


SEED, EPOCH, BATCH = 7, 3, 16


def _walk_sql(source: str) -> str:
    """y of source (i, y, n, columns, rows) moved once by the rounds of the order."""
    inner = f"SELECT i, n, columns, rows, y // columns AS l, y % columns AS r FROM {source}"
    for k, (a, b, c, d) in enumerate(permutation.Permutation(1, SEED, EPOCH).rounds):
        half, to, side = ("r", "l", "rows") if k % 2 == 0 else ("l", "r", "columns")
        line = f"(({half} * {a} + {b}) % {permutation.PRIME})"
        moved = f"({to} + (({line} * {line}) % {permutation.PRIME} * {c} + {d}) % {permutation.PRIME}) % {side} AS {to}"
        inner = f"SELECT i, n, columns, rows, {half}, {moved} FROM ({inner})"
    return f"SELECT i, l * columns + r AS y, n, columns, rows FROM ({inner})"


_SHUFFLED = f"""
    picked AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM labelled WHERE split = 'train' AND t >= 89),
    size AS (SELECT count(*) AS n, CAST(pow(2, length(bin(count(*) - 1)) // 2) AS BIGINT) AS columns FROM picked),
    walk AS ({_walk_sql("(SELECT i, i AS y, n, columns, (n + columns - 1) // columns AS rows FROM picked, size)")} UNION ALL {_walk_sql("(SELECT * FROM walk WHERE y >= n)")})"""


def _train_days(spark, sf_dir):
    return splits.split_rows(_labelled(spark, sf_dir), "train", Inputs().history)


@query(f", {_SHUFFLED} SELECT CAST(t AS BIGINT) AS t, y AS place, y // {BATCH} AS batch FROM walk JOIN picked USING (i) WHERE y < n", recursive=True)
def q_shuffled_batches(spark, sf_dir):
    """Training days in the order of an epoch, without a sort."""
    return longs(splits.batches(_train_days(spark, sf_dir).select("t"), BATCH, SEED, EPOCH))


@query(f", {_SHUFFLED} SELECT y // {BATCH} AS batch, y AS place, CAST(t AS BIGINT) AS t FROM walk JOIN picked USING (i) WHERE y < n AND y // {BATCH} IN (0, 5, 40)", recursive=True)
def q_batch_members(spark, sf_dir):
    """What three batches of the epoch hold, found from their numbers alone."""
    days = permutation.numbered(_train_days(spark, sf_dir).select("t"))
    return longs(permutation.members(spark, days.count(), BATCH, [0, 5, 40], SEED, EPOCH).join(days, "number").select("batch", "place", "t"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_shipdate AS DATE) AS day, l_quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (SELECT day FROM labelled WHERE split = 'train' AND t % 97 < 2)")
def q_days_gathered(spark, sf_dir):
    """Lines of some days of a split, from files that are laid out by day."""
    folder = f"{sources.scratch(spark)}/by-day-{uuid.uuid4().hex}"
    lines = T.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.to_date("l_shipdate").alias("day"), "l_quantity")
    sources.write_by_day(lines, folder)
    days = _labelled(spark, sf_dir).where("split = 'train' AND t % 97 < 2").select("day").collect()  # days of a calendar
    return sources.read_days(spark, folder, [r.day for r in days])


def _archive(path: str):
    """An archive that holds the lines of a table: it reads what a request asks for, in a process of its own."""

    def fetch(request: dict):
        import datetime as dt

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        first, last = (dt.datetime.fromisoformat(request[k]) for k in ("start", "end"))
        lines = ds.dataset(path)
        at = pc.field("l_shipdate").cast(pa.timestamp("us"))
        table = lines.to_table(columns=["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"], filter=(at >= first) & (at <= last))
        lat, lon = (pc.cast(pc.subtract(table[c], pc.multiply(pc.divide(table[c], 24), 24)), pa.float64()) for c in ("l_partkey", "l_suppkey"))
        out = pa.table({"day": pc.cast(table["l_shipdate"], pa.date32()), "lat": lat, "lon": lon, "depth": pc.cast(table["l_linenumber"], pa.float64()), "quantity": pc.cast(table["l_quantity"], pa.float64())})
        south, north, west, east = (request[k] for k in ("south", "north", "west", "east"))
        here = (pc.field("lat") >= south) & (pc.field("lat") <= north) & (pc.field("lon") >= west) & (pc.field("lon") <= east)
        return out.filter(here & (pc.field("depth") == request["least"]))

    return fetch


@query("""SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_linenumber AS DOUBLE) AS depth, count(*) AS n, sum(CAST(l_quantity AS DOUBLE)) AS quantity FROM lineitem
    WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-11-01' AND DATE '1998-02-15' AND l_partkey % 24 < 9 AND l_suppkey % 24 >= 3 AND l_linenumber IN (2, 3) GROUP BY ALL""")
def q_remote_subset(spark, sf_dir):
    """A period, a box and two levels of an archive: six requests of 49."""
    subset.register(spark, "lines", "day date, lat double, lon double, depth double, quantity double", _archive(f"{sf_dir}/lineitem.parquet"))
    asked = spark.read.format("lines").option("products", "lines").option("years", "1993,1994,1995,1996,1997,1998,1999").option("depths", "1,2,3,4,5,6,7").option("box", "0,24,0,24").load()
    asked = asked.where("day BETWEEN DATE '1996-11-01' AND DATE '1998-02-15' AND lat < 9 AND lon >= 3 AND depth IN (2, 3)")
    return asked.groupBy("day", "depth").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query(ORACLES["q_argo_qc"].removeprefix(f"WITH {T.SQL.strip()} "))
def q_levels_from_files(spark, sf_dir):
    """The levels of q_argo_qc by way of profile files: 2,000 events a file, written in the classic layout and decoded by a table function."""

    def written(rows):
        import pandas as pd

        return pd.DataFrame({"path": [f"profiles_{rows['file'].iloc[0]}"], "content": [classic.profile_file(rows)]})

    raw = T.raw_levels(spark, sf_dir).withColumns({"juld_qc": F.lit("1"), "file": F.floor(F.col("event_id") / 2000), "profile": F.col("event_id") % 2000, "level": F.lit(0)})
    decoded = classic.read_levels(raw.groupBy("file").applyInPandas(written, "path string, content binary")).where("error = ''")
    levels = profiles.tidy_levels(decoded)
    return rounded(levels.select("prof_key", "lat", "lon", "pres", "temp", "adjusted", F.unix_micros("time").alias("micros")))


_FILES = """, parts AS (SELECT l_linenumber AS k, l_quantity AS q, l_orderkey AS o, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS m FROM lineitem),
    held AS (SELECT y, m, concat('lines_', y, '_', m) AS file, count(*) * 8 AS bytes, sha256(concat(count(*), '|', sum(o), '|', CAST(sum(q) AS BIGINT))) AS digest FROM parts WHERE NOT (m = 7 AND k = 1) AND m <> 11 GROUP BY ALL),
    known AS (SELECT y, concat('lines_', y, '_', m) AS file, count(*) * 8 AS bytes, sha256(concat(count(*), '|', sum(o), '|', CAST(sum(q) AS BIGINT) + CASE m WHEN 5 THEN 1 ELSE 0 END)) AS digest FROM parts WHERE y <> 1998 GROUP BY y, m)"""


@query(f"""{_FILES} SELECT p.file, CASE WHEN k.file IS NULL THEN 'new' WHEN p.y = 1997 THEN 'settings' WHEN h.file IS NULL THEN 'absent' WHEN h.bytes < k.bytes THEN 'torn' ELSE 'changed' END AS reason
    FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, concat('lines_', CAST(year(o_orderdate) AS INTEGER), '_', CAST(month(o_orderdate) AS INTEGER)) AS file FROM orders) p LEFT JOIN known k USING (file) LEFT JOIN held h USING (file)
    WHERE k.file IS NULL OR p.y = 1997 OR h.file IS NULL OR k.digest <> h.digest""")
def q_files_to_fetch(spark, sf_dir):
    """Months of lines as files: some torn, gone or changed since the manifest was made, some new, some made under other settings."""
    lines = T.read(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_orderkey", F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"))

    def files(rows, more=0):
        text = F.concat_ws("|", F.count("*"), F.sum("l_orderkey"), F.sum("l_quantity").cast("long") + more)
        own = rows.groupBy("y", "m").agg((F.count("*") * 8).alias("bytes"), text.alias("text"))
        return own.select("y", F.concat_ws("_", F.lit("lines"), "y", "m").alias("file"), "bytes", F.sha2("text", 256).alias("digest"))

    present = files(lines.where("NOT (m = 7 AND l_linenumber = 1) AND m <> 11"))
    settings = F.when(F.col("y") == 1997, "old").otherwise("lines")
    manifest = files(lines.where("y <> 1998"), F.when(F.col("m") == 5, 1).otherwise(0)).withColumn("spec", reuse.spec_of(settings, F.col("y")))
    plan = T.read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    plan = plan.select(F.concat_ws("_", F.lit("lines"), "y", "m").alias("file"), reuse.spec_of(F.lit("lines"), F.col("y")).alias("spec"))
    return reuse.to_fetch(plan, manifest, present).select("file", "reason")


@query("""SELECT CAST(y AS BIGINT) AS year, why = '' AND f1 IS NOT NULL AND f2 IS NOT NULL AS ready, why = '' AND (written IS NULL OR newest > written) AS stale,
        CASE WHEN why <> '' THEN why WHEN written IS NULL THEN 'never made' WHEN newest > written THEN concat(last, ' is newer') ELSE '' END AS reason
    FROM (SELECT *, CASE WHEN f1 IS NULL THEN 'no 1' WHEN f2 IS NULL THEN 'no 2' WHEN y % 4 = 1 THEN concat(f2, ' can''t be read') WHEN y % 3 = 0 THEN concat(f1, ' lacks b') ELSE '' END AS why FROM (
        SELECT y, max(CASE WHEN p = '1' THEN concat('1_', y) END) AS f1, max(CASE WHEN p = '2' THEN concat('2_', y) END) AS f2, max(modified) AS newest, arg_max(concat(p, '_', y), concat(modified, p)) AS last
        FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, substr(o_orderpriority, 1, 1) AS p, CAST(max(o_orderdate) AS DATE) AS modified FROM orders GROUP BY ALL) WHERE p IN ('1', '2') AND NOT (y = 1995 AND p = '2') GROUP BY y))
    FULL JOIN (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, CAST(max(l_shipdate) AS DATE) - 2 AS written FROM lineitem WHERE year(l_shipdate) % 2 = 0 AND year(l_shipdate) <= 1997 GROUP BY 1) USING (y)""")
def q_year_vintage(spark, sf_dir):
    """Years by what their files hold and when they changed, against when the years were made."""
    own = T.read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.substring("o_orderpriority", 1, 1).alias("product")).agg(F.to_date(F.max("o_orderdate")).alias("modified"))
    own = own.where("product IN ('1', '2') AND NOT (year = 1995 AND product = '2')").withColumn("file", F.concat_ws("_", "product", "year"))
    variables = F.when((F.col("product") == "2") & (F.col("year") % 4 == 1), F.lit(None)).when((F.col("product") == "1") & (F.col("year") % 3 == 0), F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    made = T.read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.date_sub(F.to_date(F.max("l_shipdate")), 2).alias("written")).where("year % 2 = 0 AND year <= 1997")
    return longs(reuse.vintage(own.withColumn("variables", variables), made, {"1": ["a", "b"], "2": ["a"]}))
