"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from gridwell.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def plain(table: pd.DataFrame) -> pd.DataFrame:
    table = table[sorted(table.columns)].copy()
    for c in table.columns:
        if len(table) and (hasattr(table[c].iloc[0], "isoformat") or str(table[c].dtype).startswith("datetime")):
            table[c] = pd.to_datetime(table[c]).dt.strftime("%Y-%m-%d")
    return table.astype(str).sort_values(list(table.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sql, name):
    own = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    assert len(own) > 0 or name in ("q_coverage_missing", "q_argo_colocate", "q_running_mean_w90")
    if name in catalogue.ORACLES:
        pd.testing.assert_frame_equal(plain(own), plain(sql.execute(catalogue.ORACLES[name]).fetchdf()))
