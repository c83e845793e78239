"""Queries over orders beside their SQL, for keys that look like a year and keys of more than six digits."""

import datetime

import duckdb
import pytest

from plinth.plans import catalog
from tests.core.test_catalog import _plain

KEYS = [*range(1895, 1905), *range(1905, 2105, 3), *range(999_990, 1_000_010), *range(8_999_990, 9_000_000), *range(54_000_000, 54_000_010)]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("keys"))
    rows = [(k, k % 1000, "OFP"[k % 3], 1.0, datetime.datetime(1992 + k % 7, 1 + k % 12, 3), ("1-URGENT", "5-LOW")[k % 2]) for k in KEYS]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", ["act_token", "cite_air", "cite_crilj", "cite_ilr", "cite_insc", "cite_manu", "cite_neutral", "cite_scc", "cite_scc_online", "cite_scr", "cite_title_merge", "cite_union"])
def test_query_matches_sql_at_large_keys(spark, orders, name):
    df = catalog.queries()[name](spark, orders)
    names = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{orders}/orders.parquet/*.parquet'")
    ran = con.execute(catalog.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(ran.description)}
    want = sorted(tuple(_plain(r[at[c]]) for c in names) for r in ran.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in names) for r in df.collect()) == want and want
