"""Every registered query beside its SQL, on the smallest tables; the driver does the same at a larger size."""

import math
import os

import duckdb
import pytest

from plinth.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(float(v)) else repr(round(float(v), 5) + 0.0)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, name):
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    if name not in catalog.oracle_sql():
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ran = con.execute(catalog.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(ran.description)}
    assert sorted(at) == names
    assert got == sorted(tuple(_plain(r[at[c]]) for c in names) for r in ran.fetchall())
