import os
from decimal import Decimal

import duckdb
import pytest

from evtlake.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda rows: sorted(repr([str(v) if isinstance(v, Decimal) else v for v in r]) for r in rows)
    got = plain(df.select(*(f"`{c}`" for c in columns)).collect())
    want = plain(oracle.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({catalog.SQL[name]})").fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_decoding_is_one_pass(spark):
    plan = catalog.QUERIES["decode_events"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
