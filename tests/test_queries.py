"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from postlake.plans import registry
from postlake.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.check_oracle import rows_of

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(NAMES)
    assert set(NAMES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = {r.platform: r.n for r in df.collect()}
    assert rows["total"] == sum(v for k, v in rows.items() if k != "total")
    assert rows["lemmy"] == 0
