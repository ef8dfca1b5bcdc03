"""Every registered query with an oracle: Spark result == DuckDB result at
sf0.001 (row count, column names, order-insensitive value hash)."""

import os
import sys

import pytest

from rows import ROOT, SF0001

sys.path.insert(0, os.path.join(ROOT, "tools"))
from oracle_check import TABLES, digest  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

QS = queries()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    from sheetlens.plans.queries import ORACLE, QUERIES

    assert set(ORACLE) == set(QUERIES), sorted(set(ORACLE) ^ set(QUERIES))
    assert set(SQL) <= set(QS)


def test_entry(spark):
    df = entry(spark)
    assert set(df.columns) == {"row_type", "n_rows"}
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QS[name](spark, SF0001)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols, drows = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    hs, ls = digest(scols, srows)
    hd, ld = digest(dcols, drows)
    assert hs == hd, (sorted(set(ls) - set(ld))[:3], sorted(set(ld) - set(ls))[:3])
