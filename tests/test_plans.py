"""Plan checks: scans read only the needed columns; classification adds no
shuffle on top of its input."""

import re

from rows import SF0001
from __spark_entry__ import queries

QS = queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _read_schemas(plan: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]


def test_scans_are_pruned(spark):
    schemas = _read_schemas(_plan(QS["dedupe_rows"](spark, SF0001)))
    assert schemas == [{"l_returnflag", "l_linestatus", "l_quantity"}]
    for name in ("row_type_counts", "log_filter", "ledger_by_processor", "search_rows"):
        for cols in _read_schemas(_plan(QS[name](spark, SF0001))):
            assert "l_comment" not in cols and "o_comment" not in cols and "value" not in cols, (name, cols)


def test_search_filter_reaches_the_scan_projection(spark):
    plan = _plan(QS["search_rows"](spark, SF0001))
    assert _read_schemas(plan) == [{"p_partkey", "p_name", "p_type"}]


def test_classification_adds_no_exchange(spark):
    from sheetlens.operators.classify import classify
    from sheetlens.operators.profiles import cargo_analysis
    from sheetlens.plans.queries import grid

    g = grid(spark, SF0001)
    before = _plan(g).count("Exchange")
    after = _plan(classify(g, cargo_analysis())).count("Exchange")
    assert after == before
