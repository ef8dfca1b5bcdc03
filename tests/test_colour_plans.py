"""Colour queries make a row's cells and its colours once."""

from pyspark.sql import functions as F

from sheetlens.operators import structure as S
from sheetlens.plans.wide import wide_rows
from sheetlens.sources.manifest import pick_sheet


def _lineitem(spark, folder):
    rows = [(1 + i // 4, i, i % 2, 1 + i % 5, float(i), 1.0, 0.0, 0.0, "R", "O", None) for i in range(40)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_made_once(spark, tmp_path):
    rows = wide_rows(spark, _lineitem(spark, tmp_path / "t"))
    once = _optimized(rows).count("RLIKE")
    for df in (S.color_histogram(rows), S.dominant_rows(rows)):
        assert "explode(array(cells" in _optimized(df)
        assert _optimized(df).count("RLIKE") <= once
    assert _optimized(S.dominant_rows(rows)).count("regexp_replace") <= 3     # of one cell's colour


def test_structure_job_makes_its_rows_once(spark, tmp_path):
    out = S.analyze_structure(wide_rows(spark, _lineitem(spark, tmp_path / "t")), colors=True)
    assert all("Window [row_number() windowspecdefinition(l_suppkey" not in _optimized(out[k]) for k in out)
    assert out["size"].count() == 2 and out["dump"].count() == 40


def test_pick_sheet_keeps_the_chosen_sheets_only(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 2, "x"), ("b", 2, "x"), (None, 0, "x"), ("c", None, "x")],
                                 "file string, sheet_index int, sheet_name string")
    got = lambda s: sorted((r.file, r.sheet_index) for r in pick_sheet(rows, s).collect())
    assert got(None) == [("a", 0), ("b", 2), ("b", 2)]
    assert got("y") == [("a", 1), ("b", 2), ("b", 2)]


def test_explained_rules_are_evaluated_once(spark, tmp_path):
    from sheetlens.operators.classify import explain_rows
    from sheetlens.operators.profiles import cargo_analysis
    from sheetlens.plans.grid import grid_rows

    plan = _optimized(explain_rows(grid_rows(spark, _lineitem(spark, tmp_path / "t")), cargo_analysis()))
    assert plan.count("subtotal_rule") == 1 and "explode(array(_ev" in plan
