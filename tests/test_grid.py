"""Grid fixture: sheets without a row limit; carry-forward; header promotion."""

import random

import pytest
from pyspark.sql import functions as F

from rows import make_rows
from sheetlens.operators.tables import promote_header
from sheetlens.operators.classify import classify
from sheetlens.operators.extract import cargo_summary, with_context
from sheetlens.operators.profiles import cargo_analysis
from sheetlens.plans.grid import flat_to_rows


def test_sheet_of_more_than_a_million_rows_is_one_sheet(spark):
    n = 1_050_000
    rows = spark.range(n).select(
        F.lit(7).cast("bigint").alias("sheet_id"), F.col("id").alias("row_index"),
        F.when(F.col("id").isin(0, 1_000_500), F.concat(F.lit("P"), F.col("id").cast("string"))).otherwise(F.lit("x")).alias("c0"),
        F.lit("y").alias("c1"), F.when(F.col("id").isin(0, 1_000_500), "FFC6EFCE").alias("bg0"),
        F.lit(None).cast("string").alias("bg1"), F.when(F.col("id").isin(0, 1_000_500), 0).alias("m_start"),
        F.when(F.col("id").isin(0, 1_000_500), 10).alias("m_end"))
    c = classify(flat_to_rows(rows), cargo_analysis())
    s = cargo_summary(c).collect()
    assert [tuple(r) for r in s] == [("order_7.xlsx", "P0, P1000500", 0, n - 2)]
    ctx = with_context(c).groupBy("project_number").agg(F.count("*").alias("n"), F.min("row_index").alias("a"))
    assert sorted(map(tuple, ctx.collect())) == [("P0", 1_000_500, 0), ("P1000500", n - 1_000_500, 1_000_500)]


def test_context_in_small_ranges_equals_one_window(spark):
    kinds = [("ProjectNumber", "p"), ("CabinetNumber", "c"), ("Data", "d"), ("Data", "d"), ("Data", "d")]
    rnd = random.Random(3)
    rows, want = [], {}
    for file in "ab":
        p = c = None
        for i in range(200 if file == "a" else 7):
            kind, t = rnd.choice(kinds[:2] + kinds[2:] * 8)
            text = f"{t}{i}"
            p, c = (text if kind == "ProjectNumber" else p), (text if kind == "CabinetNumber" else c)
            rows.append((file, 0, i, kind, text))
            want[file, i] = (p, c)
    df = spark.createDataFrame(rows, "file string, sheet_index int, row_index bigint, row_type string, t string")
    cell = lambda k: F.struct(F.lit(k).alias("column_index"), F.col("t").alias("content"))
    df = df.withColumn("cells", F.array(cell(0), cell(1)))
    for size in (1, 3, 50, 1000):
        got = {(r.file, r.row_index): (r.project_number, r.cabinet) for r in with_context(df, size).collect()}
        assert got == want


def test_promote_header(spark):
    rows = make_rows(spark, [[(0, "a"), (1, "")], [(0, "1"), (1, "2")], [(0, "3")]])
    t = promote_header(rows)
    assert t.columns == ["file", "sheet_index", "row_index", "a", "Column_1"]
    assert [(r["a"], r["Column_1"]) for r in t.orderBy("row_index").collect()] == [("1", "2"), ("3", "")]
    mixed = rows.unionByName(make_rows(spark, [[(0, "x")]], file="u.xlsx"))
    with pytest.raises(ValueError):
        promote_header(mixed)
    dup = make_rows(spark, [[(0, "a"), (1, "a")], [(0, "1"), (1, "2")]])
    with pytest.raises(ValueError):
        promote_header(dup)


def test_dominant_rows_dense_width_equals_sheet_size(spark):
    from sheetlens.operators.structure import dominant_rows, sheet_size

    def c(i, fill):                   # rows.cell arguments: index, content, bg, merge, font, bold, fg_resolved
        return (i, "x", None, None, None, False, fill)
    rows = make_rows(spark, [[c(0, "FFAA0000"), c(1, "FFAA0000"), c(2, "")],
                             [c(0, "FFAA0000"), c(1, "FF00BB00"), c(2, "FF00BB00")],
                             [c(0, ""), c(1, ""), c(2, "")]])
    a = sorted(tuple(r) for r in dominant_rows(rows).collect())
    b = sorted(tuple(r) for r in dominant_rows(rows, sheet_size(rows)).collect())
    assert a == b == [("t.xlsx", 0, 0, "AA0000", 2), ("t.xlsx", 0, 1, "00BB00", 2)]
    one = make_rows(spark, [[c(0, "FFAA0000")]], file="w1.xlsx")          # width 1 never reports
    assert dominant_rows(one).count() == 0
