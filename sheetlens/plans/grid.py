"""Sheet grid derived from ``lineitem``: one worksheet per order.

Each order becomes a sheet laid out like a cargo table: a project row (green,
merged over columns 0..10 except every ninth order), a cabinet row, a grey
header, one data row per line item, a pink total row and a blank row.  Two
columns; the flat form (c0, c1, bg0, bg1, m_start, m_end) is turned into the
canonical ``rows`` DataFrame (dense ``cells`` array of styled cells).

Built in one pass over ``lineitem``: line numbers come from the skew-safe
numbering, the five per-sheet rows are emitted by each sheet's first line item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.functions.text import argb_to_rgb
from sheetlens.operators.numbering import row_number_within
from sheetlens.plans.tables import table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

FLAT_FIELDS = ["row_index", "c0", "c1", "bg0", "bg1", "m_start", "m_end"]


def _row(row_index: Column, c0: Column, c1: Column, bg0: Column, bg1: Column,
         m_start: Column, m_end: Column, kind: str) -> Column:
    return F.struct(row_index.cast("bigint").alias("row_index"), F.lit(kind).alias("kind"), c0.cast("string").alias("c0"),
                    c1.cast("string").alias("c1"), bg0.cast("string").alias("bg0"),
                    bg1.cast("string").alias("bg1"), m_start.cast("int").alias("m_start"),
                    m_end.cast("int").alias("m_end"))


def flat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet_id, row_index, kind, c0, c1, bg0, bg1, m_start, m_end)."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", *LINE_ORDER)
    li = row_number_within(li, ["l_orderkey"], LINE_ORDER, name="rn", count_name="n")
    sid, rn, n = F.col("l_orderkey"), F.col("rn"), F.col("n")
    null = F.lit(None)
    no_merge = sid % 9 == 0
    data = _row(F.lit(2) + rn, rn, F.col("l_partkey"),
                F.when(F.col("l_returnflag") == "R", F.lit("FFFFFFFF"))
                 .when((F.col("l_returnflag") == "A") & (rn == 3), F.lit("FF646464")),
                null, null, null, "data")
    project = _row(F.lit(0), F.concat(F.lit("G00E-"), sid.cast("string")), F.lit(""), F.lit("FFC6EFCE"), null,
                   F.when(~no_merge, F.lit(0)), F.when(~no_merge, F.lit(10)), "project")
    cabinet = _row(F.lit(1), F.lit(""),
                   F.concat(F.when(sid % 4 == 0, F.lit("CAB-")).otherwise(F.lit("柜号: ")), (sid % 50).cast("string")),
                   F.when(sid % 2 == 0, F.lit("FF7F9698")), null, null, null, "cabinet")
    header = _row(F.lit(2), F.lit("序号"), F.lit("物料"), F.lit("FFD9D9D9"), F.lit("FFD9D9D9"), null, null, "header")
    total_text = (F.when(sid % 4 == 0, F.lit(" 单台合计 ")).when(sid % 4 == 1, F.lit("小计: "))
                   .when(sid % 4 == 2, F.lit("总计")).otherwise(F.lit("单台合计/小计")))
    total = _row(F.lit(3) + n, total_text, F.lit(""), F.lit("FFFFCCFD"), null, null, null, "total")
    blank = _row(F.lit(4) + n, F.lit(""), F.lit("  "), null, null, null, null, "blank")
    emitted = F.slice(F.array(data, project, cabinet, header, total, blank), 1,
                      F.when(rn == 1, F.lit(6)).otherwise(F.lit(1)))
    return li.select(sid.alias("sheet_id"), F.inline(emitted))


def sheet_file(sheet_id: Column) -> Column:
    return F.concat(F.lit("order_"), sheet_id.cast("string"), F.lit(".xlsx"))


def _cell(ci: int, content: Column, argb: Column, m_start: Column, m_end: Column, row_index: Column) -> Column:
    inside = m_start.isNotNull() & (F.lit(ci) >= m_start) & (F.lit(ci) <= m_end)
    return F.struct(
        F.lit(ci).alias("column_index"),
        content.alias("content"),
        F.struct(argb_to_rgb(argb).alias("background_color"), F.lit(None).cast("string").alias("font_color"),
                 F.lit(False).alias("bold"), F.lit(False).alias("italic")).alias("style"),
        F.struct(F.coalesce(argb, F.lit("")).alias("fg_resolved"), F.lit("").alias("bg_resolved")).alias("fill"),
        F.when(inside, F.struct(m_start.alias("start_col"), m_end.alias("end_col"),
                                row_index.cast("int").alias("start_row"),
                                row_index.cast("int").alias("end_row"))).alias("merge_info"))


def flat_to_rows(flat: DataFrame) -> DataFrame:
    """Flat two-column grid -> canonical ``rows``.  A sheet in DataFrame form has
    no row limit; only real workbook files do (:mod:`sheetlens.plans.workbooks`)."""
    ri, ms, me = F.col("row_index"), F.col("m_start"), F.col("m_end")
    return flat.select(
        sheet_file(F.col("sheet_id")).alias("file"),
        F.lit(0).alias("sheet_index"),
        F.lit("Sheet1").alias("sheet_name"),
        ri.alias("row_index"),
        F.array(_cell(0, F.col("c0"), F.col("bg0"), ms, me, ri),
                _cell(1, F.col("c1"), F.col("bg1"), ms, me, ri)).alias("cells"),
        F.lit(None).cast("string").alias("error"))


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_to_rows(flat_grid(spark, sf_dir))


def table_as_rows(df: DataFrame, index_col: str, columns: list[str], file: str = "table.xlsx") -> DataFrame:
    """Any table as sheet rows: one row per record, one unstyled cell per
    column (text of the value, '' for NULL), ``row_index`` from a column."""
    cells = F.array(*[F.struct(
        F.lit(i).alias("column_index"),
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias("content"),
        F.struct(F.lit(None).cast("string").alias("background_color"), F.lit(None).cast("string").alias("font_color"),
                 F.lit(False).alias("bold"), F.lit(False).alias("italic")).alias("style"),
        F.struct(F.lit("").alias("fg_resolved"), F.lit("").alias("bg_resolved")).alias("fill"),
        F.lit(None).cast("struct<start_col:int,end_col:int,start_row:int,end_row:int>").alias("merge_info"))
        for i, c in enumerate(columns)])
    return df.select(F.lit(file).alias("file"), F.lit(0).alias("sheet_index"), F.lit("Sheet1").alias("sheet_name"),
                     F.col(index_col).cast("bigint").alias("row_index"), cells.alias("cells"),
                     F.lit(None).cast("string").alias("error"))
