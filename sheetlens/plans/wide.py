"""Wide, many-coloured sheets derived from ``lineitem``: one sheet per supplier.

A row for every line item with eight cells.  Every third line has one colour over six
cells; the others mix twelve colours and none.  So sheets reach the limits that the
two-column grid cannot: more than eight colours, more than five columns, and rows whose
most frequent colour is or is not a majority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.functions.text import argb_to_rgb
from sheetlens.operators.numbering import row_number_within
from sheetlens.plans.tables import table

COLUMNS = 8
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus", "l_shipdate"]

WIDE_SQL = """
WITH n AS (SELECT l_suppkey, l_partkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber,
           l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS row_index FROM lineitem),
x AS (SELECT *, unnest(range(0, 8)) AS c FROM n),
y AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN c < 6 THEN l_partkey % 12 ELSE 12 END
                     ELSE (l_partkey + 7 * c + l_linenumber) % 14 END AS k FROM x),
w AS (SELECT 'supplier_' || CAST(l_suppkey AS VARCHAR) || '.xlsx' AS file, row_index, c,
             CASE WHEN k < 12 THEN lpad(hex(k * 1300021 + 4660), 6, '0') END AS hex FROM y)
"""


def with_wide(select_sql: str) -> str:
    """``WITH ... w AS (file, row_index, c, hex)`` + a SELECT."""
    return WIDE_SQL + select_sql


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows of the sheets."""
    li = row_number_within(table(spark, sf_dir, "lineitem", "l_suppkey", *ORDER), ["l_suppkey"], ORDER, name="rn")
    part, line = F.col("l_partkey"), F.col("l_linenumber")

    def cell(i: int) -> Column:
        one = part % 12 if i < 6 else F.lit(12)
        k = F.when(line % 3 == 0, one).otherwise((part + 7 * i + line) % 14)
        argb = F.when(k < 12, F.concat(F.lit("FF"), F.lpad(F.hex((k * 1300021 + 4660).cast("bigint")), 6, "0")))
        return F.struct(
            F.lit(i).alias("column_index"), F.concat(F.lit(f"{i}:"), part.cast("string")).alias("content"),
            F.struct(argb_to_rgb(argb).alias("background_color"), F.lit(None).cast("string").alias("font_color"),
                     F.lit(False).alias("bold"), F.lit(False).alias("italic")).alias("style"),
            F.struct(F.coalesce(argb, F.lit("")).alias("fg_resolved"), F.lit("").alias("bg_resolved")).alias("fill"),
            F.lit(None).cast("struct<start_col:int,end_col:int,start_row:int,end_row:int>").alias("merge_info"))

    return li.select(F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string"), F.lit(".xlsx")).alias("file"),
                     F.lit(0).alias("sheet_index"), F.lit("Sheet1").alias("sheet_name"), (F.col("rn") - 1).alias("row_index"),
                     F.array(*[cell(i) for i in range(COLUMNS)]).alias("cells"), F.lit(None).cast("string").alias("error"))
