"""Canonical schemas and fixed names shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# The eight built-in row-type names, in declaration order.
ROW_TYPES = (
    "ProjectNumber",
    "CabinetNumber",
    "Header",
    "Data",
    "SubTotal",
    "UnitTotal",
    "GrandTotal",
    "Unknown",
)
UNKNOWN = "Unknown"
NO_RULE = "none"
CUSTOM_PREFIX = "custom:"

# The Unicode White_Space characters stripped by the trim used for
# cell contents (U+0009-U+000D, U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000).
UNICODE_WS = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

WHITE = "FFFFFF"

STYLE = T.StructType([
    T.StructField("background_color", T.StringType()),
    T.StructField("font_color", T.StringType()),
    T.StructField("bold", T.BooleanType()),
    T.StructField("italic", T.BooleanType()),
])
FILL = T.StructType([
    T.StructField("fg_resolved", T.StringType()),
    T.StructField("bg_resolved", T.StringType()),
])
MERGE = T.StructType([
    T.StructField("start_col", T.IntegerType()),
    T.StructField("end_col", T.IntegerType()),
    T.StructField("start_row", T.IntegerType()),
    T.StructField("end_row", T.IntegerType()),
])
CELL = T.StructType([
    T.StructField("column_index", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("style", STYLE),
    T.StructField("fill", FILL),
    T.StructField("merge_info", MERGE),
])
ROWS_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("sheet_index", T.IntegerType()),
    T.StructField("sheet_name", T.StringType()),
    T.StructField("row_index", T.LongType()),
    T.StructField("cells", T.ArrayType(CELL)),
    T.StructField("error", T.StringType()),
])
SHEET_KEY = ("file", "sheet_index")

ERROR_ENTRY = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("error_message", T.StringType()),
])
RUN_RESULT = T.StructType([
    T.StructField("total_files", T.LongType()),
    T.StructField("successful", T.LongType()),
    T.StructField("failed", T.LongType()),
    T.StructField("errors", T.ArrayType(ERROR_ENTRY)),
    T.StructField("duration", T.LongType()),
])
LEDGER_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("processor_id", T.StringType()),
    T.StructField("processor_name", T.StringType()),
    T.StructField("input_dir", T.StringType()),
    T.StructField("output_dir", T.StringType()),
    T.StructField("result", RUN_RESULT),
    T.StructField("status_path", T.StringType()),
])
# Log levels, in increasing severity.
LOG_LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
