"""Rows and paths that several test modules use."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF0001 = "/root/testdata/sf0.001"


def cell(i, content, bg=None, merge=None, font=None, bold=False, fg_resolved=""):
    """Cell in the canonical struct form; ``merge`` = (start_col, end_col) on
    the row itself or a full (start_col, end_col, start_row, end_row)."""
    m = None
    if merge is not None:
        m = (merge[0], merge[1], merge[2], merge[3]) if len(merge) == 4 else (merge[0], merge[1], 0, 0)
    return (i, content, (bg, font, bold, False), (fg_resolved, ""), m)


def make_rows(spark, rows, file="t.xlsx"):
    """rows: list of cell lists (row_index = position) -> canonical rows."""
    from sheetlens.model import ROWS_SCHEMA

    data = [(file, 0, "Sheet1", i, [cell(*c) if isinstance(c, tuple) else c for c in r], None)
            for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ROWS_SCHEMA)
