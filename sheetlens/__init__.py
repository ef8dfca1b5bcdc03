"""sheetlens: Spark-native analysis of styled spreadsheet rows.

Workbooks become one ``rows`` DataFrame (one row per worksheet row, an array of
styled cells); rule profiles compile to plain Spark column expressions; the
summaries, colour analysis, table jobs, batch runs, run history and log tables
are DataFrame operators on top of it.
"""

from sheetlens.model import ROW_TYPES, ROWS_SCHEMA  # noqa: F401

__version__ = "0.1.0"
