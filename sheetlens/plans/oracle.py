"""Portable SQL (DuckDB / Spark SQL) for the fixtures, used by the oracle queries."""

# The sheet grid: same layout as plans.grid.flat_grid.
GRID_SQL = """
WITH li AS (
  SELECT l_orderkey AS sheet_id, l_partkey, l_returnflag,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                            l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn,
         COUNT(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem),
sh AS (SELECT DISTINCT sheet_id, n FROM li)
SELECT sheet_id, CAST(0 AS BIGINT) AS row_index, 'G00E-' || CAST(sheet_id AS VARCHAR) AS c0, '' AS c1,
       CAST('FFC6EFCE' AS VARCHAR) AS bg0, CAST(NULL AS VARCHAR) AS bg1,
       CASE WHEN sheet_id % 9 = 0 THEN NULL ELSE 0 END AS m_start,
       CASE WHEN sheet_id % 9 = 0 THEN NULL ELSE 10 END AS m_end FROM sh
UNION ALL SELECT sheet_id, CAST(1 AS BIGINT), '',
       CASE WHEN sheet_id % 4 = 0 THEN 'CAB-' ELSE '柜号: ' END || CAST(sheet_id % 50 AS VARCHAR),
       CASE WHEN sheet_id % 2 = 0 THEN 'FF7F9698' END, NULL, NULL, NULL FROM sh
UNION ALL SELECT sheet_id, CAST(2 AS BIGINT), '序号', '物料', 'FFD9D9D9', 'FFD9D9D9', NULL, NULL FROM sh
UNION ALL SELECT sheet_id, 2 + rn, CAST(rn AS VARCHAR), CAST(l_partkey AS VARCHAR),
       CASE WHEN l_returnflag = 'R' THEN 'FFFFFFFF' WHEN l_returnflag = 'A' AND rn = 3 THEN 'FF646464' END,
       NULL, NULL, NULL FROM li
UNION ALL SELECT sheet_id, 3 + n,
       CASE sheet_id % 4 WHEN 0 THEN ' 单台合计 ' WHEN 1 THEN '小计: ' WHEN 2 THEN '总计' ELSE '单台合计/小计' END,
       '', 'FFFFCCFD', NULL, NULL, NULL FROM sh
UNION ALL SELECT sheet_id, 4 + n, '', '  ', NULL, NULL, NULL, NULL FROM sh
"""

FILE_SQL = "'order_' || CAST(sheet_id AS VARCHAR) || '.xlsx'"

# File of a grid row in workbook form: a sheet is cut into files of 1,000,000 rows (plans.workbooks.CHUNK_ROWS).
WORKBOOK_SQL = ("'order_' || CAST(sheet_id AS VARCHAR) || CASE WHEN row_index >= 1000000 "
            "THEN '~' || CAST(row_index // 1000000 AS VARCHAR) ELSE '' END || '.xlsx'")

# DuckDB spelling of the Unicode trim set, so trim() agrees with utrim().
WS = ("chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)"
      "||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)"
      "||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)")


def utrim(expr: str) -> str:
    return f"trim({expr}, {WS})"


# Grid with file name, first-non-empty colour (ARGB) / content, the seven cargo
# predicates p1..p7 in profile order, and the winning row type.
CLASSIFIED_SQL = """
g AS (""" + GRID_SQL + """),
f AS (SELECT *, """ + FILE_SQL + """ AS file,
             CASE WHEN trim(c0) <> '' THEN coalesce(bg0, 'FFFFFFFF')
                  WHEN trim(c1) <> '' THEN coalesce(bg1, 'FFFFFFFF') END AS fc,
             CASE WHEN trim(c0) <> '' THEN c0 WHEN trim(c1) <> '' THEN c1 END AS fnc FROM g),
p AS (SELECT *,
   coalesce(fc = 'FFC6EFCE', false) AND coalesce(m_start = 0 AND m_end = 10, false) AS p1,
   coalesce(fc = 'FF7F9698', false) OR coalesce(contains(lower(trim(c1)), '柜号:'), false) AS p2,
   coalesce(fc = 'FFD9D9D9', false) AS p3,
   coalesce(fc = 'FFFFCCFD', false) AND contains(lower(trim(c0)), '单台合计') AS p4,
   coalesce(fc = 'FFFFCCFD', false) AND contains(lower(trim(c0)), '小计') AS p5,
   coalesce(fc = 'FFFFCCFD', false) AND contains(lower(trim(c0)), '总计') AS p6,
   coalesce(fc = 'FFFFFFFF', false) AS p7 FROM f),
cw AS (SELECT *, CASE WHEN p1 THEN 1 WHEN p2 THEN 2 WHEN p3 THEN 3 WHEN p4 THEN 4 WHEN p5 THEN 5 WHEN p6 THEN 6
                     WHEN p7 THEN 7 ELSE 8 END AS win FROM p),
c AS (SELECT *,
   CASE win WHEN 1 THEN 'ProjectNumber' WHEN 2 THEN 'CabinetNumber' WHEN 3 THEN 'Header' WHEN 4 THEN 'UnitTotal'
            WHEN 5 THEN 'SubTotal' WHEN 6 THEN 'GrandTotal' WHEN 7 THEN 'Data' ELSE 'Unknown' END AS row_type,
   CASE win WHEN 1 THEN 'project_number_rule' WHEN 2 THEN 'cabinet_number_rule' WHEN 3 THEN 'gray_background'
            WHEN 4 THEN 'unit_total_rule' WHEN 5 THEN 'subtotal_rule' WHEN 6 THEN 'grand_total_rule'
            WHEN 7 THEN 'white_or_no_background' ELSE 'none' END AS matched_rule,
   CASE WHEN win < 8 THEN 1.0 ELSE 0.0 END AS confidence FROM cw)
"""


def with_classified(select_sql: str) -> str:
    """``WITH ...`` + a SELECT over ``c`` (the classified grid)."""
    return "WITH " + CLASSIFIED_SQL + select_sql


def with_grid(select_sql: str) -> str:
    """``WITH g AS (grid), f AS (grid + file)`` + a SELECT."""
    return "WITH g AS (" + GRID_SQL + "), f AS (SELECT *, " + FILE_SQL + " AS file FROM g) " + select_sql


def with_workbooks(select_sql: str) -> str:
    """Like :func:`with_grid`, for the grid written as workbook files."""
    return ("WITH g AS (" + GRID_SQL + "), f AS (SELECT * REPLACE (row_index % 1000000 AS row_index), " + WORKBOOK_SQL
            + " AS file FROM g) " + select_sql)
