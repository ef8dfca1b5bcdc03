"""Registered queries: each reads the given tables (or data Spark derives from
them) and, where SQL can express it, has a DuckDB oracle with the same
column names.  Float outputs are rounded to 6 places as DOUBLE on both sides."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.functions.cells import contents
from sheetlens.functions.text import argb_to_rgb, display_hex
from sheetlens.operators import classify as C
from sheetlens.operators import extract as X
from sheetlens.operators import structure as S
from sheetlens.operators import tables as TB
from sheetlens.operators.merges import assign_merges
from sheetlens.operators.profiles import auxiliary_material, cargo_analysis
from sheetlens.operators.rules import (
    And, ColorRule, Contains, Exact, MergeRule, MergedAcross, MergedMinColumns, NotMerged, Or, Regex, TextRule,
)
from sheetlens.operators.rule_tables import classify_by_table, rule_table
from sheetlens.plans.grid import flat_grid, flat_to_rows, sheet_file, table_as_rows
from sheetlens.plans.oracle import utrim as sql_utrim
from sheetlens.plans.oracle import with_classified, with_grid, with_workbooks
from sheetlens.plans.tables import table
from sheetlens.plans.wide import wide_rows, with_wide

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_to_rows(flat_grid(spark, sf_dir))


def classified_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(grid(spark, sf_dir), cargo_analysis())


def _text(values) -> "F.Column":
    return F.array_join(values, "|")


# ---------------------------------------------------------------- classification

@register("row_type_counts", with_classified(
    "SELECT row_type, COUNT(*) AS n_rows FROM c GROUP BY row_type"))
def row_type_counts(spark, sf_dir):
    return C.type_counts(classified_grid(spark, sf_dir))


@register("classified_rows", with_classified(
    "SELECT file, row_index, row_type, matched_rule, round(confidence, 6) AS confidence FROM c"))
def classified_rows(spark, sf_dir):
    return classified_grid(spark, sf_dir).select(
        "file", "row_index", "row_type", "matched_rule", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


@register("classification_stats", with_classified(
    "SELECT file, 0 AS sheet_index, COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE row_type = 'Unknown') AS unknown_count, "
    "round((COUNT(*) - COUNT(*) FILTER (WHERE row_type = 'Unknown')) / COUNT(*), 6) AS success_rate, "
    "COUNT(*) FILTER (WHERE row_type = 'Data') AS data_count FROM c GROUP BY file"))
def classification_stats(spark, sf_dir):
    st = C.statistics(classified_grid(spark, sf_dir), profile=cargo_analysis())
    return st.select("file", "sheet_index", "total_rows", "unknown_count",
                     F.round((F.col("total_rows") - F.col("unknown_count")) / F.col("total_rows"), 6).alias("success_rate"),
                     F.coalesce(F.col("row_type_counts")["Data"], F.lit(0)).alias("data_count"))


@register("aux_profile_counts", with_classified(
    "SELECT CASE WHEN coalesce(fc = 'FFFFFFFF', false) THEN 'Data' ELSE 'Unknown' END AS row_type, COUNT(*) AS n_rows "
    "FROM c GROUP BY 1"))
def aux_profile_counts(spark, sf_dir):
    return C.type_counts(C.classify(grid(spark, sf_dir), auxiliary_material()))


_MIXED = {1: "cargo_analysis", 2: "auxiliary_material"}     # by order number modulo 3; the others have no profile


@register("mixed_profiles", with_classified(
    "SELECT file, row_index, CASE sheet_id % 3 WHEN 1 THEN row_type WHEN 2 THEN CASE WHEN p7 THEN 'Data' ELSE 'Unknown' END "
    "ELSE 'Unknown' END AS row_type, CASE sheet_id % 3 WHEN 1 THEN matched_rule WHEN 2 THEN CASE WHEN p7 THEN 'default_rule' "
    "ELSE 'none' END ELSE 'none' END AS matched_rule, CASE sheet_id % 3 WHEN 1 THEN confidence WHEN 2 THEN "
    "CASE WHEN p7 THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS confidence FROM c"))
def mixed_profiles(spark, sf_dir):
    """Files of two profiles and of none in one job, the profiles' rules joined from a table."""
    rules = rule_table(spark, {p.name: p for p in (cargo_analysis(), auxiliary_material())})
    order = F.regexp_extract("file", r"\d+", 0).cast("long") % 3
    name = F.when(order == 1, F.lit(_MIXED[1])).when(order == 2, F.lit(_MIXED[2]))
    return classify_by_table(grid(spark, sf_dir).withColumn("profile", name), rules).select(
        "file", "row_index", "row_type", "matched_rule", F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


@register("rule_conflicts", with_classified(
    "SELECT file, row_index, 6 AS priority, 'unit_total_rule' AS rule1, 'UnitTotal' AS type1, "
    "'subtotal_rule' AS rule2, 'SubTotal' AS type2 FROM c WHERE p4 AND p5"))
def rule_conflicts(spark, sf_dir):
    return C.conflicts(grid(spark, sf_dir), cargo_analysis()).select(
        "file", "row_index", "priority", "rule1", "type1", "rule2", "type2")


_STEPS = [(1, "ProjectNumber", "project_number_rule", 9), (2, "CabinetNumber", "cabinet_number_rule", 8),
          (3, "Header", "gray_background", 7), (4, "UnitTotal", "unit_total_rule", 6),
          (5, "SubTotal", "subtotal_rule", 6), (6, "GrandTotal", "grand_total_rule", 5),
          (7, "Data", "white_or_no_background", 1)]


@register("explain_rows", with_classified(
    "SELECT file, row_index, s.step, s.row_type, s.rule, s.priority, CASE s.step " + " ".join(
        f"WHEN {k} THEN p{k}" for k, _, _, _ in _STEPS) + " END AS matched FROM c, (VALUES " + ", ".join(
        f"({k}, '{t}', '{r}', {p})" for k, t, r, p in _STEPS) + ") s(step, row_type, rule, priority) "
    "WHERE s.step <= win"))
def explain_rows(spark, sf_dir):
    return C.explain_rows(grid(spark, sf_dir), cargo_analysis()).select(
        "file", "row_index", "step", "row_type", "rule", "priority", "matched")


@register("all_matches", with_classified(
    "SELECT file, row_index, concat_ws(',', " + ", ".join(
        f"CASE WHEN p{k} THEN '{r}' END" for k, _, r, _ in _STEPS) + ") AS matches FROM c"))
def all_matches(spark, sf_dir):
    m = C.all_matches(grid(spark, sf_dir), cargo_analysis())
    return m.select("file", "row_index", F.array_join(F.transform("matches", lambda x: x["rule"]), ",").alias("matches"))


# ---------------------------------------------------------------- cargo extraction

@register("cargo_summary", with_classified(
    "SELECT file, coalesce(string_agg(CASE WHEN row_type = 'ProjectNumber' THEN fnc END, ', ' ORDER BY row_index), '') "
    "AS 项目编号, CAST(COUNT(*) FILTER (WHERE row_type = 'CabinetNumber') AS INTEGER) AS 柜号数量, "
    "CAST(COUNT(*) FILTER (WHERE row_type = 'Data') AS INTEGER) AS 数据行数量 FROM c GROUP BY file"))
def cargo_summary(spark, sf_dir):
    # the sheet list comes from the order keys (a one-column distinct), not from a second pass over the grid
    files = table(spark, sf_dir, "lineitem", "l_orderkey").select(sheet_file(F.col("l_orderkey")).alias("file"))
    return X.cargo_summary(classified_grid(spark, sf_dir), files=files)


@register("data_rows", with_classified(
    "SELECT file, row_index, c0 || '|' || c1 AS values_text FROM c WHERE row_type = 'Data'"))
def data_rows(spark, sf_dir):
    return X.data_rows(classified_grid(spark, sf_dir)).select("file", "row_index", _text("values").alias("values_text"))


@register("project_rows", with_classified(
    "SELECT file, row_index, fnc AS project_number FROM c WHERE row_type = 'ProjectNumber'"))
def project_rows(spark, sf_dir):
    return X.project_rows(classified_grid(spark, sf_dir)).select("file", "row_index", "project_number")


@register("cabinet_rows", with_classified(
    "SELECT file, row_index, c1 AS cabinet FROM c WHERE row_type = 'CabinetNumber'"))
def cabinet_rows(spark, sf_dir):
    return X.cabinet_rows(classified_grid(spark, sf_dir)).select("file", "row_index", "cabinet")


@register("with_context", with_classified(
    "SELECT file, row_index, row_type, "
    "last_value(CASE WHEN row_type = 'ProjectNumber' THEN fnc END IGNORE NULLS) OVER "
    "(PARTITION BY file ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS project_number, "
    "last_value(CASE WHEN row_type = 'CabinetNumber' THEN c1 END IGNORE NULLS) OVER "
    "(PARTITION BY file ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cabinet FROM c"))
def with_context(spark, sf_dir):
    return X.with_context(classified_grid(spark, sf_dir)).select(
        "file", "row_index", "row_type", "project_number", "cabinet")


# ---------------------------------------------------------------- leaf / composite rules

def _rule_rows(spark, sf_dir, rule):
    return grid(spark, sf_dir).where(rule.to_column()).select("file", "row_index")


_IN_RANGE = "m_start IS NOT NULL AND m_start <= 1 AND m_end >= 0"


@register("merged_across", with_grid("SELECT file, row_index FROM f WHERE m_start = 0 AND m_end = 10"))
def merged_across(spark, sf_dir):
    return _rule_rows(spark, sf_dir, MergeRule("m", MergedAcross(0, 10)))


@register("merged_min_columns", with_grid(
    f"SELECT file, row_index FROM f WHERE {_IN_RANGE} AND m_end - m_start + 1 >= 5"))
def merged_min_columns(spark, sf_dir):
    return _rule_rows(spark, sf_dir, MergeRule("m", MergedMinColumns(5)))


@register("not_merged", with_grid(f"SELECT file, row_index FROM f WHERE NOT coalesce({_IN_RANGE}, false)"))
def not_merged(spark, sf_dir):
    return _rule_rows(spark, sf_dir, MergeRule("m", NotMerged()))


@register("nested_composite", with_classified(
    "SELECT file, row_index FROM c WHERE (coalesce(fc = 'FFC6EFCE', false) AND contains(trim(c0), 'G00E')) "
    "OR contains(trim(c0), '项目')"))
def nested_composite(spark, sf_dir):
    rule = Or("outer", And("inner", ColorRule("green", "C6EFCE"), TextRule("g", 0, Contains("G00E"))),
              TextRule("p", 0, Contains("项目")))
    return _rule_rows(spark, sf_dir, rule)


@register("color_rule_column", with_grid(
    "SELECT file, row_index FROM f WHERE coalesce(bg1, 'FFFFFFFF') = 'FFD9D9D9'"))
def color_rule_column(spark, sf_dir):
    return _rule_rows(spark, sf_dir, ColorRule("c1_grey", (217, 217, 217), column_index=1))


@register("text_exact",
          f"SELECT p_partkey, coalesce({sql_utrim('p_type')} = 'ECONOMY', false) AS matched FROM part")
def text_exact(spark, sf_dir):
    rows = table_as_rows(table(spark, sf_dir, "part", "p_partkey", "p_type"), "p_partkey", ["p_type"])
    return rows.select(F.col("row_index").alias("p_partkey"),
                       TextRule("t", 0, Exact("ECONOMY")).to_column().alias("matched"))


@register("text_exact_ci",
          f"SELECT p_partkey, coalesce(lower({sql_utrim('p_brand')}) = 'brand#1', false) AS matched FROM part")
def text_exact_ci(spark, sf_dir):
    rows = table_as_rows(table(spark, sf_dir, "part", "p_partkey", "p_brand"), "p_partkey", ["p_brand"])
    return rows.select(F.col("row_index").alias("p_partkey"),
                       TextRule("t", 0, Exact("BRAND#1"), case_sensitive=False).to_column().alias("matched"))


@register("text_contains",
          f"SELECT doc_id, coalesce(contains(lower({sql_utrim('text')}), 'the'), false) AS matched FROM documents")
def text_contains(spark, sf_dir):
    rows = table_as_rows(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", ["text"])
    return rows.select(F.col("row_index").alias("doc_id"),
                       TextRule("t", 0, Contains("The"), case_sensitive=False).to_column().alias("matched"))


_URL_RE = r"^https://[a-z]+\.example\.(com|org)/(en|fr)/[0-9]+"


@register("text_regex",
          f"SELECT page_id, coalesce(regexp_matches({sql_utrim('url')}, '{_URL_RE}'), false) AS matched FROM pages")
def text_regex(spark, sf_dir):
    rows = table_as_rows(table(spark, sf_dir, "pages", "page_id", "url"), "page_id", ["url"])
    return rows.select(F.col("row_index").alias("page_id"),
                       TextRule("t", 0, Regex(_URL_RE)).to_column().alias("matched"))


@register("text_regex_ci",
          f"SELECT page_id, coalesce(regexp_matches({sql_utrim('url')}, 'EXAMPLE\\.(NET|ORG)/EN', 'i'), false) AS matched "
          "FROM pages")
def text_regex_ci(spark, sf_dir):
    rows = table_as_rows(table(spark, sf_dir, "pages", "page_id", "url"), "page_id", ["url"])
    return rows.select(F.col("row_index").alias("page_id"),
                       TextRule("t", 0, Regex(r"EXAMPLE\.(NET|ORG)/EN"), case_sensitive=False).to_column()
                       .alias("matched"))


# (pattern, the same in the oracle's dialect or None: invalid, so it never matches)
_PATTERNS = [
    ("[*+]", "[*+]"), (r"\++", r"\++"), (r"\\\\1", r"\\\\1"), (r"^https?://(www\.)?th", r"^https?://(www\.)?th"),
    (r"\d{2}\b", r"\d{2}\b"), ("(?i)EXAMPLE", "(?i)EXAMPLE"), ("(?P<host>[a-z]+)\\.example", "([a-z]+)\\.example"),
    ("[invalid(", None), ("(?<=a)b", None), ("(?>a)b", None), (r"(t)\1", None), (r"\Qex\E", None), (r"\h", None),
]


def _patterns_sql() -> str:
    one = [f"regexp_matches(trim(url), '{s}')" if s is not None else "false" for _, s in _PATTERNS]
    return "SELECT page_id, " + ", ".join(f"coalesce({m}, false) AS m{i}" for i, m in enumerate(one)) + " FROM pages"


@register("regex_patterns", _patterns_sql())
def regex_patterns(spark, sf_dir):
    """A table of patterns, valid and invalid ones, on every page's url."""
    import warnings

    rows = table_as_rows(table(spark, sf_dir, "pages", "page_id", "url"), "page_id", ["url"])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        cols = [TextRule(f"m{i}", 0, Regex(p)).to_column().alias(f"m{i}") for i, (p, _) in enumerate(_PATTERNS)]
    return rows.select(F.col("row_index").alias("page_id"), *cols)


# Patterns on which a backtracking matcher takes exponential time or overflows its stack on long texts.
_AMBIGUOUS = ["(a+)+b", "^([a-zA-Z0-9]+ ?)+$", "^([a-z]|[a-y]|[ ,])*[.]$", "(([a-z]+)*[,;]? ?)+[A-Z][a-z]+", "^(([^q]?){20}){9}q"]


@register("regex_linear", "SELECT doc_id, " + ", ".join(
    f"coalesce(regexp_matches({sql_utrim('text')}, '{p}'), false) AS m{i}" for i, p in enumerate(_AMBIGUOUS)) + " FROM documents")
def regex_linear(spark, sf_dir):
    """Regex rules with ambiguous repetitions on whole documents."""
    rows = table_as_rows(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", ["text"])
    return rows.select(F.col("row_index").alias("doc_id"), *[
        TextRule(f"m{i}", 0, Regex(p)).to_column().alias(f"m{i}") for i, p in enumerate(_AMBIGUOUS)])


@register("regex_invalid_is_false", "SELECT p_partkey, p_name, false AS matched FROM part")
def regex_invalid_is_false(spark, sf_dir):
    rows = table_as_rows(table(spark, sf_dir, "part", "p_partkey", "p_name"), "p_partkey", ["p_name"])
    return rows.select(F.col("row_index").alias("p_partkey"), F.get("cells", 0)["content"].alias("p_name"),
                       TextRule("bad", 0, Regex("[invalid(")).to_column().alias("matched"))


# ---------------------------------------------------------------- colours and structure

@register("argb_to_rgb", """
SELECT argb, CASE WHEN length(argb) >= 8 AND regexp_matches(substr(argb, 3, 6), '^[0-9A-Fa-f]{6}$')
                  THEN upper(substr(argb, 3, 6)) END AS rgb
FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'FF' || lpad(hex(l_partkey * 7919 % 16777216), 6, '0')
                                   WHEN 1 THEN hex(l_partkey) WHEN 2 THEN lower(hex(l_partkey * 104729))
                                   ELSE 'FFZZ' || hex(l_suppkey) END AS argb FROM lineitem)""")
def argb_to_rgb_q(spark, sf_dir):
    return _argb_strings(spark, sf_dir).select("argb", argb_to_rgb("argb").alias("rgb"))


def _argb_strings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_linenumber", "l_partkey", "l_suppkey")
    k = F.col("l_linenumber") % 4
    return li.select(F.when(k == 0, F.concat(F.lit("FF"), F.lpad(F.hex(F.col("l_partkey") * 7919 % 16777216), 6, "0")))
                      .when(k == 1, F.hex("l_partkey"))
                      .when(k == 2, F.lower(F.hex(F.col("l_partkey") * 104729)))
                      .otherwise(F.concat(F.lit("FFZZ"), F.hex("l_suppkey"))).alias("argb"))


@register("display_hex", """
SELECT argb, upper(CASE WHEN length(s) = 8 THEN substr(s, 3, 6) ELSE s END) AS hex
FROM (SELECT argb, regexp_replace(argb, '^#+', '') AS s FROM (
  SELECT CASE l_linenumber % 3 WHEN 0 THEN '#' || lpad(hex(l_partkey * 7919 % 4294967296), 8, '0')
                               WHEN 1 THEN '##' || lower(hex(l_partkey)) ELSE lpad(hex(l_suppkey), 8, 'f') END AS argb
  FROM lineitem))""")
def display_hex_q(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_linenumber", "l_partkey", "l_suppkey")
    k = F.col("l_linenumber") % 3
    argb = (F.when(k == 0, F.concat(F.lit("#"), F.lpad(F.hex(F.col("l_partkey") * 7919 % 4294967296), 8, "0")))
             .when(k == 1, F.concat(F.lit("##"), F.lower(F.hex("l_partkey"))))
             .otherwise(F.lpad(F.hex("l_suppkey"), 8, "f")))
    return li.select(argb.alias("argb")).select("argb", display_hex("argb").alias("hex"))


_CELL_COLOURS = ("SELECT file, row_index, 0 AS column_index, bg0 AS argb FROM f WHERE bg0 IS NOT NULL UNION ALL "
                 "SELECT file, row_index, 1, bg1 FROM f WHERE bg1 IS NOT NULL")


@register("color_histogram", with_grid(
    f"SELECT file, 0 AS sheet_index, upper(substr(argb, 3, 6)) AS hex, COUNT(*) AS cells FROM ({_CELL_COLOURS}) "
    "GROUP BY file, hex"))
def color_histogram(spark, sf_dir):
    return S.color_histogram(grid(spark, sf_dir)).select("file", "sheet_index", "hex", "cells")


@register("top_colors", with_grid(
    f"SELECT * FROM (SELECT file, hex, cells, ROW_NUMBER() OVER (PARTITION BY file ORDER BY cells DESC, hex) AS rank "
    f"FROM (SELECT file, upper(substr(argb, 3, 6)) AS hex, COUNT(*) AS cells FROM ({_CELL_COLOURS}) GROUP BY file, hex)) "
    "WHERE rank <= 8"))
def top_colors(spark, sf_dir):
    return S.top_colors(grid(spark, sf_dir)).select("file", "hex", "cells", F.col("rank"))


@register("dominant_rows", with_grid(
    "SELECT file, row_index, upper(substr(bg0, 3, 6)) AS hex, CAST(2 AS BIGINT) AS n FROM f WHERE bg0 = bg1"))
def dominant_rows(spark, sf_dir):
    return S.dominant_rows(grid(spark, sf_dir)).select("file", "row_index", "hex", "n")


@register("color_sample", with_grid(
    f"SELECT file, row_index, column_index, argb AS fg_argb, '' AS bg_argb, true AS sheet_has_colors "
    f"FROM ({_CELL_COLOURS}) WHERE row_index < 10"))
def color_sample(spark, sf_dir):
    return S.color_sample(grid(spark, sf_dir), only_uncoloured=False).select(
        "file", "row_index", "column_index", "fg_argb", "bg_argb", "sheet_has_colors")


_WIDE_HISTOGRAM = "SELECT file, hex, COUNT(*) AS cells FROM w WHERE hex IS NOT NULL GROUP BY file, hex"


@register("wide_color_histogram", with_wide(_WIDE_HISTOGRAM))
def wide_color_histogram(spark, sf_dir):
    return S.color_histogram(wide_rows(spark, sf_dir)).select("file", "hex", "cells")


@register("wide_top_colors", with_wide(
    f"SELECT file, hex, cells, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY file ORDER BY cells DESC, hex) AS rank "
    f"FROM ({_WIDE_HISTOGRAM})) WHERE rank <= 8"))
def wide_top_colors(spark, sf_dir):
    """Sheets with twelve colours: the cut at eight is reached."""
    return S.top_colors(wide_rows(spark, sf_dir)).select("file", "hex", "cells", "rank")


@register("wide_dominant_rows", with_wide(
    "SELECT file, row_index, hex, COUNT(*) AS n FROM w WHERE hex IS NOT NULL GROUP BY file, row_index, hex HAVING COUNT(*) > 4"))
def wide_dominant_rows(spark, sf_dir):
    """Eight columns: a majority is five cells or more."""
    return S.dominant_rows(wide_rows(spark, sf_dir)).select("file", "row_index", "hex", "n")


@register("wide_color_sample", with_wide(
    "SELECT file, row_index, c AS column_index, 'FF' || hex AS fg_argb, '' AS bg_argb, true AS sheet_has_colors FROM w "
    "WHERE hex IS NOT NULL AND row_index < 10 AND c < 5"))
def wide_color_sample(spark, sf_dir):
    return S.color_sample(wide_rows(spark, sf_dir), only_uncoloured=False).select(
        "file", "row_index", "column_index", "fg_argb", "bg_argb", "sheet_has_colors")


@register("structure_colors", with_wide(
    f", h AS ({_WIDE_HISTOGRAM}), t AS (SELECT file, COUNT(*) AS colours, SUM(cells) AS coloured FROM (SELECT *, ROW_NUMBER() "
    "OVER (PARTITION BY file ORDER BY cells DESC, hex) AS rank FROM h) WHERE rank <= 8 GROUP BY file), "
    "d AS (SELECT file, COUNT(*) AS dominant FROM (SELECT file, row_index FROM w WHERE hex IS NOT NULL "
    "GROUP BY file, row_index, hex HAVING COUNT(*) > 4) GROUP BY file) "
    "SELECT s.file, s.height, CAST(8 AS BIGINT) AS width, t.colours, CAST(t.coloured AS BIGINT) AS coloured, "
    "coalesce(d.dominant, 0) AS dominant, 0 AS sampled FROM (SELECT file, MAX(row_index) + 1 AS height FROM w GROUP BY file) s "
    "LEFT JOIN t ON t.file = s.file LEFT JOIN d ON d.file = s.file"))
def structure_colors(spark, sf_dir):
    """The structure job with its colour analysis, one row a sheet.  Every sheet has colours, so none is sampled."""
    out = S.analyze_structure(wide_rows(spark, sf_dir), colors=True)
    n = lambda name, *aggs: out[name].groupBy("file").agg(*aggs)
    one = F.count(F.lit(1))
    return (out["size"].select("file", "height", "width")
            .join(n("colors", one.alias("colours"), F.sum("cells").alias("coloured")), "file", "left")
            .join(n("dominant", one.alias("dominant")), "file", "left").join(n("sample", one.alias("sampled")), "file", "left")
            .withColumn("dominant", F.coalesce("dominant", F.lit(0))).withColumn("sampled", F.coalesce("sampled", F.lit(0))))


@register("sheet_size", with_grid(
    "SELECT file, 0 AS sheet_index, max(row_index) + 1 AS height, CAST(2 AS BIGINT) AS width FROM f GROUP BY file"))
def sheet_size(spark, sf_dir):
    return S.sheet_size(grid(spark, sf_dir))


@register("sheet_dump", with_grid("SELECT file, row_index + 1 AS row_number, c0 || '|' || c1 AS values_text FROM f"))
def sheet_dump(spark, sf_dir):
    return S.sheet_dump(grid(spark, sf_dir)).select("file", "row_number", _text("values").alias("values_text"))


@register("assign_merges", with_grid("""
SELECT file, row_index, column_index, ordinal, start_col, end_col, start_row, end_row FROM (
  SELECT ce.*, m.ordinal, m.start_col, m.end_col, m.start_row, m.end_row,
         ROW_NUMBER() OVER (PARTITION BY ce.file, ce.row_index, ce.column_index ORDER BY m.ordinal) AS k
  FROM (SELECT file, row_index, 0 AS column_index FROM f UNION ALL SELECT file, row_index, 1 FROM f) ce
  LEFT JOIN (SELECT 'order_' || CAST(o_orderkey AS VARCHAR) || '.xlsx' AS file, k.ordinal,
                    2 * k.ordinal AS start_row, 2 * k.ordinal + o_orderkey % 4 AS end_row,
                    k.ordinal % 2 AS start_col, 1 AS end_col
             FROM orders, (VALUES (0), (1), (2)) k(ordinal)) m
    ON ce.file = m.file AND ce.row_index BETWEEN m.start_row AND m.end_row
   AND ce.column_index BETWEEN m.start_col AND m.end_col) WHERE k = 1"""))
def assign_merges_q(spark, sf_dir):
    cells = grid(spark, sf_dir).select("file", "sheet_index", "row_index", F.inline(
        F.transform("cells", lambda c: F.struct(c["column_index"].alias("column_index")))))
    o = table(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("ordinal")
    merges = (o.select(sheet_file(F.col("o_orderkey")).alias("file"), F.lit(0).alias("sheet_index"),
                       F.col("o_orderkey"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ordinal"))
              .select("file", "sheet_index", "ordinal", (2 * k).alias("start_row"),
                      (2 * k + F.col("o_orderkey") % 4).alias("end_row"), (k % 2).alias("start_col"),
                      F.lit(1).alias("end_col")))
    out = assign_merges(cells, merges)
    return out.select("file", "row_index", "column_index", F.col("merge.ordinal").alias("ordinal"),
                      F.col("merge.start_col").alias("start_col"), F.col("merge.end_col").alias("end_col"),
                      F.col("merge.start_row").alias("start_row"), F.col("merge.end_row").alias("end_row"))


# ---------------------------------------------------------------- tables

_SPARSE_SQL = ("SELECT 'order_' || CAST(l_orderkey AS VARCHAR) || '.xlsx' AS file, CAST(l_linenumber - 1 AS BIGINT) "
               "AS row_index, CAST(l_partkey % 3 AS INTEGER) AS column_index, max(CAST(l_quantity AS VARCHAR)) AS content "
               "FROM lineitem GROUP BY 1, 2, 3")


@register("dense_grid", f"""
WITH s AS ({_SPARSE_SQL}),
box AS (SELECT file, max(row_index) + 1 AS h, max(column_index) + 1 AS w FROM s GROUP BY file),
r AS (SELECT file, w, unnest(range(h)) AS row_index FROM box),
rc AS (SELECT file, row_index, CAST(unnest(range(w)) AS INTEGER) AS column_index FROM r)
SELECT rc.file, rc.row_index, rc.column_index, coalesce(s.content, '') AS content
FROM rc LEFT JOIN s USING (file, row_index, column_index)""")
def dense_grid(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    sparse = (li.select(sheet_file(F.col("l_orderkey")).alias("file"), F.lit(0).alias("sheet_index"),
                        (F.col("l_linenumber") - 1).cast("bigint").alias("row_index"),
                        (F.col("l_partkey") % 3).cast("int").alias("column_index"),
                        F.col("l_quantity").cast("string").alias("content"))
              .groupBy("file", "sheet_index", "row_index", "column_index").agg(F.max("content").alias("content")))
    dense = TB.densify(sparse)
    return dense.select("file", "row_index", F.inline("cells"))


_ORDERS_HEADER = ["o_orderkey", "o_custkey", "", "o_orderpriority"]


@register("header_promote", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
                            "o_orderstatus AS Column_2, o_orderpriority FROM orders")
def header_promote(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    body = table_as_rows(o.withColumn("row_index", F.col("o_orderkey") + 1), "row_index",
                         ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], file="orders.xlsx")
    header = table_as_rows(spark.range(1).select(F.lit(0).cast("bigint").alias("row_index"),
                                                 *[F.lit(h).alias(f"h{i}") for i, h in enumerate(_ORDERS_HEADER)]),
                           "row_index", [f"h{i}" for i in range(len(_ORDERS_HEADER))], file="orders.xlsx")
    return TB.promote_header(header.unionByName(body)).drop("file", "sheet_index", "row_index")


@register("dedupe_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def dedupe_rows(spark, sf_dir):
    return TB.dedupe(table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity"))


@register("dedupe_keep_first", "SELECT l_returnflag, l_linestatus, min(l_orderkey) AS l_orderkey FROM lineitem "
                               "GROUP BY l_returnflag, l_linestatus")
def dedupe_keep_first(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus")
    return TB.dedupe(li, keep_first_by="l_orderkey")


@register("number_rows", "SELECT ROW_NUMBER() OVER (ORDER BY o_orderkey) AS 行号, o_orderkey, o_custkey, o_orderstatus "
                         "FROM orders")
def number_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return TB.number_rows(o, ["o_orderkey"])


@register("number_rows_per_group", "SELECT ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS 行号, "
                                   "o_orderkey, o_custkey FROM orders")
def number_rows_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return TB.number_rows(o, ["o_orderkey"], by=["o_custkey"])


@register("search_rows", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'blue') "
                         "OR contains(lower(p_type), 'blue')")
def search_rows(spark, sf_dir):
    return TB.search_rows(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "Blue")


@register("clean_blank_rows", with_grid(
    f"SELECT file, row_index FROM f WHERE {sql_utrim('c0')} <> '' OR {sql_utrim('c1')} <> ''"))
def clean_blank_rows(spark, sf_dir):
    return TB.drop_blank_rows(grid(spark, sf_dir)).select("file", "row_index")


@register("fill_missing", with_grid(
    "SELECT sheet_id, row_index, c0, CASE WHEN bg0 IS NULL OR trim(bg0) = '' THEN 'NA' ELSE bg0 END AS bg0, "
    "CASE WHEN bg1 IS NULL OR trim(bg1) = '' THEN 'NA' ELSE bg1 END AS bg1 FROM f"))
def fill_missing(spark, sf_dir):
    return TB.fill_missing(flat_grid(spark, sf_dir).select("sheet_id", "row_index", "c0", "bg0", "bg1"),
                           "NA", ["bg0", "bg1"])


_STAT_COLS = ["l_quantity", "l_discount", "l_returnflag"]


@register("column_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(v) AS numeric_count, round(min(v), 6) AS min, round(max(v), 6) AS max, "
    f"round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev "
    f"FROM (SELECT TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS v FROM lineitem)" for c in _STAT_COLS))
def column_stats(spark, sf_dir):
    st = TB.column_stats(table(spark, sf_dir, "lineitem", *_STAT_COLS))
    return st.select("column", "numeric_count", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "stddev")])


@register("summary_row", "SELECT round(sum(l_quantity), 4) AS l_quantity, round(sum(l_extendedprice), 4) AS "
                         "l_extendedprice FROM lineitem")
def summary_row(spark, sf_dir):
    s = TB.summary_row(table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice"))
    return s.select(*[F.round(c, 4).alias(c) for c in s.columns])


# ---------------------------------------------------------------- workbook source round trips

from sheetlens.operators import batch as B  # noqa: E402
from sheetlens.plans.oracle import GRID_SQL  # noqa: E402
from sheetlens.plans.workbooks import grid_workbooks, in_folders  # noqa: E402
from sheetlens.sources import xlsx as XL  # noqa: E402
from sheetlens.sources.manifest import pick_from_manifest  # noqa: E402

from sheetlens.sources.files import write_binary_files  # noqa: E402


def _base_name(path: str) -> "F.Column":
    return F.element_at(F.split(path, "/"), -1)


_ORDER_FILES = ("SELECT DISTINCT l_orderkey AS id, 'order_' || CAST(l_orderkey AS VARCHAR) || '.xlsx' AS file "
                "FROM lineitem")


@register("xlsx_row_types", ORACLE["row_type_counts"])
def xlsx_row_types(spark, sf_dir):
    rows = XL.decode_workbooks(grid_workbooks(spark, sf_dir))
    return C.type_counts(C.classify(rows, cargo_analysis()))


@register("xlsx_rows", with_workbooks(
    "SELECT file, 'O' || CAST(sheet_id AS VARCHAR) AS sheet_name, row_index, c0, c1, upper(substr(bg0, 3, 6)) AS bg0, "
    "upper(substr(bg1, 3, 6)) AS bg1, m_start, m_end FROM f"))
def xlsx_rows(spark, sf_dir):
    """Workbooks written to folders and read by the ``workbook_parts`` source."""
    def found(folder):
        rows = XL.read_workbooks(spark, folder).withColumn("file", _base_name("file"))
        c0, c1 = F.get("cells", 0), F.get("cells", 1)
        m = F.coalesce(c0["merge_info"], c1["merge_info"])
        return rows.select("file", "sheet_name", "row_index", c0["content"].alias("c0"), c1["content"].alias("c1"),
                           c0["style"]["background_color"].alias("bg0"), c1["style"]["background_color"].alias("bg1"),
                           m["start_col"].alias("m_start"), m["end_col"].alias("m_end"))

    return in_folders(spark, sf_dir, found)


@register("xlsx_manifest", f"SELECT file, 0 AS sheet_index, 'O' || CAST(id AS VARCHAR) AS sheet_name FROM ({_ORDER_FILES}) "
                           f"UNION ALL SELECT file, 1, 'Lines' FROM ({_ORDER_FILES})")
def xlsx_manifest(spark, sf_dir):
    """Sheet lists by the ``workbook_parts`` source, which opens no sheet for them."""
    return in_folders(spark, sf_dir, lambda folder: XL.workbook_manifest(spark, folder).select(
        _base_name("file").alias("file"), "sheet_index", "sheet_name"))


@register("xlsx_fonts", with_workbooks(
    "SELECT file, row_index, row_index IN (0, 2) OR coalesce(bg0 = 'FFFFCCFD', false) AS bold, "
    "c1 = '  ' OR coalesce(bg0 = 'FFFFCCFD', false) AS italic, CASE WHEN row_index = 0 THEN '0000FF' "
    "WHEN bg0 = 'FFFFCCFD' THEN 'FF0000' END AS font_color FROM f"))
def xlsx_fonts(spark, sf_dir):
    """Font colour, bold and italic of decoded workbooks."""
    style = F.get("cells", 0)["style"]
    return XL.decode_workbooks(grid_workbooks(spark, sf_dir, fonts=True)).select(
        "file", "row_index", style["bold"].alias("bold"), style["italic"].alias("italic"), style["font_color"].alias("font_color"))


@register("xlsx_sheet_pick", f"SELECT file, 0 AS sheet_index, 'O' || CAST(id AS VARCHAR) AS sheet_name FROM ({_ORDER_FILES})")
def xlsx_sheet_pick(spark, sf_dir):
    return pick_from_manifest(XL.manifest_from(grid_workbooks(spark, sf_dir)), "NoSuchSheet")


@register("xlsx_sheet_pick_named", f"SELECT file, 1 AS sheet_index, 'Lines' AS sheet_name FROM ({_ORDER_FILES})")
def xlsx_sheet_pick_named(spark, sf_dir):
    return pick_from_manifest(XL.manifest_from(grid_workbooks(spark, sf_dir)), "Lines")


@register("xlsx_sheet_size", with_workbooks(
    "SELECT file, 0 AS sheet_index, max(row_index) + 1 AS height, CAST(2 AS BIGINT) AS width FROM f GROUP BY file "
    "UNION ALL SELECT file, 1, count(*) FILTER (WHERE row_index >= 3 AND row_index < (SELECT max(row_index) FROM f f2 "
    "WHERE f2.file = f.file) - 1) + 1, 3 FROM f GROUP BY file"))
def xlsx_sheet_size(spark, sf_dir):
    return S.sheet_size(XL.decode_workbooks(grid_workbooks(spark, sf_dir), sheets="all"))


_LINES_SQL = """
SELECT 'order_' || CAST(l_orderkey AS VARCHAR) || '.xlsx' AS file,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
            l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS VARCHAR) AS line,
       CAST(l_partkey AS VARCHAR) AS partkey, CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'FALSE' END AS returned
FROM lineitem"""


@register("xlsx_table", _LINES_SQL)
def xlsx_table(spark, sf_dir):
    t = XL.decode_tables(grid_workbooks(spark, sf_dir), sheet="Lines").where(F.col("row_index").isNotNull())
    return t.select("file", *[F.get("values", i).alias(h) for i, h in enumerate(["line", "partkey", "returned"])])


@register("batch_stats", f"SELECT count(*) AS total_files, count(*) FILTER (WHERE id % 97 <> 0) AS successful, "
                         f"count(*) FILTER (WHERE id % 97 = 0) AS failed, "
                         f"count(*) FILTER (WHERE id % 97 = 0) > 0 AS has_errors FROM ({_ORDER_FILES})")
def batch_stats(spark, sf_dir):
    run = B.read_tables(grid_workbooks(spark, sf_dir, corrupt_every=97))
    return run.stats().select("total_files", "successful", "failed", "has_errors")


@register("batch_status", f"SELECT file, id % 97 = 0 AS failed FROM ({_ORDER_FILES})")
def batch_status(spark, sf_dir):
    run = B.read_tables(grid_workbooks(spark, sf_dir, corrupt_every=97))
    return run.status.select("file", F.col("error").isNotNull().alias("failed"))


@register("batch_tables", with_workbooks(
    "SELECT file AS source_file, row_index, c0 || '|' || c1 AS values_text FROM f WHERE row_index > 0"))
def batch_tables(spark, sf_dir):
    run = B.read_tables(grid_workbooks(spark, sf_dir))
    return run.tables.select("source_file", "row_index", _text("values").alias("values_text"))


@register("batch_dedupe", with_workbooks(
    "SELECT file AS source_file, c0 || '|' || c1 AS values_text, min(row_index) AS row_index FROM f "
    "WHERE row_index > 0 GROUP BY 1, 2"))
def batch_dedupe(spark, sf_dir):
    run = B.read_tables(grid_workbooks(spark, sf_dir))
    return B.dedupe_per_file(run.tables).select("source_file", _text("values").alias("values_text"), "row_index")


@register("batch_row_numbers", with_workbooks(
    "SELECT file AS source_file, CAST(row_index AS VARCHAR) || '|' || c0 || '|' || c1 AS values_text FROM f "
    "WHERE row_index > 0"))
def batch_row_numbers(spark, sf_dir):
    run = B.read_tables(grid_workbooks(spark, sf_dir))
    return B.number_rows_per_file(run.tables).select("source_file", _text("values").alias("values_text"))


@register("batch_numbers_after_dedupe", with_workbooks(
    "SELECT source_file, CAST(ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY row_index) AS VARCHAR) || '|' || "
    "values_text AS values_text FROM (SELECT file AS source_file, c0 || '|' || c1 AS values_text, min(row_index) AS row_index "
    "FROM f WHERE row_index > 0 GROUP BY 1, 2)"))
def batch_numbers_after_dedupe(spark, sf_dir):
    run = B.read_tables(grid_workbooks(spark, sf_dir))
    numbered = B.number_rows_per_file(B.dedupe_per_file(run.tables))
    return numbered.select("source_file", _text("values").alias("values_text"))


def _running(pdf):
    """User code that depends on the order of the rows and refuses some files: the rows above each row that have
    the same text in the last column; a table without any digit there is an error."""
    if not pdf.iloc[:, -1].str.contains("[0-9]").any() or pdf.columns[0].endswith("7"):
        raise ValueError("nothing to count")
    return pdf.assign(above=pdf.groupby(pdf.columns[-1]).cumcount())


@register("batch_user_errors", with_workbooks("""
, body AS (SELECT file, row_index, c0, c1,
                  ROW_NUMBER() OVER (PARTITION BY file, c1 ORDER BY row_index) - 1 AS above FROM f WHERE row_index > 0),
bad AS (SELECT file, bool_or(regexp_matches(c1, '[0-9]')) AS digits, any_value(sheet_id) AS id FROM f WHERE row_index > 0 GROUP BY file)
SELECT b.file, CASE WHEN NOT digits OR id % 10 = 7 THEN 'ValueError: nothing to count' END AS error,
       CASE WHEN digits AND id % 10 <> 7 THEN (SELECT string_agg(c0 || ',' || c1 || ',' || CAST(above AS VARCHAR), ';'
            ORDER BY row_index) FROM body WHERE body.file = b.file) END AS rows_text FROM bad b"""))
def batch_user_errors(spark, sf_dir):
    """Per-file user code that fails on some files: their errors are in the status, the others have their rows."""
    run = B.run_batch(spark, grid_workbooks(spark, sf_dir), per_file=_running)
    rows = run.tables.groupBy(F.col("source_file").alias("file")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("row_index", "values"))), lambda r: F.array_join(r["values"], ",")), ";")
        .alias("rows_text"))
    return run.status.select("file", "error").join(rows, "file", "left")


# ---------------------------------------------------------------- run history (ledger)

import uuid as _uuid  # noqa: E402

from sheetlens.operators import ledger as L  # noqa: E402
from sheetlens.operators import logs as LG  # noqa: E402
from sheetlens.operators.ledger_table import LedgerTable  # noqa: E402
from sheetlens.plans.history import (  # noqa: E402
    LEVEL_SQL, MESSAGE_SQL, ledger_from_orders, log_lines_from_events, with_ledger, with_lines,
)
from sheetlens.session import ensure_checkpoint_dir  # noqa: E402


def _scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{_uuid.uuid4().hex}"


def _counters(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, *[F.col("result")[c].alias(c) for c in ("total_files", "successful", "failed")])


@register("ledger_recent", with_ledger(
    "SELECT seq, id, processor_id, total_files, successful, failed FROM led ORDER BY seq DESC LIMIT 10"))
def ledger_recent(spark, sf_dir):
    return _counters(L.recent(ledger_from_orders(spark, sf_dir), 10), "seq", "id", "processor_id")


@register("ledger_by_processor", with_ledger("SELECT seq, id FROM led WHERE processor_id = '1-URGENT'"))
def ledger_by_processor(spark, sf_dir):
    return L.by_processor(ledger_from_orders(spark, sf_dir), "1-URGENT").select("seq", "id")


@register("ledger_by_id", with_ledger("SELECT seq, id, input_dir, output_dir FROM led "
                                      "WHERE id = 'run-' || CAST((SELECT min(seq) FROM led) AS VARCHAR)"))
def ledger_by_id(spark, sf_dir):
    led = ledger_from_orders(spark, sf_dir)
    first = led.agg(F.min("seq")).first()[0]
    return L.by_id(led, f"run-{first}").select("seq", "id", "input_dir", "output_dir")


@register("ledger_successful", with_ledger("SELECT seq, id FROM led WHERE failed = 0"))
def ledger_successful(spark, sf_dir):
    return L.successful(ledger_from_orders(spark, sf_dir)).select("seq", "id")


@register("ledger_failed", with_ledger("SELECT seq, id, failed FROM led WHERE failed <> 0"))
def ledger_failed(spark, sf_dir):
    return L.failed(ledger_from_orders(spark, sf_dir)).select("seq", "id", F.col("result.failed").alias("failed"))


@register("ledger_success_rate", with_ledger(
    "SELECT seq, round(CASE WHEN total_files > 0 THEN CAST(successful AS DOUBLE) / total_files * 100 ELSE 0 END, 6) "
    "AS success_rate_pct, round(CASE WHEN total_files > 0 THEN CAST(successful + failed AS DOUBLE) / total_files * 100 "
    "ELSE 0 END, 6) AS progress_pct, successful + failed >= total_files AS complete FROM led"))
def ledger_success_rate(spark, sf_dir):
    led = ledger_from_orders(spark, sf_dir)
    r = F.col("result")
    pct, done = L.progress(r["successful"] + r["failed"], r["total_files"])
    return led.select("seq", F.round(L.success_rate_pct(dtype="double"), 6).alias("success_rate_pct"),
                      F.round(pct.cast("double"), 6).alias("progress_pct"), done.alias("complete"))


@register("ledger_stats", with_ledger(
    "SELECT COUNT(*) AS entries, COUNT(*) FILTER (WHERE failed = 0) AS successful_runs, "
    "COUNT(*) FILTER (WHERE failed <> 0) AS failed_runs, SUM(total_files) AS files, "
    "SUM(successful) AS successful_files, SUM(failed) AS failed_files FROM led"))
def ledger_stats(spark, sf_dir):
    r = F.col("result")
    return ledger_from_orders(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(L.is_successful()).alias("successful_runs"),
        F.count_if(~L.is_successful()).alias("failed_runs"), F.sum(r["total_files"]).alias("files"),
        F.sum(r["successful"]).alias("successful_files"), F.sum(r["failed"]).alias("failed_files"))


@register("ledger_trim", with_ledger("SELECT seq, id FROM led ORDER BY seq DESC LIMIT 1000"))
def ledger_trim(spark, sf_dir):
    return L.trim(ledger_from_orders(spark, sf_dir), 1000).select("seq", "id")


@register("ledger_remove", with_ledger("SELECT seq, id FROM led WHERE seq <> (SELECT max(seq) FROM led)"))
def ledger_remove(spark, sf_dir):
    led = ledger_from_orders(spark, sf_dir)
    last = led.agg(F.max("seq")).first()[0]
    return L.remove(led, f"run-{last}").select("seq", "id")


@register("ledger_append", with_ledger(
    "SELECT seq, id FROM led WHERE processor_name = 'F' UNION ALL "
    "SELECT (SELECT max(seq) FROM led WHERE processor_name = 'F') + ROW_NUMBER() OVER (ORDER BY ts, id) AS seq, id "
    "FROM led WHERE processor_name <> 'F'"))
def ledger_append(spark, sf_dir):
    led = ledger_from_orders(spark, sf_dir)
    old, new = led.where(F.col("processor_name") == "F"), led.where(F.col("processor_name") != "F")
    return L.append(old, new, order=("timestamp", "id")).select("seq", "id")


@register("ledger_shared", with_ledger(
    "SELECT row_number() OVER (ORDER BY seq % 2, ts, id) AS seq, id, failed FROM led"))
def ledger_shared(spark, sf_dir):
    """Two appends to a history in a shared folder; each commit gives its entries their numbers."""
    t, led = LedgerTable(spark, _scratch(spark, "ledger")), ledger_from_orders(spark, sf_dir)
    for k in range(2):
        t.append(led.where(F.col("seq") % 2 == k), order=["timestamp", "id"])
    return t.read().select("seq", "id", F.col("result.failed").alias("failed"))


@register("ledger_shared_kept", with_ledger(
    "SELECT seq, id FROM (SELECT row_number() OVER (ORDER BY ts, id) AS seq, id, count(*) OVER () AS n FROM led) "
    "WHERE seq > n - 700 AND seq < n"))
def ledger_shared_kept(spark, sf_dir):
    """A history in a shared folder: cleared, filled again to at most 700 entries, the newest removed."""
    t, led = LedgerTable(spark, _scratch(spark, "ledger")), ledger_from_orders(spark, sf_dir)
    t.append(led.where("seq % 2 = 0"))
    t.clear()
    base = t.append(led, max_entries=700, order=["timestamp", "id"])
    t.remove(L.recent(t.read(), 1).first()["id"])
    return t.read().select((F.col("seq") - base).alias("seq"), "id")


@register("ledger_saved", with_ledger("SELECT seq, id, failed FROM led"))
def ledger_saved(spark, sf_dir):
    """A history saved to two folders, one of them cleared; both loaded again."""
    kept, cleared, led = _scratch(spark, "ledger"), _scratch(spark, "ledger"), ledger_from_orders(spark, sf_dir)
    L.save(led, kept)
    L.save(led, cleared)
    L.clear(spark, cleared)
    both = L.load(spark, kept).unionByName(L.load(spark, cleared))
    return both.select("seq", "id", F.col("result.failed").alias("failed"))


@register("ledger_new_entries", with_ledger(
    "SELECT count(*) AS n, count(*) AS ids, count(*) AS uuids, count(*) AS now FROM led"))
def ledger_new_entries(spark, sf_dir):
    """Entries made of run counters: each has its own UUID and the current time."""
    runs = ledger_from_orders(spark, sf_dir).select("result.total_files", "result.successful", "result.failed", "result.duration")
    e = L.new_entries(runs, "p", "n", "in", "out")
    uuid4 = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    recent = F.abs(F.unix_timestamp("timestamp") - F.unix_timestamp(F.current_timestamp())) < 3600
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("id").rlike(uuid4)).alias("uuids"),
                 F.count_if(recent).alias("now"))


@register("ledger_import", with_ledger("""
, imp AS (SELECT *, 2 * seq AS ordinal FROM led
          UNION ALL SELECT seq, id, ts, processor_id, processor_name, input_dir, 'dup/' || output_dir, total_files,
                           successful, failed, 2 * seq + 1 FROM led WHERE processor_name = 'O'),
first AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ordinal) AS k FROM imp) WHERE k = 1),
old AS (SELECT * FROM led WHERE processor_name = 'F'),
every AS (SELECT id, ts, output_dir, 0 AS origin, seq AS place FROM old
          UNION ALL SELECT id, ts, output_dir, 1, ordinal FROM first WHERE id NOT IN (SELECT id FROM old))
SELECT seq, id, output_dir FROM (SELECT ROW_NUMBER() OVER (ORDER BY ts, origin, place) AS seq, id, output_dir FROM every)
ORDER BY seq DESC LIMIT 700"""))
def ledger_import(spark, sf_dir):
    """Imported runs lie between the ledger's in time; the newest 700 of all stay."""
    led = ledger_from_orders(spark, sf_dir)
    old = led.where(F.col("processor_name") == "F")
    imported = led.withColumn("ordinal", 2 * F.col("seq")).unionByName(
        led.where(F.col("processor_name") == "O")
           .withColumn("output_dir", F.concat(F.lit("dup/"), F.col("output_dir")))
           .withColumn("ordinal", 2 * F.col("seq") + 1))
    return L.import_entries(old, imported, "ordinal", max_entries=700).select("seq", "id", "output_dir")


@register("ledger_json_roundtrip", with_ledger(
    "SELECT seq, id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, processor_id, total_files, successful, failed FROM led"))
def ledger_json_roundtrip(spark, sf_dir):
    path = _scratch(spark, "ledger-json")
    L.export_json(ledger_from_orders(spark, sf_dir), path)
    back = L.load_json(spark, path)
    return _counters(back, "seq", "id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                     "processor_id")


# ---------------------------------------------------------------- log table

_PARSED_SQL = (f"SELECT event_id, date_trunc('second', ts) AS ts, {LEVEL_SQL} AS level, {MESSAGE_SQL} AS message "
               "FROM events")


def _parsed_logs(spark, sf_dir):
    return LG.parse_lines(log_lines_from_events(spark, sf_dir))


@register("log_parse", _PARSED_SQL)
def log_parse(spark, sf_dir):
    return _parsed_logs(spark, sf_dir).select("event_id", "ts", "level", "message")


@register("log_parse_all_lines", with_lines("SELECT COUNT(*) AS n_lines, COUNT(*) AS n_parsed FROM lines"))
def log_parse_all_lines(spark, sf_dir):
    return _parsed_logs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("parsed").alias("n_parsed"))


@register("log_filter", f"SELECT event_id, message FROM ({_PARSED_SQL}) WHERE level = 'ERROR'")
def log_filter(spark, sf_dir):
    return LG.filter_level(_parsed_logs(spark, sf_dir), "ERROR").select("event_id", "message")


@register("log_last_n", f"SELECT event_id, ts FROM ({_PARSED_SQL}) ORDER BY ts DESC, event_id DESC LIMIT 1000")
def log_last_n(spark, sf_dir):
    return LG.last_n(_parsed_logs(spark, sf_dir), 1000, order=("ts", "event_id")).select("event_id", "ts")


@register("log_render", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || level || '] ' || message AS text "
                        f"FROM ({_PARSED_SQL}) WHERE level IN ('WARN', 'ERROR')")
def log_render(spark, sf_dir):
    logs = _parsed_logs(spark, sf_dir).where(F.col("level").isin("WARN", "ERROR"))
    return LG.render(logs).select("event_id", "text")


@register("log_files_roundtrip", "SELECT ts, level, message, 'app_' || strftime(ts, '%Y%m%d') || '.log' AS day "
                                 f"FROM ({_PARSED_SQL})")
def log_files_roundtrip(spark, sf_dir):
    path = _scratch(spark, "logs")
    LG.write_logs(_parsed_logs(spark, sf_dir), path)
    return LG.read_logs(spark, path, glob="*.txt").select("ts", "level", "message", "day")


# ---------------------------------------------------------------- files on disk: CSV sink, incremental stream

from sheetlens.streaming import incremental as INC  # noqa: E402


_CSV_SQL = with_workbooks(
    "SELECT file, 'G00E-' || CAST(sheet_id AS VARCHAR) || ',Column_1' AS value FROM f WHERE row_index = 0 "
    "UNION ALL SELECT file, c0 || ',' || c1 AS value FROM f WHERE row_index > 0")


@register("batch_csv_roundtrip", _CSV_SQL)
def batch_csv_roundtrip(spark, sf_dir):
    """Workbooks written to a folder, batch-run (first sheet, header from row
    1), CSV per source file written and the lines read back."""
    in_dir, out_dir = _scratch(spark, "workbooks"), _scratch(spark, "csv")
    write_binary_files(grid_workbooks(spark, sf_dir), in_dir)
    B.run_batch(spark, in_dir, out_dir)
    return B.read_csv_lines(spark, out_dir)


@register("batch_written_stats", f"SELECT count(*) AS total_files, count(*) FILTER (WHERE id % 97 <> 0) AS successful, "
                                 f"count(*) FILTER (WHERE id % 97 = 0) AS failed, "
                                 f"count(*) FILTER (WHERE id % 97 = 0) > 0 AS has_errors FROM ({_ORDER_FILES})")
def batch_written_stats(spark, sf_dir):
    """A run with CSV output, its counters observed on the write of the status."""
    run = B.run_batch(spark, grid_workbooks(spark, sf_dir, corrupt_every=97), _scratch(spark, "csv"))
    return run.stats().select("total_files", "successful", "failed", "has_errors")


@register("batch_stream", f"SELECT count(*) AS total_files, count(*) FILTER (WHERE id % 97 <> 0) AS successful, "
                          f"count(*) FILTER (WHERE id % 97 = 0) AS failed FROM ({_ORDER_FILES})")
def batch_stream(spark, sf_dir):
    """Workbooks written to a folder and processed by an incremental
    (availableNow) file stream; stats of the per-batch status table."""
    in_dir = _scratch(spark, "workbooks")
    write_binary_files(grid_workbooks(spark, sf_dir, corrupt_every=97), in_dir)
    status = INC.run_incremental_batch(spark, in_dir, _scratch(spark, "stream-out"), _scratch(spark, "stream-ckpt"))
    return INC.run_stats(status)


# ---------------------------------------------------------------- input checks, per-file user code, structure job

from sheetlens.sources.manifest import validate_input  # noqa: E402

_EXT_SQL = ("CASE o_orderpriority WHEN '1-URGENT' THEN '.xlsx' WHEN '2-HIGH' THEN '.XLSX' WHEN '3-MEDIUM' THEN '.xls' "
            "WHEN '4-NOT SPECIFIED' THEN '.txt' ELSE '' END")
_PATHS_SQL = f"SELECT 'in/c' || CAST(o_custkey AS VARCHAR) || '/order_' || CAST(o_orderkey AS VARCHAR) || {_EXT_SQL} " \
             "AS file FROM orders"


def _order_paths(spark, sf_dir, where=None):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    o = o if where is None else o.where(where)
    p = F.col("o_orderpriority")
    ext = (F.when(p == "1-URGENT", ".xlsx").when(p == "2-HIGH", ".XLSX").when(p == "3-MEDIUM", ".xls")
           .when(p == "4-NOT SPECIFIED", ".txt").otherwise(""))
    return o.select(F.concat(F.lit("in/c"), F.col("o_custkey").cast("string"), F.lit("/order_"),
                             F.col("o_orderkey").cast("string"), ext).alias("file"))


def _validate_sql(ok: str) -> str:
    ext = r"regexp_extract(file, '\.([^./]+)$', 1)"
    return (f"SELECT file, {ok} AS valid, CASE WHEN {ok} THEN NULL WHEN {ext} = '' THEN 'no file extension' "
            f"ELSE 'unsupported file type: ' || {ext} END AS reason FROM ({_PATHS_SQL})").replace("EXT", ext)


@register("validate_input_cargo", _validate_sql("lower(EXT) IN ('xlsx', 'xls')"))
def validate_input_cargo(spark, sf_dir):
    return validate_input(_order_paths(spark, sf_dir), "cargo").select("file", "valid", "reason")


@register("validate_input_analyzer", f"""
SELECT p.file, e.file IS NOT NULL AND regexp_extract(p.file, '\\.([^./]+)$', 1) IN ('xlsx', 'xls') AS valid,
       CASE WHEN e.file IS NULL THEN 'file does not exist'
            WHEN regexp_extract(p.file, '\\.([^./]+)$', 1) IN ('xlsx', 'xls') THEN NULL
            WHEN regexp_extract(p.file, '\\.([^./]+)$', 1) = '' THEN 'no file extension'
            ELSE 'unsupported file type: ' || regexp_extract(p.file, '\\.([^./]+)$', 1) END AS reason
FROM ({_PATHS_SQL}) p LEFT JOIN (SELECT file FROM ({_PATHS_SQL} WHERE o_orderstatus <> 'P')) e ON p.file = e.file""")
def validate_input_analyzer(spark, sf_dir):
    """The analyser's rule; files of orders in status P are not there."""
    there = _order_paths(spark, sf_dir, F.col("o_orderstatus") != "P")
    return validate_input(_order_paths(spark, sf_dir), "analyzer", there).select("file", "valid", "reason")


def _cabinet_check(pdf):
    """User code run once per file: row and non-blank cell counts; files with
    an old-style cabinet code are rejected by raising."""
    import pandas as pd

    cells = [v for vals in pdf["values"] for v in vals]
    if any(v.startswith("CAB-") for v in cells):
        raise ValueError("old cabinet code format")
    return pd.DataFrame({"file": [pdf["file"].iloc[0]], "n_rows": [len(pdf)],
                         "n_nonblank": [sum(1 for v in cells if v.strip() != "")]})


@register("per_file_udf", with_grid(
    f"SELECT file, CASE WHEN bool_or(starts_with(c1, 'CAB-')) THEN NULL ELSE COUNT(*) END AS n_rows, "
    f"CASE WHEN bool_or(starts_with(c1, 'CAB-')) THEN NULL ELSE "
    f"SUM((CASE WHEN trim(c0) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(c1) <> '' THEN 1 ELSE 0 END)) END "
    f"AS n_nonblank, CASE WHEN bool_or(starts_with(c1, 'CAB-')) THEN 'ValueError: old cabinet code format' END "
    f"AS error FROM f GROUP BY file"))
def per_file_udf(spark, sf_dir):
    rows = grid(spark, sf_dir).select("file", "row_index", contents("cells").alias("values"))
    return B.per_file_apply(rows, _cabinet_check, "file string, n_rows bigint, n_nonblank bigint, error string")


@register("structure_named_sheet", with_workbooks(
    "SELECT file, 1 AS sheet_index, count(*) FILTER (WHERE row_index >= 3 AND row_index < (SELECT max(row_index) "
    "FROM f f2 WHERE f2.file = f.file) - 1) + 1 AS height, 3 AS width, "
    "count(*) FILTER (WHERE row_index >= 3 AND row_index < (SELECT max(row_index) FROM f f2 "
    "WHERE f2.file = f.file) - 1) + 1 AS dumped_rows FROM f GROUP BY file"))
def structure_named_sheet(spark, sf_dir):
    """The structure job on decoded workbooks, choosing the sheet by name."""
    out = S.analyze_workbooks(grid_workbooks(spark, sf_dir), sheet="Lines")
    dumped = out["dump"].groupBy("file").agg(F.count(F.lit(1)).alias("dumped_rows"))
    return out["size"].join(dumped, "file").select("file", "sheet_index", "height", "width", "dumped_rows")


from sheetlens.sources.manifest import list_files  # noqa: E402


@register("xlsx_listing", f"SELECT file, true AS non_empty FROM ({_ORDER_FILES})")
def xlsx_listing(spark, sf_dir):
    """Workbooks written to a folder (with a non-workbook file beside them),
    then listed: only ``.xlsx`` names, contents not read."""
    notes = spark.range(1).select(F.lit("notes.txt").alias("path"), F.lit(b"not a workbook").alias("content"))
    return in_folders(spark, sf_dir, lambda folder: list_files(spark, folder).select(
        _base_name("file").alias("file"), (F.col("length") > 0).alias("non_empty")), beside=notes).orderBy("file")


from sheetlens.operators.rules import ArrowRule, ExprRule, PythonRule  # noqa: E402

_NUMERIC_SQL = with_grid("SELECT file, row_index FROM f WHERE regexp_matches(trim(c0), '^[0-9]+$') "
                         "AND regexp_matches(trim(c1), '^[0-9]+$') AND m_start IS NULL")


@register("expr_rule_rows", _NUMERIC_SQL)
def expr_rule_rows(spark, sf_dir):
    """A user rule as a column expression: whole numbers in the first two cells, no merge."""
    def numeric_pair(ctx):
        digits = lambda i: ctx.cell(i)["content"].rlike(r"^\s*[0-9]+\s*$")
        return digits(0) & digits(1) & F.forall(ctx.cells_col(), lambda c: c["merge_info"].isNull())
    return _rule_rows(spark, sf_dir, ExprRule("numeric_pair", numeric_pair))


def _numeric_pair(contents, backgrounds, merges):
    """The same rule in plain Python (the named slow path)."""
    return (len(contents) >= 2 and all(c.strip().isdigit() for c in contents[:2])
            and all(m is None for m in merges))


@register("python_rule_rows", _NUMERIC_SQL)
def python_rule_rows(spark, sf_dir):
    return _rule_rows(spark, sf_dir, PythonRule("numeric_pair", _numeric_pair))


def _numeric_pairs(cells):
    """The same rule on batches of rows."""
    import pyarrow.compute as pc
    digits = pc.utf8_is_digit(pc.utf8_trim_whitespace(cells.contents))
    return cells.at(0, digits) & cells.at(1, digits) & (cells.count(cells.starts.is_valid()) == 0)


@register("arrow_rule_rows", _NUMERIC_SQL)
def arrow_rule_rows(spark, sf_dir):
    """A user rule over flat arrays of cells, called once a batch."""
    return _rule_rows(spark, sf_dir, ArrowRule("numeric_pair", _numeric_pairs))


from sheetlens.functions.cells import column_span, row_span  # noqa: E402


@register("merge_spans", with_grid(
    "SELECT file, row_index, 0 AS column_index, m_end - m_start + 1 AS column_span, 1 AS row_span FROM f "
    "WHERE m_start IS NOT NULL AND m_start <= 0 AND m_end >= 0 UNION ALL "
    "SELECT file, row_index, 1, m_end - m_start + 1, 1 FROM f WHERE m_start IS NOT NULL AND m_start <= 1 AND m_end >= 1"))
def merge_spans(spark, sf_dir):
    cells = grid(spark, sf_dir).select("file", "row_index", F.inline("cells")).where(F.col("merge_info").isNotNull())
    return cells.select("file", "row_index", "column_index", column_span(F.col("merge_info")).alias("column_span"),
                        row_span(F.col("merge_info")).alias("row_span"))


from sheetlens.streaming.logs import stream_logs  # noqa: E402


@register("log_stream", f"SELECT ts, level, message FROM ({_PARSED_SQL})")
def log_stream(spark, sf_dir):
    """Log files (written from events) parsed by a file stream
    (``readStream.text``, availableNow) into a parquet sink, read back."""
    logs_dir, out, ck = _scratch(spark, "logs"), _scratch(spark, "log-stream-out"), _scratch(spark, "log-stream-ckpt")
    LG.write_logs(_parsed_logs(spark, sf_dir), logs_dir)
    schema = spark.read.text(logs_dir).schema          # value + the day= partition column
    q = (stream_logs(spark, logs_dir, glob="*.txt", schema=schema).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).where(F.col("parsed")).select("ts", "level", "message")


from sheetlens.functions.text import rgb_components  # noqa: E402


@register("color_components", with_workbooks(
    f"SELECT file, hex, CAST(('0x' || substr(hex, 1, 2)) AS INTEGER) AS r, "
    f"CAST(('0x' || substr(hex, 3, 2)) AS INTEGER) AS g, CAST(('0x' || substr(hex, 5, 2)) AS INTEGER) AS b "
    f"FROM (SELECT DISTINCT file, upper(substr(argb, 3, 6)) AS hex FROM ({_CELL_COLOURS}))"))
def color_components(spark, sf_dir):
    """Each sheet's colours as r, g, b integers."""
    h = S.color_histogram(grid(spark, sf_dir)).select("file", "hex")
    return h.select("file", "hex", rgb_components("hex").alias("c")).select("file", "hex", "c.r", "c.g", "c.b")


@register("pending_files", f"SELECT count(*) AS pending FROM ({_ORDER_FILES})")
def pending_files(spark, sf_dir):
    """Number of workbooks that wait in a folder."""
    waiting = in_folders(spark, sf_dir, lambda folder: list_files(spark, folder).agg(F.count(F.lit(1)).alias("pending")))
    return waiting.agg(F.sum("pending").alias("pending"))


# ---------------------------------------------------------------- theme colours

from sheetlens.functions.text import tinted  # noqa: E402

# The oracle converts to hue, saturation and lightness and back, as the file format's description says.
_CHANNEL = ("CASE WHEN s = 0 THEN l2 WHEN {t} < 1.0 / 6 THEN p + (q - p) * 6 * {t} WHEN {t} < 0.5 THEN q "
            "WHEN {t} < 2.0 / 3 THEN p + (q - p) * (2.0 / 3 - {t}) * 6 ELSE p END")
_HEX = "format('{{:02X}}', CAST(floor(255 * ({}) + 0.5 + 1e-9) AS INTEGER))"
_TINT_SQL = """
WITH c AS (SELECT DISTINCT l_partkey AS partkey, l_linenumber AS line, (CAST(l_partkey AS BIGINT) * 7919 + l_linenumber * 104729) % 16777216 AS v FROM lineitem),
x AS (SELECT *, (line - 4) / 4.0::DOUBLE AS tint, (v // 65536) / 255.0::DOUBLE AS r, (v // 256 % 256) / 255.0::DOUBLE AS g,
      (v % 256) / 255.0::DOUBLE AS b FROM c),
m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM x),
h AS (SELECT *, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 < 0.5 THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2 - hi - lo) END AS s,
      CASE WHEN hi = lo THEN 0 WHEN r = hi THEN (g - b) / (hi - lo) / 6 WHEN g = hi THEN ((b - r) / (hi - lo) + 2) / 6
           ELSE ((r - g) / (hi - lo) + 4) / 6 END AS hue FROM m),
n AS (SELECT *, CASE WHEN tint < 0 THEN l * (1 + tint) ELSE l * (1 - tint) + tint END AS l2 FROM h),
w AS (SELECT *, CASE WHEN l2 < 0.5 THEN l2 * (1 + s) ELSE l2 + s - l2 * s END AS q FROM n),
z AS (SELECT *, 2 * l2 - q AS p, hue + 1.0 / 3 - floor(hue + 1.0 / 3) AS tr, hue - floor(hue) AS tg, hue - 1.0 / 3 - floor(hue - 1.0 / 3) AS tb FROM w)
SELECT partkey, line, 'FF' || """ + " || ".join(_HEX.format(_CHANNEL.format(t=t)) for t in ("tr", "tg", "tb")) + """ AS argb FROM z"""


@register("tint_colors", _TINT_SQL)
def tint_colors(spark, sf_dir):
    """Colours and tints of line items, resolved as a theme fill's are."""
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber").distinct()
    v = (F.col("l_partkey").cast("bigint") * 7919 + F.col("l_linenumber") * 104729) % 16777216
    argb = F.concat(F.lit("FF"), F.lpad(F.hex(v), 6, "0"))
    return li.select(F.col("l_partkey").alias("partkey"), F.col("l_linenumber").alias("line"),
                     tinted(argb, (F.col("l_linenumber") - 4) / 4.0).alias("argb"))
