"""Cargo summary and row-type buckets (project numbers, cabinets, data rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.functions.cells import cell_at, contents, first_non_empty

# The cargo summary's output column names.
PROJECT_NUMBERS = "项目编号"
CABINET_COUNT = "柜号数量"
DATA_ROW_COUNT = "数据行数量"


def rows_of_type(classified: DataFrame, row_type: str) -> DataFrame:
    return classified.where(F.col("row_type") == row_type)


def data_rows(classified: DataFrame) -> DataFrame:
    """Data rows as (file, sheet_index, row_index, values ARRAY<STRING>)."""
    return rows_of_type(classified, "Data").select(
        "file", "sheet_index", "row_index", contents("cells").alias("values"))


def project_rows(classified: DataFrame) -> DataFrame:
    """Project-number rows with the raw text of their first non-empty cell."""
    return rows_of_type(classified, "ProjectNumber").select(
        "file", "sheet_index", "row_index", first_non_empty("cells")["content"].alias("project_number"))


def cabinet_rows(classified: DataFrame) -> DataFrame:
    """Cabinet rows that have a column 1, with its (raw) text."""
    return (rows_of_type(classified, "CabinetNumber").where(cell_at(1).isNotNull())
            .select("file", "sheet_index", "row_index", cell_at(1)["content"].alias("cabinet")))


def cargo_summary(classified: DataFrame, files: DataFrame | None = None, sheet_index: int = 0) -> DataFrame:
    """One row per file: project numbers joined by ', ' in row order, the
    number of cabinet rows having a column 1 and the number of data rows.

    ``files`` (a ``file`` column, e.g. the manifest) adds files whose sheet
    is empty: they get ``'' / 0 / 0``; files with rows are kept whether or
    not the list names them (outer join on the file key).
    """
    # counts combine map-side; the ordered project list is one value of the result by definition
    df = classified.where(F.col("sheet_index") == sheet_index)
    rt = F.col("row_type")
    project = F.when(rt == "ProjectNumber", first_non_empty("cells")["content"])
    df = df.select("file", "row_index", rt, project.alias("_p"),
                   ((rt == "CabinetNumber") & cell_at(1).isNotNull()).alias("_cab"))
    agg = df.groupBy("file").agg(
        F.expr("listagg(_p, ', ') WITHIN GROUP (ORDER BY row_index)").alias(PROJECT_NUMBERS),
        F.count_if(F.col("_cab")).cast("int").alias(CABINET_COUNT),
        F.count_if(rt == "Data").cast("int").alias(DATA_ROW_COUNT))
    if files is not None:
        agg = files.select("file").distinct().join(agg, "file", "full_outer")
    return agg.select(
        "file",
        F.coalesce(F.col(PROJECT_NUMBERS), F.lit("")).alias(PROJECT_NUMBERS),
        F.coalesce(F.col(CABINET_COUNT), F.lit(0)).alias(CABINET_COUNT),
        F.coalesce(F.col(DATA_ROW_COUNT), F.lit(0)).alias(DATA_ROW_COUNT))


def with_context(classified: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """Attach to every row the nearest project number and cabinet text above it
    in the same sheet (carry-forward over row order).

    A sheet is dealt over tasks in ranges of ``bucket_rows`` rows: a window
    fills forward inside a range, and the last values of each range (one
    map-side combined row) are carried into the ranges after it.  The carry is
    left out of the plan when no sheet has a second range."""
    rt = F.col("row_type")
    d = (classified.withColumn("_bucket", F.floor(F.col("row_index") / bucket_rows))
         .withColumn("_p", F.when(rt == "ProjectNumber", first_non_empty("cells")["content"]))
         .withColumn("_c", F.when(rt == "CabinetNumber", cell_at(1)["content"])))
    key = ["file", "sheet_index"]
    inside = (Window.partitionBy(*key, "_bucket").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0))
    filled = (d.withColumn("_p", F.last("_p", ignorenulls=True).over(inside))
               .withColumn("_c", F.last("_c", ignorenulls=True).over(inside)))
    if not classified.where(F.col("row_index") >= bucket_rows).limit(1).count():
        return filled.withColumnsRenamed({"_p": "project_number", "_c": "cabinet"}).drop("_bucket")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row_index")))
    ends = (d.where(F.col("_p").isNotNull() | F.col("_c").isNotNull()).groupBy(*key, "_bucket")
             .agg(latest("_p").alias("_p"), latest("_c").alias("_c")))
    over = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    # a row per range that has a value, good for the ranges from the next one up to the next such row's
    after = Window.partitionBy(*key).orderBy("_bucket")
    carry = ends.select(*key, F.last("_p", ignorenulls=True).over(over).alias("_cp"),
                        F.last("_c", ignorenulls=True).over(over).alias("_cc"),
                        (F.col("_bucket") + 1).alias("_from"), F.lead("_bucket").over(after).alias("_to"))
    top = d.where(F.col("_bucket") > 0).groupBy(*key).agg(F.max("_bucket").alias("_last"))
    carry = carry.join(top, key).select(*key, "_cp", "_cc", F.explode(F.filter(
        F.sequence("_from", F.greatest("_from", F.coalesce("_to", "_last"))),
        lambda b: b <= F.coalesce("_to", "_last"))).alias("_bucket"))
    return (filled.join(carry, [*key, "_bucket"], "left")
            .withColumn("project_number", F.coalesce("_p", "_cp"))
            .withColumn("cabinet", F.coalesce("_c", "_cc"))
            .drop("_bucket", "_p", "_c", "_cp", "_cc"))
