"""Vector rows: which take part, and their packing into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.llm.common import written


def finite(vec: Column) -> Column:
    """Whether a vector is not null or empty and all its components are finite numbers."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: F.coalesce(ok(x.cast("double")), F.lit(False))), F.lit(False))


def taking_part(df: DataFrame, vec: str, vec_id: str, zero: bool) -> tuple[DataFrame, int, int]:
    """(row, id, v) of the rows that take part, their number and dimension.

    A row needs an id and a finite vector, one that is not zero unless ``zero``, of the
    length most vectors have (the longer one of two equally frequent)."""
    v = F.col(vec).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(
        finite(F.col("v")) & F.col("id").isNotNull() & (F.lit(zero) | F.exists("v", lambda x: x != 0)))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return rows, 0, 0
    return rows.where(F.size("v") == size["d"]), size["n"], size["d"]


def ranked(found: DataFrame, k: int, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query row, ties to the smaller id."""
    w = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", F.col("score").cast(score).alias("score")))
