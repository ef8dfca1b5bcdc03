"""Cell x merge-range containment (range join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.scratch import written

LEVELS = 32  # dyadic levels: coordinates are ints
FEW = 64     # ranges of a sheet up to which they stand in one row beside its cells


def _dyadic(lo: Column, hi: Column) -> Column:
    """The dyadic intervals (level, node) that make up lo..hi, at most two a level: node n of level k holds the
    coordinates n * 2**k to (n + 1) * 2**k - 1."""
    shift = lambda x, k: F.call_function("shiftright", x, k)
    one = F.lit(1).cast("bigint")

    def level(k: Column) -> Column:
        a = shift(lo + F.call_function("shiftleft", one, k) - 1, k)  # first node at or after lo
        b = shift(hi + 1, k)                                         # first node that is not below hi + 1
        piece = lambda ok, n: F.when((a < b) & ok, F.struct(k.alias("level"), n.alias("node")))
        return F.array(piece(a % 2 == 1, a), piece(b % 2 == 1, b - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), level)), lambda p: p.isNotNull())


def assign_merges(cells_long: DataFrame, merges: DataFrame, key=("file", "sheet_index"), few: int = FEW) -> DataFrame:
    """For every cell, the first merge range (lowest ``ordinal``) containing it.

    ``cells_long``: key, row_index, column_index, ...;
    ``merges``: key, ordinal, start_row, end_row, start_col, end_col.

    The ranges of a sheet with at most ``few`` are one array that the sheet's cells are joined to: one shuffle of the
    cells.  The cells of sheets with more look themselves up in dyadic boxes (:func:`_by_boxes`).
    Coordinates are 0-based and not negative; a range that ends before it starts holds nothing, and a cell without
    coordinates lies in none."""
    key = list(key)
    at = [*key, "row_index", "column_index"]
    columns = [*at, *(c for c in cells_long.columns if c not in at), "merge"]
    m = F.struct("ordinal", "start_col", "end_col", "start_row", "end_row")
    many = written(merges.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > few).select(*key), "many-ranges")
    boxed = not many.isEmpty()
    part = lambda df, how: df.join(many, key, how) if boxed else df
    lists = part(merges, "left_anti").groupBy(*key).agg(F.collect_list(m).alias("_ranges"))  # at most ``few``
    over = lambda r: (F.col("row_index").between(r["start_row"], r["end_row"])
                      & F.col("column_index").between(r["start_col"], r["end_col"]))
    first = F.array_min(F.filter("_ranges", over)).alias("merge")
    out = part(cells_long, "left_anti").join(lists, key, "left").withColumn("merge", first).select(columns)
    if not boxed:
        return out
    return out.unionByName(_by_boxes(part(cells_long, "left_semi"), part(merges, "left_semi"), key).select(columns))


def _by_boxes(cells_long: DataFrame, merges: DataFrame, key: list[str]) -> DataFrame:
    """:func:`assign_merges` for sheets with any number of ranges.

    A range is cut into dyadic boxes, at most 2 log2(height) x 2 log2(width) of them, and the first range of each
    box is kept (combined before the shuffle), so neither a range's height nor the number of ranges over a row
    counts.  A cell looks itself up in the one box of each pair of levels that its sheet uses, by an equi-join."""
    long = lambda c: F.col(c).cast("bigint")
    m = F.struct("ordinal", "start_col", "end_col", "start_row", "end_row")
    boxes = (merges.select(*key, m.alias("m"), F.explode(_dyadic(long("start_row"), long("end_row"))).alias("r"),
                           _dyadic(long("start_col"), long("end_col")).alias("cs"))
                   .select(*key, "m", F.col("r.level").alias("_rl"), F.col("r.node").alias("_rn"), F.explode("cs").alias("c"))
                   .groupBy(*key, "_rl", "_rn", F.col("c.level").alias("_cl"), F.col("c.node").alias("_cn"))
                   .agg(F.min("m").alias("merge")))
    levels = boxes.groupBy(*key).agg(F.collect_set(F.struct("_rl", "_cl")).alias("_levels"))  # at most LEVELS squared
    at = [*key, "row_index", "column_index"]
    up = lambda c, k: F.call_function("shiftright", long(c), F.col(k))
    asked = (cells_long.select(*at).distinct().join(levels, key).select(*at, F.inline("_levels"))
                       .select(*at, "_rl", "_cl", up("row_index", "_rl").alias("_rn"), up("column_index", "_cl").alias("_cn")))
    first = asked.join(boxes, [*key, "_rl", "_rn", "_cl", "_cn"]).groupBy(*at).agg(F.min("merge").alias("merge"))
    return cells_long.join(first, at, "left")
