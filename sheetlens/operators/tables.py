"""Table jobs: header promotion, densify, de-duplication, row numbers, search,
and the cleaning / statistics extras."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.cells import cell_at, contents
from sheetlens.functions.text import utrim
from sheetlens.operators.numbering import global_row_number, row_number_within

# Name of the prepended row-number column.
ROW_NUMBER_COL = "行号"


class DuplicateColumnError(ValueError):
    pass


def header_names(header: Sequence[str | None]) -> list[str]:
    """Header texts -> column names; an empty text (not trimmed) becomes
    ``Column_<i>``; duplicates (case-sensitive) are an error."""
    names = [h if h not in (None, "") else f"Column_{i}" for i, h in enumerate(header)]
    seen = set()
    for n in names:
        if n in seen:
            raise DuplicateColumnError(f"duplicate column name {n!r}")
        seen.add(n)
    return names


def promote_header(rows: DataFrame) -> DataFrame:
    """Sheet rows -> string table: row 0 gives the column names, the rows
    after it the body; missing cells read as ''.

    All sheets in ``rows`` must share one header: at most two distinct header
    rows reach the driver to check that.  Inputs with mixed headers use the
    tables form instead (a header array on every row, one job whatever the
    mix: :func:`sheetlens.operators.batch.read_tables`)."""
    ok = rows.where(F.col("error").isNull())
    heads = ok.where(F.col("row_index") == 0).select(contents("cells").alias("h")).distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError("sheets have no header or different headers; use the tables form (read_tables)")
    names = header_names(tuple(heads[0]["h"]))
    return ok.where(F.col("row_index") > 0).select(
        "file", "sheet_index", "row_index",
        *[F.coalesce(cell_at(i)["content"], F.lit("")).alias(n) for i, n in enumerate(names)])


def densify(cells_long: DataFrame, key: Sequence[str] = ("file", "sheet_index")) -> DataFrame:
    """Sparse cells (key, row_index, column_index, content) -> dense rows over
    each sheet's bounding box, absent cells as ''.

    Rows are built from per-row maps, so the join is between row records (no
    cell-level cross product)."""
    key = list(key)
    box = cells_long.groupBy(*key).agg((F.max("row_index") + 1).alias("h"), (F.max("column_index") + 1).alias("w"))
    per_row = (cells_long.groupBy(*key, "row_index")
               .agg(F.map_from_entries(F.collect_list(F.struct("column_index", "content"))).alias("m")))
    all_rows = box.select(*key, "w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("h") - 1)).alias("row_index"))
    return (all_rows.join(per_row, [*key, "row_index"], "left")
            .select(*key, "row_index", F.transform(
                F.sequence(F.lit(0), F.col("w").cast("int") - 1),
                lambda i: F.struct(i.alias("column_index"),
                                   F.coalesce(F.col("m")[i], F.lit("")).alias("content"))).alias("cells")))


def dedupe(df: DataFrame, subset: Sequence[str] | None = None, keep_first_by: str | None = None,
           group: Sequence[str] = ()) -> DataFrame:
    """Drop duplicate rows (all columns or ``subset``).  With ``keep_first_by``
    the kept copy is the one with the smallest value of that column within
    ``group`` + values; a partial aggregation, so a hot value never lands in
    one task unreduced."""
    if keep_first_by is None:
        return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()
    values = list(subset) if subset else [c for c in df.columns if c not in (keep_first_by, *group)]
    return df.groupBy(*group, *values).agg(F.min(keep_first_by).alias(keep_first_by))


def number_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = ROW_NUMBER_COL) -> DataFrame:
    """Prepend a 1-based row number (per ``by`` group when given) in ``order``.

    An existing column of that name is an error, as in the reference job."""
    if name in df.columns:
        raise DuplicateColumnError(f"column {name!r} already exists")
    out = (row_number_within(df, list(by), list(order), name) if by
           else global_row_number(df, list(order), name))
    return out.select(name, *df.columns)


def search_rows(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    """Case-insensitive substring search over several text columns (OR); an
    empty query keeps every row."""
    if not query:
        return df
    q = F.lower(F.lit(query))
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    return df.where(cond)


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    """Remove rows whose every cell is blank after trimming."""
    return rows.where(F.exists("cells", lambda c: utrim(c["content"]) != ""))


def fill_missing(df: DataFrame, value: str = "", columns: Sequence[str] | None = None) -> DataFrame:
    """Null or blank (after trim) string values -> ``value``."""
    cols = set(columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
    return df.select(*[F.when(F.col(c).isNull() | (utrim(F.col(c)) == ""), F.lit(value)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: values that parse as numbers -> count, min, max, mean,
    sample stddev.  One pass (all columns in one aggregation), long output."""
    cols = list(columns or df.columns)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("string").try_cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"),
                 F.avg(v).alias(f"av{i}"), F.stddev_samp(v).alias(f"sd{i}")]
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("numeric_count"), F.col(f"mn{i}").alias("min"),
        F.col(f"mx{i}").alias("max"), F.col(f"av{i}").alias("mean"), F.col(f"sd{i}").alias("stddev"))
        for i, c in enumerate(cols)])))


def summary_row(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One-row table of column sums (numeric parse of each value)."""
    cols = list(columns or df.columns)
    return df.agg(*[F.sum(F.col(c).cast("string").try_cast("double")).alias(c) for c in cols])
