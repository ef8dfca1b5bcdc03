"""Sheet structure and colour analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.functions.cells import contents, held
from sheetlens.functions.text import display_hex
from sheetlens.model import SHEET_KEY

KEY = list(SHEET_KEY)


def sheet_size(rows: DataFrame) -> DataFrame:
    """(file, sheet_index, height, width): highest row / column + 1."""
    return rows.where(F.col("error").isNull()).groupBy(*KEY).agg(
        (F.max("row_index") + 1).alias("height"),
        F.max(F.size("cells")).cast("bigint").alias("width"))


def sheet_dump(rows: DataFrame) -> DataFrame:
    """Every row: 1-based row number and the contents of all its cells."""
    return rows.where(F.col("error").isNull()).select(
        *KEY, (F.col("row_index") + 1).alias("row_number"), contents("cells").alias("values"))


def _cell_argb(cell) -> "F.Column":
    """Theme-resolved fill colour of a cell as stored: foreground, else background, empty skipped."""
    fg, bg = cell["fill"]["fg_resolved"], cell["fill"]["bg_resolved"]
    return F.coalesce(F.nullif(fg, F.lit("")), F.nullif(bg, F.lit("")))


def cell_hex(cell) -> "F.Column":
    """Theme-resolved fill colour of a cell: foreground, else background,
    empty skipped; as display hex (NULL when the cell has no colour)."""
    argb = _cell_argb(cell)
    return F.when(argb.isNotNull(), display_hex(argb))


def _row_colour_counts(rows: DataFrame) -> DataFrame:
    """Per row: (hex, n) for every colour in the row, counted inside the row's
    own cell array (no shuffle).  The row's colours are bound to a lambda variable,
    so they are worked out once a row and not once for each colour."""
    hexes = F.array_compact(F.transform("cells", cell_hex))
    counted = F.get(F.transform(F.array(hexes), lambda own: F.transform(F.array_distinct(own), lambda h: F.struct(
        h.alias("hex"), F.size(F.filter(own, lambda x: x == h)).cast("bigint").alias("n")))), 0)
    extra = ["width"] if "width" in rows.columns else []
    rows = held(rows.where(F.col("error").isNull()).select(*KEY, "row_index", *extra, "cells"))
    return held(rows.select(*KEY, "row_index", *extra, counted.alias("colours")), "colours")


def color_histogram(rows: DataFrame) -> DataFrame:
    """(file, sheet_index, hex, cells): coloured cells per colour.  Cells are counted by the
    colour as stored, combined before the shuffle; the hex is made of the counted ones."""
    cells = held(rows.where(F.col("error").isNull()).select(*KEY, "cells")).select(*KEY, F.explode("cells").alias("cell"))
    argb = cells.select(*KEY, _cell_argb(F.col("cell")).alias("argb"))
    stored = argb.where(F.col("argb").isNotNull()).groupBy(*KEY, "argb").agg(F.count(F.lit(1)).alias("n"))
    return stored.groupBy(*KEY, display_hex("argb").alias("hex")).agg(F.sum("n").alias("cells"))


def top_colors(rows: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent colours per sheet with their 1-based rank (ties by hex).

    The window runs over the per-sheet histogram (one row per distinct colour)."""
    w = Window.partitionBy(*KEY).orderBy(F.col("cells").desc(), F.col("hex"))
    return (color_histogram(rows).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def dominant_rows(rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Rows whose most frequent colour covers more than max(width div 2, 1)
    cells, width being the sheet width (uncoloured cells included).

    Canonical rows are dense over the sheet's width, so the width is the
    row's own cell count: one narrow pass, no aggregate, no join.  ``sizes``
    (from :func:`sheet_size`) is for inputs whose rows are not dense."""
    if sizes is None:
        rows = rows.withColumn("width", F.size("cells").cast("bigint"))
    # the threshold is at least 1, so only counts >= 2 can qualify
    per_row = (_row_colour_counts(rows).select(*KEY, "row_index", *(["width"] if sizes is None else []),
                                               F.inline("colours"))
               .where(F.col("n") >= 2))
    if sizes is not None:
        per_row = per_row.join(sizes.select(*KEY, "width"), KEY)
    threshold = F.greatest(F.expr("width div 2"), F.lit(1).cast("bigint"))
    return per_row.where(F.col("n") > threshold).select(*KEY, "row_index", "hex", "n")


def color_sample(rows: DataFrame, only_uncoloured: bool = True, max_rows: int = 10, max_cols: int = 5) -> DataFrame:
    """Raw fill values of the first ``max_rows`` x ``max_cols`` cells that have
    any, for sheets without a detected colour (all sheets when
    ``only_uncoloured`` is False; then ``sheet_has_colors`` tells which).

    One pass: each row contributes whether it has a detected colour and, if
    it is among the first ``max_rows``, its sampled cells; one aggregation per
    sheet combines them (at most ``max_rows`` x ``max_cols`` cells per sheet)."""
    ok = rows.where(F.col("error").isNull())
    fg = lambda c: F.coalesce(c["fill"]["fg_resolved"], F.lit(""))
    bg = lambda c: F.coalesce(c["fill"]["bg_resolved"], F.lit(""))
    sampled = F.when(F.col("row_index") < max_rows, F.transform(
        F.filter(F.slice("cells", 1, max_cols), lambda c: (fg(c) != "") | (bg(c) != "")),
        lambda c: F.struct(F.col("row_index").alias("row_index"), c["column_index"].alias("column_index"),
                           fg(c).alias("fg_argb"), bg(c).alias("bg_argb"))))
    per_sheet = (ok.select(*KEY, F.exists("cells", lambda c: cell_hex(c).isNotNull()).alias("_coloured"),
                           sampled.alias("_sample"))
                 .groupBy(*KEY).agg(F.max("_coloured").alias("sheet_has_colors"),
                                    F.flatten(F.collect_list("_sample")).alias("_cells")))
    out = per_sheet.select(*KEY, "sheet_has_colors", F.inline("_cells")).select(
        *KEY, "row_index", "column_index", "fg_argb", "bg_argb", "sheet_has_colors")
    return out.where(~F.col("sheet_has_colors")) if only_uncoloured else out


def analyze_structure(rows: DataFrame, sheet: str | int | None = None, colors: bool = False) -> dict:
    """The structure job: pick a sheet per file (by name, else the first),
    then size, dump and (optionally) colour tables."""
    from sheetlens.sources.manifest import pick_sheet
    from sheetlens.scratch import written
    picked = written(pick_sheet(rows, sheet), "picked")     # every output reads the rows, none makes them again
    out = {"size": sheet_size(picked), "dump": sheet_dump(picked)}
    if colors:
        out.update(colors=top_colors(picked), dominant=dominant_rows(picked, out["size"]),
                   sample=color_sample(picked))
    return out


def analyze_workbooks(files: DataFrame, sheet: str | int | None = None, colors: bool = False) -> dict:
    """The structure job on workbook files ``(path, content)``: the decoder
    picks the sheet (by name, else the first), the rows are decoded once into
    a table in the shared folder, and every output reads that."""
    from sheetlens.scratch import written
    from sheetlens.sources.xlsx import decode_workbooks

    rows = written(decode_workbooks(files, sheets=sheet if sheet is not None else "first"), "rows")
    out = {"size": sheet_size(rows), "dump": sheet_dump(rows), "errors": rows.where(F.col("error").isNotNull())
           .select("file", "error")}
    if colors:
        out.update(colors=top_colors(rows), dominant=dominant_rows(rows), sample=color_sample(rows))
    return out
