"""Workbooks as a Spark source.

Files are cut into XML texts by :mod:`sheetlens.sources.parts` and written once to the
shared folder; everything else is DataFrame work in the JVM: ``from_xml`` parses worksheet
rows, shared strings, styles and the theme, shared strings are joined to the cells that
refer to them, styles to the rows of their file, merged ranges to the rows they cover, and
gap rows and cells are filled in.  So the rows of one large workbook spread over tasks.

A file with any fault (no zip, a truncated or malformed part, a reference to no style)
gives one row with ``error`` set and no cells, whatever its size; the job goes on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.functions.cells import held, let
from sheetlens.functions.text import argb_to_rgb, tinted
from sheetlens.model import ROWS_SCHEMA
from sheetlens.scratch import written
from sheetlens.sources.palette import INDEXED_COLORS, THEME_SLOTS
from sheetlens.sources.parts import cut_workbooks
from sheetlens.sources.workbook_source import XLSX_GLOB, is_folder, opens, read_parts

_TEXT = "struct<t:array<string>,r:array<struct<t:array<string>>>>"
_CELLS = f"array<struct<_r:string,_s:string,_t:string,v:string,is:{_TEXT}>>"
_ROW_XML = f"c {_CELLS}, bad string"
_ROWS_XML = f"row array<struct<c:{_CELLS}>>, bad string"
_STRINGS_XML = f"si array<{_TEXT}>, bad string"
_STRING_XML = "t array<string>, r array<struct<t:array<string>>>, bad string"
_COLOR = "struct<_rgb:string,_indexed:string,_theme:string,_tint:string>"
_FLAG = "struct<_VALUE:string,_val:string>"
_STYLES_XML = (f"fonts struct<font:array<struct<b:{_FLAG},i:{_FLAG},color:{_COLOR}>>>, "
               f"fills struct<fill:array<struct<patternFill:struct<fgColor:{_COLOR},bgColor:{_COLOR}>>>>, "
               "cellXfs struct<xf:array<struct<_fillId:string,_fontId:string>>>, bad string")
_THEME_XML = ("themeElements struct<clrScheme:struct<" + ",".join(
    f"{s}:struct<srgbClr:struct<_val:string>,sysClr:struct<_lastClr:string>>" for s in THEME_SLOTS) + ">>, bad string")
_XML = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "ignoreSurroundingSpaces": "false"}

_STYLE = "struct<background_color:string,font_color:string,bold:boolean,italic:boolean>"
_FILL = "struct<fg_resolved:string,bg_resolved:string>"
_MERGE = "struct<start_col:int,end_col:int,start_row:int,end_row:int>"
MALFORMED = "DecodeError: malformed part"


def _parsed(xml: str, schema: str) -> Column:
    return F.from_xml(xml, schema, _XML)


def _column_number(ref: Column) -> Column:
    """0-based column of a cell reference such as B3 or $B$3; null if it is none."""
    letters = F.upper(F.regexp_extract(F.coalesce(ref, F.lit("")), r"^\$?([A-Za-z]{1,3})\$?[0-9]+$", 1))
    value = F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, ch: acc * 26 + F.ascii(ch) - 64)
    return F.when(letters != "", value - 1)


def _runs(item: Column) -> Column:
    """Text of a string item: its plain text, then its runs (phonetic text is no part of it)."""
    parts = F.concat(F.coalesce(item["t"], F.array().cast("array<string>")),
                     F.flatten(F.transform(F.coalesce(item["r"], F.array().cast("array<struct<t:array<string>>>")),
                                           lambda r: F.coalesce(r["t"], F.array().cast("array<string>")))))
    return F.array_join(parts, "")


def _expected(i: Column, row: Column) -> Column:
    """Reference of the cell at ``i`` in a row that has a cell in every column (null beyond Z)."""
    return F.concat(F.get(F.array(*[F.lit(chr(65 + k)) for k in range(26)]), i), (row + 1).cast("string"))


def _row_cells(c: Column, row: Column) -> Column:
    """Cells of a worksheet row as stored: (col, t, s, v)."""
    given = F.transform(c, lambda x, i: F.when(x["_r"] == _expected(i, row), i).otherwise(_column_number(x["_r"])))
    at = let(given, lambda g: F.when(F.forall(g, lambda k: k.isNotNull()), g).otherwise(
        F.aggregate(g, F.array().cast("array<int>"), lambda acc, k: F.concat(acc, F.array(
            F.coalesce(k, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + 1))))))
    return let(at, lambda place: F.transform(c, lambda x, i: F.struct(
        F.get(place, i).alias("col"), F.coalesce(x["_t"], F.lit("n")).alias("t"),
        F.coalesce(x["_s"].try_cast("int"), F.lit(0)).alias("s"),
        F.concat(F.coalesce(x["v"], F.lit("")), F.when(x["is"].isNotNull(), _runs(x["is"])).otherwise("")).alias("v"))))


def _bad_style(c: Column) -> Column:
    return F.exists(c, lambda x: x["_s"].isNotNull() & x["_s"].try_cast("int").isNull())


def _raw_rows(parts: DataFrame) -> DataFrame:
    """(file, sheet_index, sheet_name, row_index, cells, bad): ``cells`` as stored, with their column."""
    d = parts.where("kind = 'row'").select("file", "sheet_index", "sheet_name", F.col("pos").alias("row_index"),
                                           _parsed("xml", _ROW_XML).alias("p"))
    d = held(d.withColumn("c", F.coalesce("p.c", F.array().cast(_CELLS))), "c")
    bad = F.col("p").isNull() | F.col("p.bad").isNotNull() | _bad_style(F.col("c"))
    return d.select("file", "sheet_index", "sheet_name", "row_index", _row_cells(F.col("c"), F.col("row_index")).alias("cells"),
                    bad.alias("bad"))


def _color(c: Column, theme: Column | None) -> Column:
    """ARGB of a colour element: explicit, indexed, or (with ``theme``) a theme colour with its tint; '' if none."""
    palette = F.array(*[F.lit(x) for x in INDEXED_COLORS])
    by_theme = tinted(F.get(theme, c["_theme"].try_cast("int")), c["_tint"].try_cast("double")) if theme is not None \
        else F.lit(None).cast("string")
    return F.coalesce(c["_rgb"], F.get(palette, c["_indexed"].try_cast("int")),
                      F.when(c["_indexed"].isNull(), by_theme), F.lit(""))


def _styles(parts: DataFrame) -> DataFrame:
    """(file, xfs, bad): per file the style and fill of every cell format.  Workbooks of one template have the
    same parts, so each different pair of parts is parsed once."""
    of = (parts.where("kind = 'styles'").select("file", F.col("xml").alias("styles"))
          .join(parts.where("kind = 'theme'").select("file", F.col("xml").alias("theme")), "file", "left"))
    of = of.withColumn("look", F.sha2(F.concat_ws("|", "styles", "theme"), 256))
    looks = of.groupBy("look").agg(F.any_value("styles").alias("styles"), F.any_value("theme").alias("themes"))
    return of.select("file", "look").join(_formats(looks).select("look", "xfs", "bad"), "look").drop("look")


def _formats(looks: DataFrame) -> DataFrame:
    """Add ``xfs`` and ``bad`` to rows with the texts ``styles`` and ``themes``."""
    kept = looks.columns
    looks = held(looks.withColumn("h", _parsed("themes", _THEME_XML)).withColumn("p", _parsed("styles", _STYLES_XML)), "h", "p")
    scheme = F.col("h.themeElements.clrScheme")
    colours = F.array(*[F.coalesce(F.concat(F.lit("FF"), F.upper(F.coalesce(
        scheme[s]["srgbClr"]["_val"], scheme[s]["sysClr"]["_lastClr"]))), F.lit("")) for s in THEME_SLOTS])
    d = looks.withColumn("theme", F.when(F.col("h").isNotNull() & F.col("h.bad").isNull(), colours)).withColumn(
        "hbad", F.coalesce(F.col("h.bad"), F.when(F.col("themes").isNotNull() & F.col("h").isNull(), F.lit("theme"))))
    on = lambda f: F.coalesce(f.isNotNull() & ~F.coalesce(f["_val"], F.lit("1")).isin("0", "false"), F.lit(False))
    none = lambda x: F.when(x != "", x)

    def xf(x: Column) -> Column:
        fill = F.get(F.col("p.fills.fill"), F.coalesce(x["_fillId"].try_cast("int"), F.lit(0)))["patternFill"]
        font = F.get(F.col("p.fonts.font"), F.coalesce(x["_fontId"].try_cast("int"), F.lit(0)))
        fg, bg = fill["fgColor"], fill["bgColor"]
        # an explicit colour that is empty text falls through to none
        return F.struct(
            F.struct(argb_to_rgb(none(F.when(fg.isNotNull(), _color(fg, None)))).alias("background_color"),
                     argb_to_rgb(none(F.when(font["color"].isNotNull(), _color(font["color"], None)))).alias("font_color"),
                     on(font["b"]).alias("bold"), on(font["i"]).alias("italic")).alias("style"),
            F.struct(F.coalesce(F.when(fg.isNotNull(), _color(fg, F.col("theme"))), F.lit("")).alias("fg_resolved"),
                     F.coalesce(F.when(bg.isNotNull(), _color(bg, F.col("theme"))), F.lit("")).alias("bg_resolved")).alias("fill"))

    bad = F.col("p").isNull() | F.col("p.bad").isNotNull() | F.col("hbad").isNotNull()
    return d.select(*kept, F.transform("p.cellXfs.xf", xf).alias("xfs"), bad.alias("bad"))


def _range(text: Column) -> Column:
    """The cells that a reference such as A1:C2 names."""
    ends = F.split(text, ":")
    a, b = F.get(ends, F.lit(0)), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))
    row = lambda ref: F.regexp_extract(ref, r"^\$?[A-Za-z]{1,3}\$?([0-9]+)$", 1).try_cast("int") - 1
    return F.struct(F.least(_column_number(a), _column_number(b)).alias("start_col"),
                    F.greatest(_column_number(a), _column_number(b)).alias("end_col"),
                    F.least(row(a), row(b)).alias("start_row"), F.greatest(row(a), row(b)).alias("end_row"))


def _merges(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file, sheet_index, row_index, merges): the ranges over each row of a sheet, in their order."""
    d = parts.where("kind = 'merge'").select("file", "sheet_index", "pos", _range(F.col("xml")).alias("m")).select(
        "file", "sheet_index", "pos", F.col("m.start_row").alias("r0"), F.col("m.end_row").alias("r1"),
        F.col("m.start_col").alias("c0"), F.col("m.end_col").alias("c1"))
    d = d.where("r0 is not null and r1 is not null and c0 is not null and c1 is not null")
    d = d.join(sizes.select("file", "sheet_index", "height"), ["file", "sheet_index"]).where("r0 < height")
    return (d.withColumn("row_index", F.explode(F.sequence(F.col("r0").cast("bigint"), F.least(F.col("r1").cast("bigint"), F.col("height") - 1))))
             .groupBy("file", "sheet_index", "row_index").agg(F.sort_array(F.collect_list(F.struct(
                 "pos", F.col("c0").alias("start_col"), F.col("c1").alias("end_col"), F.col("r0").alias("start_row"),
                 F.col("r1").alias("end_row")))).alias("merges")))


def _faults(parts: DataFrame, raw: DataFrame, styles: DataFrame | None) -> DataFrame:
    """(file, error) of every file that cannot be read whole."""
    strings = parts.where("kind = 'string'").select("file", _parsed("xml", _STRING_XML).alias("p")).where("p is null or p.bad is not null")
    found = [parts.where("kind = 'error'").select("file", "error"),
             raw.where("bad").select("file", F.lit(f"{MALFORMED} (worksheet row)").alias("error")),
             strings.select("file", F.lit(f"{MALFORMED} (shared strings)").alias("error"))]
    if styles is not None:
        found.append(styles.where("bad").select("file", F.lit(f"{MALFORMED} (styles)").alias("error")))
    return reduce(DataFrame.unionByName, found).groupBy("file").agg(F.min("error").alias("error"))


def _small_books(parts: DataFrame, styles: bool) -> DataFrame:
    """(file, error, xfs, sheets) of the workbooks that are one part each: no shuffle, no table in between.  A sheet is
    (sheet_index, sheet_name, pos, merges, rows), rows being arrays of (col, s, text) at the places ``pos``."""
    d = parts.where("kind = 'book'").select("file", "error", "book.*")
    d = held(d.withColumn("sp", _parsed("strings", _STRINGS_XML)).withColumn("sheets", F.transform("sheets", lambda s: F.struct(
        s["sheet_index"].alias("sheet_index"), s["sheet_name"].alias("sheet_name"), s["pos"].alias("pos"), s["merges"].alias("merges"),
        F.from_xml(s["xml"], _ROWS_XML, _XML).alias("p")))), "sp", "sheets")
    if styles:
        d = _formats(d.withColumnRenamed("theme", "themes"))
        no_styles = F.col("styles").isNotNull() & F.col("bad")
    else:
        d, no_styles = d.withColumn("xfs", F.lit(None).cast(f"array<struct<style:{_STYLE},fill:{_FILL}>>")), F.lit(False)
    cells = lambda r: F.coalesce(r["c"], F.array().cast(_CELLS))
    fault = lambda bad, what: F.when(bad, F.lit(f"{MALFORMED} ({what})"))
    no_rows = F.exists("sheets", lambda s: s["p"].isNull() | s["p"]["bad"].isNotNull() | F.exists(
        F.coalesce(s["p"]["row"], F.array().cast(f"array<struct<c:{_CELLS}>>")), lambda r: _bad_style(cells(r))))
    no_strings = F.col("strings").isNotNull() & (F.col("sp").isNull() | F.col("sp.bad").isNotNull())
    error = F.coalesce("error", F.least(fault(no_rows, "worksheet row"), fault(no_strings, "shared strings"), fault(no_styles, "styles")))
    d = held(d.select("file", error.alias("error"), F.when(F.col("styles").isNotNull(), F.col("xfs")).alias("xfs") if styles else "xfs",
                      "sheets", F.transform("sp.si", _runs).alias("texts")), "error", "xfs", "texts")

    def text(c: Column) -> Column:
        return (F.when(c["t"] == "s", F.get("texts", c["v"].try_cast("int")))
                 .when(c["t"] == "b", F.when(F.trim(c["v"]).isin("1", "true"), "TRUE").otherwise("FALSE")).otherwise(c["v"]))

    def sheet(s: Column) -> Column:
        rows = F.transform(s["p"]["row"], lambda r, i: F.transform(_row_cells(cells(r), F.get(s["pos"], i)), lambda c: F.struct(
            c["col"].alias("col"), c["s"].alias("s"), F.coalesce(text(c), F.lit("")).alias("text"))))
        return F.struct(s["sheet_index"].alias("sheet_index"), s["sheet_name"].alias("sheet_name"), s["pos"].alias("pos"),
                        F.filter(F.transform(s["merges"], _range), lambda m: m["start_row"].isNotNull() & m["end_row"].isNotNull()
                                 & m["start_col"].isNotNull() & m["end_col"].isNotNull()).alias("merges"), rows.alias("rows"))

    return held(d.select("file", "error", "xfs", F.when(F.col("error").isNull(), F.transform("sheets", sheet)).alias("sheets")), "sheets")


def _used(rows: Column, pos: Column) -> tuple[Column, Column]:
    """(height, width) of a sheet's used range; null if it has no cell."""
    end = F.transform(rows, lambda r, i: F.when(F.size(r) > 0, F.get(pos, i) + 1))
    return F.array_max(end), F.array_max(F.transform(rows, lambda r: F.array_max(F.transform(r, lambda c: c["col"])))) + 1


_SMALL_CELLS = "array<struct<col:int,s:int,text:string>>"


def _every_row(rows: Column, pos: Column, height: Column) -> Column:
    """(row_index, cells) of every row of the used range; those that the file leaves out have no cells."""
    kept = F.filter(F.transform(rows, lambda r, i: F.struct(F.get(pos, i).alias("row_index"), r.alias("cells"))),
                    lambda r: r["row_index"] < height)
    none = F.array().cast(_SMALL_CELLS)
    gaps = F.transform(F.array_except(F.sequence(F.lit(0).cast("bigint"), height - 1), pos),
                       lambda i: F.struct(i.alias("row_index"), none.alias("cells")))
    return F.when(F.element_at(pos, -1) == F.size(pos) - 1, kept).otherwise(F.concat(kept, gaps))


def _at(cells: Column, i: Column) -> Column:
    """The cell of column ``i``: nearly always at that place; else look for it (the last of a column counts)."""
    here = F.get(cells, i)
    return F.when(here["col"] == i, here).otherwise(F.try_element_at(F.filter(cells, lambda x: x["col"] == i), F.lit(-1)))


def _small_rows(books: DataFrame) -> DataFrame:
    """Canonical rows of small workbooks, one row with ``error`` for each that cannot be read."""
    d = books.where("error is null").select("file", "xfs", F.explode("sheets").alias("s")).select("file", "xfs", "s.*")
    height, width = _used(F.col("rows"), F.col("pos"))
    d = held(d.withColumn("height", height).withColumn("width", width), "height", "width").where("height is not null")
    d = d.select("file", "xfs", "sheet_index", "sheet_name", "width", "merges",
                 F.explode(_every_row(F.col("rows"), F.col("pos"), F.col("height"))).alias("r"))
    no_style = F.struct(F.lit(None).cast("string").alias("background_color"), F.lit(None).cast("string").alias("font_color"),
                        F.lit(False).alias("bold"), F.lit(False).alias("italic")).cast(_STYLE)
    no_fill = F.struct(F.lit("").alias("fg_resolved"), F.lit("").alias("bg_resolved")).cast(_FILL)

    def cell(i: Column) -> Column:
        over = F.filter("merges", lambda m: (m["start_row"] <= F.col("r.row_index")) & (m["end_row"] >= F.col("r.row_index"))
                        & (m["start_col"] <= i) & (m["end_col"] >= i))
        return let(_at(F.col("r.cells"), i), lambda c: let(F.get("xfs", c["s"]), lambda look: F.struct(
            i.alias("column_index"), F.coalesce(c["text"], F.lit("")).alias("content"),
            F.coalesce(look["style"], no_style).cast(_STYLE).alias("style"), F.coalesce(look["fill"], no_fill).cast(_FILL).alias("fill"),
            F.get(over, F.lit(0)).cast(_MERGE).alias("merge_info"))))

    dense = F.transform(F.sequence(F.lit(0), F.col("width") - 1), cell)
    good = held(d.select("file", "sheet_index", "sheet_name", F.col("r.row_index").alias("row_index"), dense.alias("cells")))
    return good.withColumn("error", F.lit(None).cast("string")).select(*ROWS_SCHEMA.names).unionByName(
        _error_rows(books.where("error is not null")))


def _read_rows(parts: DataFrame) -> DataFrame:
    """Canonical rows of small workbooks that were read where they were cut."""
    d = parts.select("file", F.explode("read").alias("s")).select("file", "s.sheet_index", "s.sheet_name", F.explode("s.rows").alias("r"))

    def cell(v: Column, i: Column) -> Column:
        look = F.get("r.looks", i)
        return F.struct(i.alias("column_index"), v.alias("content"), F.coalesce(look["style"], _no_style()).alias("style"),
                        F.coalesce(look["fill"], _no_fill()).alias("fill"), look["merge_info"].alias("merge_info"))

    rows = held(d.select("file", "sheet_index", "sheet_name", F.col("r.row_index").alias("row_index"), F.transform("r.values", cell).alias("cells")))
    return rows.withColumn("error", F.lit(None).cast("string")).select(*ROWS_SCHEMA.names)


def _no_style() -> Column:
    return F.struct(F.lit(None).cast("string").alias("background_color"), F.lit(None).cast("string").alias("font_color"),
                    F.lit(False).alias("bold"), F.lit(False).alias("italic")).cast(_STYLE)


def _no_fill() -> Column:
    return F.struct(F.lit("").alias("fg_resolved"), F.lit("").alias("bg_resolved")).cast(_FILL)


def _error_rows(faults: DataFrame) -> DataFrame:
    return faults.select("file", *[F.lit(None).cast(f.dataType).alias(f.name) for f in ROWS_SCHEMA.fields
                                   if f.name not in ("file", "error")], "error").select(*ROWS_SCHEMA.names)


def _read_tables(parts: DataFrame) -> DataFrame:
    """:func:`_small_tables` of workbooks that were read where they were cut."""
    d = parts.select("file", "error", F.get("read", F.lit(0))["rows"].alias("rows"))
    d = held(d.withColumn("header", _names(F.get("rows", F.lit(0))["values"])), "header", "rows")
    d = held(d.withColumn("error", _table_error(F.size(F.array_distinct("header")) < F.size("header"))), "error")
    body = F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), lambda r: F.struct(r["row_index"].alias("row_index"), r["values"].alias("values")))
    ok = F.col("error").isNull()
    return d.select("file", "error", F.when(ok, F.col("header")).alias("header"), F.when(ok, body).alias("body"))


def _small_tables(books: DataFrame) -> DataFrame:
    """(file, error, header, body) of the first of the chosen sheets of small workbooks; ``body`` holds (row_index,
    values) below the header."""
    d = held(books.select("file", "error", F.get("sheets", F.lit(0)).alias("s")).withColumns(
        dict(zip(("height", "width"), _used(F.col("s.rows"), F.col("s.pos"))))), "height", "width")
    values = lambda r: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(_at(r["cells"], i)["text"], F.lit("")))
    table = F.transform(_every_row(F.col("s.rows"), F.col("s.pos"), F.col("height")),
                        lambda r: F.struct(r["row_index"].alias("row_index"), values(r).alias("values")))
    d = held(d.select("file", "error", F.when(F.col("height").isNotNull(), table).alias("table")), "table")
    head = F.get(F.filter("table", lambda r: r["row_index"] == 0), F.lit(0))["values"]
    d = held(d.withColumn("header", _names(head)), "header")
    error = _table_error(F.size(F.array_distinct("header")) < F.size("header"))
    d = held(d.withColumn("error", error), "error")
    ok = F.col("error").isNull()
    return d.select("file", "error", F.when(ok, F.col("header")).alias("header"),
                    F.when(ok, F.filter("table", lambda r: r["row_index"] > 0)).alias("body"))


def _cut_once(parts: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """The parts written once: those of small workbooks read where they were cut, of the other small ones, and of large
    ones; None where there are none (not all three)."""
    parts = written(parts, "parts")
    kinds = {r[0] for r in parts.select("kind").distinct().collect()}     # a few names
    of = lambda *names: parts.where(F.col("kind").isin(*names))
    large = kinds - {"read", "book"}
    return (of("read") if "read" in kinds else None, of("book") if "book" in kinds or not kinds else None,
            of(*large) if large else None)


class _Book:
    """The parts of large workbooks, parsed once."""

    def __init__(self, parts: DataFrame, styles: bool):
        self.parts = parts
        self.raw = written(_raw_rows(self.parts), "raw-rows")
        self.styles = written(_styles(self.parts), "styles") if styles else None
        self.faults = written(_faults(self.parts, self.raw, self.styles), "faults")
        end = F.when(F.size("cells") > 0, F.col("row_index") + 1)
        wide = F.array_max(F.transform("cells", lambda c: c["col"])) + 1
        self.sizes = (self.raw.groupBy("file", "sheet_index", "sheet_name")
                          .agg(F.max(end).alias("height"), F.max(wide).alias("width"), F.count(end).alias("filled"))
                          .where("height is not null").join(self.faults.select("file"), "file", "left_anti"))

    def rows(self, merges: bool = True) -> DataFrame:
        """Canonical rows of all readable files (without merge state if it is not wanted)."""
        key = ["file", "sheet_index"]
        sized = self.raw.drop("bad", "sheet_name").join(self.sizes, key).where("row_index < height")
        # rows of the used range that the file leaves out
        gaps = (self.sizes.where("filled < height").withColumn("row_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height") - 1)))
                    .join(self.raw.select(*key, "row_index"), [*key, "row_index"], "left_anti")
                    .withColumn("cells", F.array().cast(self.raw.schema["cells"].dataType)))
        d = sized.unionByName(gaps.select(sized.columns))
        refs = (self.raw.select(*key, "row_index", F.inline(F.filter("cells", lambda c: c["t"] == "s")))
                    .select(*key, "row_index", "col", F.col("v").try_cast("bigint").alias("pos")))
        texts = self.parts.where("kind = 'string'").select("file", "pos", _runs(_parsed("xml", _STRING_XML)).alias("text"))
        shared = (refs.join(texts, ["file", "pos"]).groupBy(*key, "row_index")
                      .agg(F.map_from_entries(F.collect_set(F.struct(F.col("col"), F.col("text")))).alias("shared")))
        d = d.join(shared, [*key, "row_index"], "left")
        if merges:
            d = d.join(_merges(self.parts, self.sizes), [*key, "row_index"], "left")
        else:
            d = d.withColumn("merges", F.lit(None).cast(f"array<{_MERGE}>"))
        if self.styles is not None:
            d = d.join(self.styles.select("file", "xfs"), "file", "left")
        else:
            d = d.withColumn("xfs", F.lit(None).cast(f"array<struct<style:{_STYLE},fill:{_FILL}>>"))
        no_style = F.struct(F.lit(None).cast("string").alias("background_color"), F.lit(None).cast("string").alias("font_color"),
                            F.lit(False).alias("bold"), F.lit(False).alias("italic"))
        no_fill = F.struct(F.lit("").alias("fg_resolved"), F.lit("").alias("bg_resolved"))

        def cell(i: Column) -> Column:
            here = F.get("cells", i)                 # nearly always; else look for it (the last of a column counts)
            c = F.when(here["col"] == i, here).otherwise(F.try_element_at(F.filter("cells", lambda x: x["col"] == i), F.lit(-1)))
            text = (F.when(c["t"] == "s", F.try_element_at("shared", i))
                     .when(c["t"] == "b", F.when(F.trim(c["v"]).isin("1", "true"), "TRUE").otherwise("FALSE")).otherwise(c["v"]))
            look = F.get("xfs", c["s"])
            over = F.get(F.filter("merges", lambda m: (m["start_col"] <= i) & (m["end_col"] >= i)), F.lit(0))
            return F.struct(i.alias("column_index"), F.coalesce(text, F.lit("")).alias("content"),
                            F.coalesce(look["style"], no_style).cast(_STYLE).alias("style"),
                            F.coalesce(look["fill"], no_fill).cast(_FILL).alias("fill"),
                            F.when(over.isNotNull(), F.struct(over["start_col"].alias("start_col"), over["end_col"].alias("end_col"),
                                                              over["start_row"].alias("start_row"), over["end_row"].alias("end_row")))
                            .cast(_MERGE).alias("merge_info"))

        dense = F.transform(F.sequence(F.lit(0), F.col("width") - 1), cell)
        return d.select("file", "sheet_index", "sheet_name", "row_index", dense.alias("cells"), F.lit(None).cast("string").alias("error"))

    def error_rows(self) -> DataFrame:
        return _error_rows(self.faults)


def decode_workbooks(files: DataFrame, sheets="first", styles: bool = True) -> DataFrame:
    """(path, content) -> canonical ``rows``.  ``sheets``: 'first' (default),
    'all', a 0-based index, or a name (missing name -> first sheet).  A sheet without
    cells gives no rows."""
    return decode_parts(cut_workbooks(files, sheets, styles), styles)


def decode_parts(parts: DataFrame, styles: bool = True) -> DataFrame:
    """Parts of workbooks (of ``spark.read.format("workbook_parts")``) -> canonical ``rows``."""
    read, small, large = _cut_once(parts)
    found = []
    if read is not None:
        found.append(_read_rows(read))
    if small is not None:
        found.append(_small_rows(_small_books(small, styles)))
    if large is not None:
        book = _Book(large, styles)
        found += [book.rows(), book.error_rows()]
    return reduce(DataFrame.unionByName, found)


def manifest_from(files: DataFrame) -> DataFrame:
    """(path, content) -> (file, sheet_index, sheet_name, error): reads only
    the workbook part of each file."""
    return _manifest(cut_workbooks(files, cells=False))


def _manifest(parts: DataFrame) -> DataFrame:
    return parts.where("kind in ('sheet', 'error')").select("file", "sheet_index", "sheet_name", "error")


def binary_files(spark: SparkSession, directory: str, glob: str = XLSX_GLOB) -> DataFrame:
    """Non-recursive listing of ``directory`` as (path, content)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
            .select("path", "content"))


def read_workbooks(spark: SparkSession, directory: str, sheets="first", styles: bool = True,
                   glob: str = XLSX_GLOB) -> DataFrame:
    """Canonical rows of the workbooks in a folder.  Tasks open the files themselves where they can (large files by
    sheet); a folder that only Spark reads goes through ``binaryFile``."""
    if glob == XLSX_GLOB and opens(directory):
        return decode_parts(read_parts(spark, directory, sheets, styles), styles)
    return decode_workbooks(binary_files(spark, directory, glob), sheets, styles)


def workbook_manifest(spark: SparkSession, directory: str, glob: str = XLSX_GLOB) -> DataFrame:
    """(file, sheet_index, sheet_name, error) of the workbooks in a folder: their sheet lists only."""
    if glob == XLSX_GLOB and opens(directory):
        return _manifest(read_parts(spark, directory, cells=False))
    return manifest_from(binary_files(spark, directory, glob))


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull())


def file_errors(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNotNull()).select("file", "error")


TABLE_SCHEMA = "file string, header array<string>, row_index bigint, values array<string>, error string"


def _header(cells: Column) -> Column:
    """Column names from a sheet's first row: its texts; an empty one (not trimmed) is Column_<i>."""
    return _names(F.transform(cells, lambda c: c["content"]))


def _names(texts: Column) -> Column:
    return F.transform(texts, lambda t, i: F.when(t == "", F.concat(F.lit("Column_"), i.cast("string"))).otherwise(t))


def _table_error(twice: Column) -> Column:
    return (F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("header").isNull(), F.lit("DecodeError: sheet is empty"))
             .when(twice, F.lit("DecodeError: duplicate column names in header")))


def _tables(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, status) of the table read of large workbooks: status has (file, error, header) of every file."""
    book = _Book(parts, styles=False)
    rows = book.rows(merges=False)
    heads = rows.where("row_index = 0").select("file", _header(F.col("cells")).alias("header"))
    heads = heads.withColumn("twice", F.size(F.array_distinct("header")) < F.size("header"))
    status = book.parts.select("file").distinct().join(book.faults, "file", "left").join(heads, "file", "left")
    error = _table_error(F.col("twice"))
    status = written(status.select("file", error.alias("error"), F.when(error.isNull(), F.col("header")).alias("header")), "status")
    good = status.where("error is null").select("file", "header")
    body = (rows.where("row_index > 0").select("file", "row_index", F.transform("cells", lambda c: c["content"]).alias("values"))
                .join(good, "file").select("file", "header", "row_index", "values", F.lit(None).cast("string").alias("error")))
    return body, status


def decode_tables(files: DataFrame, sheet="first") -> DataFrame:
    """(path, content) -> (file, header, row_index, values, error): table rows (header
    from row 1, body rows after it), plus one status row per file (``row_index`` NULL;
    ``error`` NULL and the header on success)."""
    return decode_run(files, sheet)[0]


def decode_status(files: DataFrame, sheet="first") -> DataFrame:
    """(path, content) -> (file, error, header): the outcome of the table read of
    every file (same checks and messages as :func:`decode_tables`)."""
    return decode_run(files, sheet)[1]


def decode_run(files: DataFrame, sheet="first") -> tuple[DataFrame, DataFrame]:
    """What :func:`decode_tables` and :func:`decode_status` give, of files that are cut once."""
    return decode_run_parts(cut_workbooks(files, sheet, False))


def folder_run(spark: SparkSession, directory: str, sheet="first") -> tuple[DataFrame, DataFrame]:
    """:func:`decode_run` of the workbooks in a folder, which tasks open themselves where they can."""
    if is_folder(directory) and isinstance(sheet, (int, str)):
        return decode_run_parts(read_parts(spark, directory, sheet, styles=False, empty="false"))
    return decode_run(binary_files(spark, directory), sheet)


def decode_run_parts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`decode_run` of parts that were cut without styles."""
    read, small, large = _cut_once(parts)
    found = []
    if read is not None:
        found.append(_read_tables(read))
    if small is not None:
        found.append(_small_tables(_small_books(small, False)))
    tables, states = [], []
    for books in found:
        first = F.struct(F.lit(None).cast("bigint").alias("row_index"), F.lit(None).cast("array<string>").alias("values"))
        every = F.concat(F.array(first), F.coalesce("body", F.array().cast("array<struct<row_index:bigint,values:array<string>>>")))
        rows = held(books.select("file", "header", every.alias("every"), "error"), "every")
        tables.append(rows.select("file", "header", F.inline("every"), "error").withColumn(
            "error", F.when(F.col("row_index").isNull(), F.col("error"))))
        states.append(books.select("file", "error", "header"))
    if large is not None:
        body, status = _tables(large)
        tables += [body, status.select("file", "header", F.lit(None).cast("bigint").alias("row_index"),
                                       F.lit(None).cast("array<string>").alias("values"), "error")]
        states.append(status)
    return reduce(DataFrame.unionByName, tables), reduce(DataFrame.unionByName, states)
