"""Small workbooks of plain XML are read where they are cut; the others go to the XML parser, with the same rows."""

import io
import zipfile

import pytest

from sheetlens.sources import parts as P
from sheetlens.sources import xlsx as XL
from sheetlens.sources.xlsx_writer import workbook_bytes

ROWS = [[{"v": "a&b <c>", "fill": "FFC6EFCE", "bold": True}, {"v": "rich text", "t": "rich", "font": "FF0000FF"}, "  "], None,
        [{"v": 1, "fill_theme": 4, "fill_tint": -0.25}, True, None, {"v": "x", "t": "inline", "fill_indexed": 22, "bg": "FF010203"}],
        [None, {"v": "9", "t": "f", "formula": "A1&B1"}, {"v": 2.5, "fill_theme": 0, "fill_tint": 0.4, "italic": True}], []]
PLAIN = workbook_bytes([("One", ROWS, [(0, 0, 0, 3), (2, 1, 3, 2), (0, 0, 3, 0)]), ("Two", [["h", "k"], ["a&b <c>", 5]], []), ("None", [], [])])


def changed(old, new, part="sheet1.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(PLAIN)) as was, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as now:
        for name in was.namelist():
            data = was.read(name)
            now.writestr(name, data.replace(old, new) if name.endswith(part) else data)
    return out.getvalue()


# (workbook, whether it is read where it is cut)
BOOKS = {
    "plain": (PLAIN, True),
    "no references": (workbook_bytes([("One", [["a", "b"], ["c"]], [])], omit_refs=True), True),
    "row attributes": (changed(b'<row r="1">', b'<row r="1" spans="1:3" x14ac:dyDescent="0.25">'), True),
    "string out of range": (changed(b"<v>0</v>", b"<v>77</v>"), True),
    "style out of range": (changed(b's="1"', b's="77"'), True),
    "comment": (changed(b"<v>", b"<v><!-- 3 -->"), False),
    "other entity": (changed(b"&amp;", b"&#38;", "sharedStrings.xml"), False),
    "cells out of order": (changed(b'r="A3"', b'r="F3"'), False),
    "phonetic text": (changed(b'</t></si>', b'</t><rPh sb="0"><t>p</t></rPh></si>', "sharedStrings.xml"), False),
    "two of one attribute": (changed(b'<row r="1">', b'<row r="1" spans="1:3" spans="1:3">'), False),
    "no style number": (changed(b's="1"', b's="x"'), False),
    "rows out of order": (changed(b'<row r="3">', b'<row r="1">'), False),
    "malformed styles": (changed(b"</fonts>", b"</font>", "styles.xml"), False),
    "half": (PLAIN[:len(PLAIN) // 2], False),
}


def parts_of(sheets="all", styles=True):
    batches = P.part_batches(((name, lambda b=b: b, None) for name, (b, _) in BOOKS.items()), sheets, styles, True)
    return [r for b in batches for r in b.to_pylist()]


def test_plain_books_are_read_where_they_are_cut():
    assert {r["file"]: r["kind"] for r in parts_of()} == {name: "read" if plain else "book" for name, (_, plain) in BOOKS.items()}


@pytest.mark.parametrize("sheets", ["all", "Two"])
@pytest.mark.parametrize("styles", [True, False])
def test_both_ways_give_the_same(spark, monkeypatch, sheets, styles):
    def outcome():
        parts = spark.createDataFrame([tuple(r[k] for k in P._ARROW.names) for r in parts_of(sheets, styles)], P.PART_SCHEMA)
        found = [XL.decode_parts(parts, styles), *([] if styles else XL.decode_run_parts(parts))]
        return [sorted(map(repr, df.collect())) for df in found]

    read = outcome()
    monkeypatch.setattr(P, "_plain_book", lambda *_: None)
    assert {r["kind"] for r in parts_of(sheets, styles)} == {"book"}
    assert outcome() == read


def test_plain_books_need_no_xml_parser(spark):
    files = spark.createDataFrame([("f", PLAIN)], "path string, content binary")
    for df in (XL.decode_workbooks(files, "all"), XL.decode_tables(files)):
        assert "from_xml" not in df._jdf.queryExecution().optimizedPlan().toString()
