"""The workbook data source, faults in sheet parts, theme tints."""

import io
import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sheetlens.sources import parts as P
from sheetlens.sources import workbook_source as W
from sheetlens.sources import xlsx as XL
from sheetlens.sources.xlsx_writer import workbook_bytes

SHEET = [[{"v": "a", "t": "inline"}, {"v": 1}], [{"v": "b"}, {"v": 2.5}], None, [{"v": "c"}, {"v": True}]]


def with_part(data: bytes, name: str, change) -> bytes:
    """The workbook with one member changed."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
        for i in src.infolist():
            dst.writestr(i, change(src.read(i)) if i.filename == name else src.read(i))
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    big = [[{"v": f"r{i}"}, {"v": i}] for i in range(3000)]
    books = {"big.xlsx": workbook_bytes([("One", big, [(0, 0, 1, 1)]), ("Two", big[:1500], []), ("Three", SHEET, [])]),
             "small.XLSX": workbook_bytes([("S", SHEET, [])]), "bad.xlsx": b"no zip", "notes.txt": b"x",
             "_hidden.xlsx": b"x", "cut.xlsx": workbook_bytes([("S", SHEET, [])])[:300]}
    for name, data in books.items():
        (d / name).write_bytes(data)
    return str(d)


def key(rows):
    return sorted((os.path.basename(r.file), r.sheet_index, r.row_index, str(r.cells), r.error) for r in rows.collect())


@pytest.mark.parametrize("sheets", ["all", "Two"])
def test_equals_the_binary_read(spark, folder, sheets):
    want = key(XL.decode_workbooks(XL.binary_files(spark, folder), sheets))
    assert key(XL.read_workbooks(spark, folder, sheets)) == want
    split = XL.decode_parts(W.read_parts(spark, folder, sheets, splitBytes=1000))
    assert key(split) == want and len(want) > 3


def test_large_sheets_are_tasks_of_their_own(spark, folder):
    reader = W.WorkbookReader({"path": folder, "sheets": "all", "splitbytes": "5000"})
    units = [p.files for p in reader.partitions()]
    big = [u[0][1] for u in units if len(u) == 1 and u[0][0].endswith("big.xlsx")]
    assert sorted(big) == [-1, 0, 1, 2]
    parts = W.read_parts(spark, folder, "all", splitBytes=5000).where("kind = 'row' and file like '%big%'")
    tasks = parts.withColumn("task", F.spark_partition_id()).groupBy("sheet_name").agg(
        F.count_distinct("task").alias("t"), F.first("task").alias("p"))
    found = {r.sheet_name: (r.t, r.p) for r in tasks.collect()}
    assert found["One"][0] == found["Two"][0] == 1 and found["One"][1] != found["Two"][1]
    one = W.WorkbookReader({"path": folder, "sheets": "name:Two", "splitbytes": "5000"}).partitions()
    assert sorted(u[1] for p in one for u in p.files if u[0].endswith("big.xlsx")) == [-1, 1]
    packed = W.WorkbookReader({"path": folder}).partitions()
    assert len(packed) == 1 and [os.path.basename(u) for u, _ in packed[0].files] == ["bad.xlsx", "big.xlsx", "cut.xlsx", "small.XLSX"]


def test_manifest_opens_no_sheet(spark, folder, monkeypatch):
    m = XL.workbook_manifest(spark, folder).collect()
    names = {(os.path.basename(r.file), r.sheet_name) for r in m if r.error is None}
    assert names == {("big.xlsx", "One"), ("big.xlsx", "Two"), ("big.xlsx", "Three"), ("small.XLSX", "S")}
    assert sorted(os.path.basename(r.file) for r in m if r.error) == ["bad.xlsx", "cut.xlsx"]
    read = []
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, own=zipfile.ZipFile.open, **k: read.append(str(name)) or own(self, name, *a, **k))
    reader = W.WorkbookReader({"path": folder, "cells": "false"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 6
    assert read and not any("sheet1" in r or "sharedStrings" in r for r in read)


def test_empty_folder(spark, tmp_path):
    assert XL.read_workbooks(spark, str(tmp_path)).count() == 0 and XL.workbook_manifest(spark, str(tmp_path)).count() == 0


def cut(xml: bytes, name="row") -> list[bytes]:
    return list(P.elements(io.BytesIO(xml), (name,), "worksheet"))


def test_every_truncation_is_a_fault(spark):
    """The sheet cut at every element border: one error row each, no rows."""
    book = workbook_bytes([("S", SHEET + [[{"v": ""}]], [(0, 0, 0, 1)])])
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml")
    borders = [m.end() for m in re.finditer(rb">", sheet)][:-1]
    files = [(f"f{k}", with_part(book, "xl/worksheets/sheet1.xml", lambda b, n=n: b[:n])) for k, n in enumerate(borders)]
    out = XL.decode_workbooks(spark.createDataFrame([*files, ("whole", book)], "path string, content binary")).collect()
    bad = [r for r in out if r.error]
    assert sorted(r.file for r in bad) == sorted(f for f, _ in files) and all(r.cells is None for r in bad)
    assert {r.file for r in out if not r.error} == {"whole"}


def test_comments_and_cdata_are_no_rows():
    head = b'<?xml version="1.0"?><worksheet><sheetData>'
    assert cut(head + b'<!-- <row r="9"/> --><row r="1"/><!----><row r="2"><c/><!-- </row> --></row></sheetData></worksheet>') == [
        b'<row r="1"/>', b'<row r="2"><c/><!-- </row> --></row>']
    assert cut(head + b'<x><![CDATA[<row r="5"/>]]></x><row r="1"><c><v><![CDATA[</row>]]></v></c></row></sheetData></worksheet>') == [
        b'<row r="1"><c><v><![CDATA[</row>]]></v></c></row>']
    assert cut(b"<worksheet/>") == cut(b'<?xml version="1.0"?>\n<worksheet xmlns="u"/>\n') == cut(b"<x:worksheet a='1'/><!-- end -->") == []
    for xml in (b"", b"<worksheet>", head + b'<row r="2"/>', head + b'<row r="2"/><!-- <row/> ', b"<worksheet><a/>", b"<other/>",
                head + b"<!-- </worksheet> -->"):
        with pytest.raises(P.CutError):
            cut(xml)


def test_borders_of_chunks(monkeypatch):
    xml = b"<worksheet>" + b"".join(b'<!-- <row r="0"/> --><row r="%d"><c><v>%d</v></c></row>' % (i, i) for i in range(40)) + b"</worksheet>"
    want = cut(xml)
    assert len(want) == 40
    for size in (1, 7, 64, 100):
        monkeypatch.setattr(P, "_CHUNK", size)
        assert cut(xml) == want


def test_theme_tints(spark):
    cells = [{"v": "x", "fill_theme": 4, "fill_tint": t} for t in (0, 0.4, -0.25, -1, 1)] + [{"v": "y", "fill_indexed": 10}, {"v": "z", "fill": "FF112233"}]
    book = workbook_bytes([("S", [cells], [])])
    r = XL.decode_workbooks(spark.createDataFrame([("p", book)], "path string, content binary")).first()
    plain = r.cells[0].fill.fg_resolved
    assert plain == "FF4472C4"
    assert [c.fill.fg_resolved for c in r.cells] == [plain, "FF8FAADC", "FF2F5597", "FF000000", "FFFFFFFF", "FFFF0000", "FF112233"]
    assert all(c.style.background_color is None for c in r.cells[:5])  # rules see explicit colours only
