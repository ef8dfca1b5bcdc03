"""Workbook source round trips: files written with stdlib zipfile, read back
through binaryFile + mapInArrow (FIXTURES.md §F)."""

import io
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import batch as B
from sheetlens.operators import classify as C
from sheetlens.operators.profiles import cargo_analysis
from sheetlens.sources import xlsx as XL
from sheetlens.sources.xlsx_writer import workbook_bytes

GRID = [
    [{"v": "G00E-1", "fill": "FFC6EFCE"}, None, {"v": "", "fill": "FFC6EFCE"}],
    None,                                                    # gap row
    [{"v": "序号", "fill": "FFD9D9D9", "bold": True}, {"v": "物料", "fill": "FFD9D9D9"}],
    [{"v": 1}, {"v": "bolt", "t": "inline"}, {"v": True}],
    [{"v": "x", "fill_theme": 4}, {"v": 2.5}, {"v": "4", "t": "f", "formula": "2+2"}],
]
TABLE = [["a", "", "c"], ["1", "2", "3"], ["1", "2", "3"], ["4", "5", "6"]]


@pytest.fixture(scope="module")
def book_dir():
    d = tempfile.mkdtemp(prefix="sheetlens-test-")
    with open(os.path.join(d, "A.xlsx"), "wb") as f:
        f.write(workbook_bytes([("Grid", GRID, [(0, 0, 0, 2)]), ("Table", TABLE, [])]))
    with open(os.path.join(d, "B.XLSX"), "wb") as f:
        f.write(workbook_bytes([("Only", [["h1", "h1"], ["x", "y"]], [])]))      # duplicate header
    with open(os.path.join(d, "C.xlsx"), "wb") as f:
        f.write(workbook_bytes([("Empty", [], [])]))
    with open(os.path.join(d, "D.xlsx"), "wb") as f:
        f.write(workbook_bytes([("T", TABLE, [])])[:200])                       # truncated zip
    with open(os.path.join(d, "E.xlsx"), "wb") as f:
        f.write(workbook_bytes([("NoRefs", TABLE, [])], omit_refs=True))
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("not a workbook")
    return d


def by_file(rows):
    return {os.path.basename(r["file"]): r for r in rows}


def test_listing_is_case_insensitive_and_skips_other_files(spark, book_dir):
    names = sorted(os.path.basename(r["path"]) for r in XL.binary_files(spark, book_dir).select("path").collect())
    assert names == ["A.xlsx", "B.XLSX", "C.xlsx", "D.xlsx", "E.xlsx"]


def test_styled_rows(spark, book_dir):
    rows = XL.read_workbooks(spark, book_dir).where(F.col("file").endswith("A.xlsx")).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == [0, 1, 2, 3, 4]                     # dense, gap row present
    assert all(len(r["cells"]) == 3 for r in rows)
    r0 = rows[0]["cells"]
    assert r0[0]["content"] == "G00E-1" and r0[0]["style"]["background_color"] == "C6EFCE"
    assert r0[1]["content"] == "" and r0[1]["merge_info"]["start_col"] == 0 and r0[1]["merge_info"]["end_col"] == 2
    assert rows[1]["cells"][0]["content"] == "" and rows[1]["cells"][0]["merge_info"] is None
    assert rows[2]["cells"][0]["style"]["bold"] is True
    assert [c["content"] for c in rows[3]["cells"]] == ["1", "bolt", "TRUE"]
    assert [c["content"] for c in rows[4]["cells"]] == ["x", "2.5", "4"]
    theme = rows[4]["cells"][0]
    assert theme["style"]["background_color"] is None                          # theme fill: white for rules
    assert theme["fill"]["fg_resolved"] not in ("", None)                       # but resolved for the analyser


def test_error_rows_and_empty_sheet(spark, book_dir):
    rows = XL.read_workbooks(spark, book_dir).collect()
    errs = {os.path.basename(r["file"]) for r in rows if r["error"] is not None}
    assert errs == {"D.xlsx"}
    assert not [r for r in rows if r["file"].endswith("C.xlsx")]                  # empty sheet: zero rows


def test_manifest_and_sheet_choice(spark, book_dir):
    m = XL.workbook_manifest(spark, book_dir).where(F.col("error").isNull())
    got = sorted((os.path.basename(r["file"]), r["sheet_index"], r["sheet_name"]) for r in m.collect())
    assert ("A.xlsx", 1, "Table") in got and ("B.XLSX", 0, "Only") in got
    t = XL.read_workbooks(spark, book_dir, sheets="Table").where(F.col("file").endswith("A.xlsx"))
    assert t.select("sheet_name").distinct().first()[0] == "Table"
    t = XL.read_workbooks(spark, book_dir, sheets="Missing").where(F.col("file").endswith("A.xlsx"))
    assert t.select("sheet_name").distinct().first()[0] == "Grid"


def test_classify_decoded_workbook(spark, book_dir):
    rows = XL.read_workbooks(spark, book_dir).where(F.col("file").endswith("A.xlsx"))
    types = [r["row_type"] for r in C.classify(rows, cargo_analysis()).orderBy("row_index").collect()]
    # row 0 is green but merged over 0..2, not 0..10: not a project row, and not white
    assert types == ["Unknown", "Unknown", "Header", "Data", "Data"]


def test_tables_and_batch_run(spark, book_dir):
    out = os.path.join(tempfile.mkdtemp(prefix="sheetlens-out-"), "out")
    run = B.run_batch(spark, book_dir, out, process=B.dedupe_per_file, sheet=1)
    st = run.stats().first()
    assert st["total_files"] == 5
    failed = {os.path.basename(e["file"]) for e in run.errors().collect()}
    assert failed == {"B.XLSX", "C.xlsx", "D.xlsx", "E.xlsx"}          # only A has a second sheet
    tables = run.tables.where(F.col("source_file").endswith("A.xlsx")).collect()
    assert sorted(tuple(r["values"]) for r in tables) == [("1", "2", "3"), ("4", "5", "6")]
    assert list(tables[0]["header"]) == ["a", "Column_1", "c"]
    csv = spark.read.option("header", True).csv(out)
    assert csv.count() >= 2
    assert spark.read.parquet(B.status_path(out)).count() == 5


def test_tables_first_sheet(spark, book_dir):
    run = B.read_tables(XL.binary_files(spark, book_dir))
    status = by_file(run.status.collect())
    assert status["A.xlsx"]["error"] is None and status["E.xlsx"]["error"] is None
    assert "duplicate" in status["B.XLSX"]["error"]
    assert "empty" in status["C.xlsx"]["error"]
    assert status["D.xlsx"]["error"] is not None
    e = run.tables.where(F.col("source_file").endswith("E.xlsx")).orderBy("row_index").collect()
    assert [list(r["values"]) for r in e] == TABLE[1:]


def _edit(content, member, change):
    """The workbook with one member's bytes changed (None: taken out)."""
    src, out = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in src.namelist():
            data = change(src.read(n)) if n == member else src.read(n)
            if data is not None:
                z.writestr(n, data)
    return out.getvalue()


def test_a_fault_in_any_part_is_one_error_row(spark):
    good = workbook_bytes([("Grid", GRID, [(0, 0, 0, 2)]), ("Table", TABLE, [])])
    half = lambda d: d[: len(d) // 2]
    sheet = "xl/worksheets/sheet1.xml"
    items = [("good", good)] + [(m, _edit(good, m, half)) for m in (
        "xl/workbook.xml", "xl/styles.xml", "xl/sharedStrings.xml", sheet, "xl/theme/theme1.xml")]
    items += [("gone", _edit(good, sheet, lambda d: None)),
              ("tag", _edit(good, sheet, lambda d: d.replace(b"</v>", b"</w>", 1))),
              ("style", _edit(good, sheet, lambda d: d.replace(b' s="1"', b' s="x"', 1))),
              ("order", _edit(good, sheet, lambda d: d.replace(b'r="4"', b'r="1"', 1)))]
    rows = XL.decode_workbooks(spark.createDataFrame(items, "path string, content binary"), sheets="all").collect()
    per = {}
    for r in rows:
        per.setdefault(r.file, []).append(r.error)
    assert len(per.pop("good")) == 9
    assert all(len(e) == 1 and e[0] for e in per.values()) and len(per) == 9


def test_rows_cut_at_any_chunk_border(monkeypatch):
    from sheetlens.sources import parts

    content = workbook_bytes([("Grid", GRID, [(0, 0, 0, 2), (2, 1, 3, 1)]), ("Table", TABLE, [])])
    whole = list(parts._pieces(content, "all", True, True))
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(parts, "_CHUNK", size)
        assert list(parts._pieces(content, "all", True, True)) == whole


def test_prefixes_phonetic_text_and_empty_elements(spark):
    ns = 'xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = (f'<x:worksheet {ns}><x:sheetData><x:row r="2" x14ac:dyDescent="0.25"><x:c r="B2" t="s"><x:v>1</x:v></x:c>'
             '<x:c t="s"><x:v>0</x:v></x:c><x:c r="E2" t="str"><x:f>1</x:f><x:v> a&amp;b </x:v></x:c></x:row><x:row r="9"/></x:sheetData>'
             '<x:mergeCells><x:mergeCell ref="C2:B1"/><x:mergeCell ref="A1:A5000"/></x:mergeCells></x:worksheet>').encode()
    sst = (f'<x:sst {ns}><x:si><x:r><x:t>one</x:t></x:r><x:r><x:t xml:space="preserve"> two</x:t></x:r><x:rPh sb="0" eb="1"><x:t>no</x:t>'
           '</x:rPh></x:si><x:si><x:t xml:space="preserve"> sp </x:t></x:si></x:sst>').encode()
    book = workbook_bytes([("S", [["q"]], [])])
    book = _edit(_edit(book, "xl/worksheets/sheet1.xml", lambda d: sheet), "xl/sharedStrings.xml", lambda d: sst)
    rows = sorted(XL.decode_workbooks(spark.createDataFrame([("p", book)], "path string, content binary")).collect(),
                  key=lambda r: r.row_index)
    assert [[c.content for c in r.cells] for r in rows] == [[""] * 5, ["", " sp ", "one two", "", " a&b "]]
    merged = [[c.merge_info and tuple(c.merge_info) for c in r.cells] for r in rows]
    assert merged == [[(0, 0, 0, 4999), (1, 2, 0, 1), (1, 2, 0, 1), None, None]] * 2


def test_one_large_file_spreads_over_tasks(spark):
    book = workbook_bytes([("S", [[{"v": f"t{i % 50}"}, {"v": i}] for i in range(20_000)], [])])
    rows = XL.decode_workbooks(spark.createDataFrame([("p", book)], "path string, content binary"))
    assert rows.count() == 20_000
    r = rows.where("row_index = 12345").first()
    assert [c.content for c in r.cells] == ["t45", "12345"]


def test_analyze_workbooks_decodes_once_per_choice(spark, book_dir):
    from sheetlens.operators.structure import analyze_workbooks

    out = analyze_workbooks(XL.binary_files(spark, book_dir), sheet="Table", colors=True)
    sizes = {os.path.basename(r["file"]): (r["sheet_index"], r["height"], r["width"]) for r in out["size"].collect()}
    assert sizes["A.xlsx"] == (1, 4, 3)            # named sheet
    assert sizes["E.xlsx"] == (0, 4, 3)            # no sheet of that name: the first
    assert {os.path.basename(r["file"]) for r in out["errors"].collect()} == {"D.xlsx"}
    assert out["dump"].where(F.col("file").endswith("A.xlsx")).count() == 4
