"""Small workbooks are cut straight from their bytes: the same parts and faults as through zipfile."""

import io
import zipfile

import pytest

from sheetlens.sources import parts as P
from sheetlens.sources.xlsx_writer import workbook_bytes

ROWS = [[{"v": "a&b", "fill": "FFC6EFCE"}, {"v": "rich text", "t": "rich"}], None, [1, True, {"v": None, "fill": "FF646464"}, "a&b"]]
BOOK = workbook_bytes([("One", ROWS, [(0, 0, 0, 3)]), ("Two", [["x" * 9000]], [])])


def rebuilt(change=None, **kw):
    """The workbook with its first sheet's XML changed."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(BOOK)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            data = old.read(name)
            new.writestr(name, change(data) if change and name.endswith("sheet1.xml") else data, **kw)
    return out.getvalue()


def cut(source, cells):
    return [r for b in P.part_batches(iter([("f", lambda: source, None)]), "all", True, cells) for r in b.to_pylist()]


def broken(at):
    return BOOK[:at] + bytes([BOOK[at] ^ 255]) + BOOK[at + 1:]


FIRST = BOOK.index(b"xl/worksheets/sheet1.xml") + len(b"xl/worksheets/sheet1.xml")
CASES = {
    "plain": BOOK,
    "stored": rebuilt(compress_type=zipfile.ZIP_STORED),
    "comment and CDATA": rebuilt(lambda x: x.replace(b"<row", b"<!-- <row r='9'/> --><row", 1).replace(b"</is>", b"<![CDATA[</row>]]></is>", 1)),
    "prefixes": rebuilt(lambda x: x.replace(b"<row", b"<s:row").replace(b"</row", b"</s:row")),
    "row without end": rebuilt(lambda x: x.replace(b"</row>", b"")),
    "empty rows": rebuilt(lambda x: x.replace(b"</sheetData>", b'<row r="7"/><row r="8" /></sheetData>')),
    "rows out of order": rebuilt(lambda x: x.replace(b'r="3"', b'r="1"')),
    "no root end": rebuilt(lambda x: x.replace(b"</worksheet>", b"")),
    "root alone": rebuilt(lambda x: b"<worksheet/>"),
    "half": BOOK[:len(BOOK) // 2],
    "none": b"",
    "wrong bytes in a sheet": broken(FIRST + 5),
    "wrong directory": broken(len(BOOK) - 60),
    "bytes before": b"junk" + BOOK,
    "bytes after": BOOK + b"junk",
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("cells", [True, False])
def test_bytes_are_cut_as_through_zipfile(name, cells):
    assert cut(CASES[name], cells) == cut(io.BytesIO(CASES[name]), cells)


def test_plain_workbook_needs_no_zipfile(monkeypatch):
    want = cut(io.BytesIO(BOOK), True)

    def refused(*_):
        raise AssertionError("opened by zipfile")
    monkeypatch.setattr(P.zipfile, "ZipFile", refused)
    assert cut(BOOK, True) == want


def test_written_zip_holds():
    with zipfile.ZipFile(io.BytesIO(BOOK)) as zf:
        assert zf.testzip() is None
        assert b"x" * 9000 in zf.read("xl/sharedStrings.xml")
