"""Small workbooks are decoded where they are cut: one part each, no joins; large ones part by part, with the same rows."""

import pytest

from sheetlens.sources import parts as P
from sheetlens.sources import xlsx as XL
from sheetlens.sources.xlsx_writer import workbook_bytes


def _files(spark):
    styled = [[{"v": "a", "fill": "FFC6EFCE"}, {"v": "b", "t": "rich"}, None, True], None, [{"v": 5, "bold": True}, "a", {"v": "x", "t": "inline"}],
              [None, {"v": "", "fill_theme": 4, "fill_tint": 0.4}]]
    plain = [["h", "", "k"], ["1", "2", "3"], ["4", "", "6"]]
    good = workbook_bytes([("S", styled, [(0, 0, 2, 1), (3, 1, 3, 3)]), ("T", plain, [])])
    bare = workbook_bytes([("S", plain, [])], omit_refs=True)
    broken = workbook_bytes([("S", [["x", "y"]], [])])
    return spark.createDataFrame([("good.xlsx", good), ("bare.xlsx", bare), ("cut.xlsx", broken[: len(broken) // 2]), ("none.xlsx", None),
                                  ("twice.xlsx", workbook_bytes([("S", [["q", "q"]], [])])), ("empty.xlsx", workbook_bytes([("S", [], [])]))],
                                 "path string, content binary")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sheets", ["first", "all", "T", 1])
def test_small_and_large_books_give_the_same_rows(spark, monkeypatch, sheets):
    files = _files(spark)
    small = XL.decode_workbooks(files, sheets)
    assert "Join" not in _plan(small) and "Aggregate" not in _plan(small)
    got = sorted(map(repr, small.collect()))
    whole = P.part_batches.__globals__
    monkeypatch.setitem(whole, "SMALL_BYTES", -1)
    parts = [b for b in P.part_batches(((r.path, lambda r=r: __import__("io").BytesIO(bytes(r.content or b"")), None)
                                        for r in files.collect()), sheets, True, True)]
    rows = [r for b in parts for r in b.to_pylist()]
    assert not any(r["book"] for r in rows)
    large = XL.decode_parts(spark.createDataFrame([tuple(r[k] for k in P._ARROW.names) for r in rows], P.PART_SCHEMA))
    assert sorted(map(repr, large.collect())) == got


def test_tables_of_small_books_need_no_join(spark):
    t = XL.decode_tables(_files(spark))
    assert "Join" not in _plan(t)
    errors = {r.file: r.error for r in t.where("row_index is null").collect()}
    assert errors["good.xlsx"] is None and errors["bare.xlsx"] is None and errors["cut.xlsx"] and errors["none.xlsx"]
    assert errors["twice.xlsx"] == "DecodeError: duplicate column names in header" and errors["empty.xlsx"] == "DecodeError: sheet is empty"
    assert [r["values"] for r in t.where("file = 'bare.xlsx' and row_index > 0").orderBy("row_index").collect()] == [["1", "2", "3"], ["4", "", "6"]]
    assert {r.file: r.error for r in XL.decode_status(_files(spark)).collect()} == errors
