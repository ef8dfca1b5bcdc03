"""Workbook folders are written, read and deleted one after the other."""

import datetime as dt
import os

from sheetlens.plans import queries as Q
from sheetlens.plans import workbooks as W
from sheetlens.session import ensure_checkpoint_dir
from sheetlens.sources.manifest import list_files
from sheetlens.sources.workbook_source import read_listing

ORDERS = 23


def lineitems(spark, folder):
    rows = [(o, 10 + n, 3, n, 1.0, 2.0, 0.0, 0.0, "R", "O", dt.datetime(2024, 1, 1)) for o in range(1, ORDERS + 1) for n in range(1, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
                          ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def folders(spark):
    return {f for f in os.listdir(ensure_checkpoint_dir(spark)) if f.startswith("workbooks-")}


def test_every_workbook_is_found_over_several_folders(spark, tmp_path, monkeypatch):
    sf = lineitems(spark, tmp_path)
    before, seen = folders(spark), []
    monkeypatch.setattr(W, "WAVE_ROWS", 20)
    delete = W.delete_folder

    def counted(spark, path):
        assert len(folders(spark) - before) == 1
        seen.append(len([f for f in os.listdir(path) if f.endswith(".xlsx")]))
        delete(spark, path)
    monkeypatch.setattr(W, "delete_folder", counted)
    names = sorted(f"order_{o}.xlsx" for o in range(1, ORDERS + 1))
    assert Q.pending_files(spark, sf).first()["pending"] == ORDERS
    assert len(seen) == 3 and sum(seen) == ORDERS and max(seen) < ORDERS
    listed = [tuple(r) for r in Q.xlsx_listing(spark, sf).collect()]
    assert listed == [(n, True) for n in names]
    sheets = sorted(tuple(r) for r in Q.xlsx_manifest(spark, sf).collect())
    assert sheets == sorted([(n, 0, f"O{n[6:-5]}") for n in names] + [(n, 1, "Lines") for n in names])
    assert folders(spark) == before


def test_listing_is_that_of_spark(spark, tmp_path):
    """One listing of the folder instead of a task for each 32 files, with the same rows."""
    for i in range(70):
        (tmp_path / f"b {i}%.{'xlsx' if i % 2 else 'XLSX'}").write_bytes(b"x" * i)
    for other in ("n.txt", "_h.xlsx", ".h.xlsx"):
        (tmp_path / other).write_bytes(b"x")
    got = list_files(spark, str(tmp_path))
    want = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(str(tmp_path))
    assert got.collect() == want.selectExpr("path as file", "length", "modificationTime").orderBy("file").collect()
    assert read_listing(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    (tmp_path / "k=1").mkdir()
    assert "BatchScan" not in list_files(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_rows_of_workbooks_on_disk_leave_no_workbooks(spark, tmp_path, monkeypatch):
    """xlsx_rows stores the rows of a folder's workbooks and deletes it before the next one is written."""
    sf = lineitems(spark, tmp_path)
    before, seen = folders(spark), []
    monkeypatch.setattr(W, "WAVE_ROWS", 20)
    monkeypatch.setattr(W, "delete_folder", lambda spark, path, _d=W.delete_folder: seen.append(len(folders(spark) - before)) or _d(spark, path))
    rows = Q.xlsx_rows(spark, sf)
    assert seen == [1, 1, 1] and folders(spark) == before
    assert rows.groupBy("file").count().where("count = 7").count() == ORDERS
