"""Workbook files derived from the given tables (for the source round trips).

The order-sheet grid is written as one workbook per order by a sorted
per-partition stream (``mapInArrow``): sheet 0 ``O<order>`` is the styled grid (fills, merges,
shared / rich / inline strings and numbers), sheet 1 ``Lines`` a plain table
(header + one row per line item, numbers and booleans).  A sheet is capped by
the format at 1,048,576 rows, so groups are (order, chunk of 1,000,000 rows):
no group grows with the data beyond that.  With ``corrupt_every=k`` the
bytes of every k-th order's workbook are truncated (fault injection: the batch
jobs must isolate those files; every row is still encoded).
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.operators.numbering import explicit_partitions
from sheetlens.plans.grid import flat_grid
from sheetlens.plans.tables import table
from sheetlens.scratch import delete_folder, scratch_folder, written
from sheetlens.sources.files import write_binary_files
from sheetlens.sources.xlsx_writer import workbook_bytes

CHUNK_ROWS = 1_000_000   # rows of one workbook's sheet: the file format holds 1,048,576
LINES_HEADER = ["line", "partkey", "returned"]


def workbook_name(sheet_id: int, chunk: int) -> str:
    return f"order_{sheet_id}.xlsx" if chunk == 0 else f"order_{sheet_id}~{chunk}.xlsx"


# Fonts of the styled workbooks by kind of row.
_FONTS = {"project": {"bold": True, "font": "FF0000FF"}, "header": {"bold": True}, "blank": {"italic": True},
          "total": {"bold": True, "italic": True, "font": "FFFF0000"}}


def _cell(text, argb, kind, fonts=False):
    d = {"v": text} | (_FONTS.get(kind, {}) if fonts else {})
    if argb is not None:
        d["fill"] = argb
    if kind == "data" and text not in (None, "") and str(text).isdigit():
        d["v"] = int(text)                        # numeric cell, decodes to the same text
    elif kind == "project" and text:
        d["t"] = "rich"
    elif kind == "blank" and text:
        d["t"] = "inline"
    return d


def _flush(key, rows, corrupt_every, fonts=False):
    sheet_id, chunk = key
    base = chunk * CHUNK_ROWS
    height = max(r[0] for r in rows) - base + 1
    grid_rows: list = [None] * height
    merges = []
    lines = [LINES_HEADER]
    for row_index, kind, c0, c1, bg0, bg1, m_start, m_end in rows:
        i = row_index - base
        grid_rows[i] = [_cell(c0, bg0, kind, fonts), _cell(c1, bg1, kind, fonts)]
        if m_start is not None:
            merges.append((i, m_start, i, m_end))
        if kind == "data":
            lines.append([int(c0), int(c1), bg0 == "FFFFFFFF"])
    content = workbook_bytes([(f"O{sheet_id}", grid_rows, merges), ("Lines", lines, [])])
    if corrupt_every and sheet_id % corrupt_every == 0:
        content = content[: len(content) // 2]
    return workbook_name(sheet_id, chunk), content


_FIELDS = ["row_index", "kind", "c0", "c1", "bg0", "bg1", "m_start", "m_end"]
_OUT = pa.schema([("path", pa.string()), ("content", pa.binary())])


def _encoder(corrupt_every: int | None, fonts: bool = False, per_batch: int = 64):
    """Rows arrive sorted by (sheet_id, chunk, row_index); one workbook is
    built at a time and written out in bounded Arrow batches."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, paths, contents = None, [], [], []
        for b in batches:
            d = b.to_pydict()
            cols = [d[f] for f in _FIELDS]
            for sid, ch, *rest in zip(d["sheet_id"], d["chunk"], *cols):
                k = (sid, ch)
                if k != key:
                    if rows:
                        path, content = _flush(key, rows, corrupt_every, fonts)
                        paths.append(path)
                        contents.append(content)
                        if len(paths) >= per_batch:
                            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()),
                                                              pa.array(contents, pa.binary())], schema=_OUT)
                            paths, contents = [], []
                    key, rows = k, []
                rows.append(rest)
        if rows:
            path, content = _flush(key, rows, corrupt_every, fonts)
            paths.append(path)
            contents.append(content)
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())],
                                             schema=_OUT)
    return encode


def grid_workbooks(spark: SparkSession, sf_dir: str, corrupt_every: int | None = None, fonts: bool = False) -> DataFrame:
    """(path, content) of the order workbooks, with ``fonts`` also in bold, italic and coloured fonts."""
    return _encoded(flat_grid(spark, sf_dir), corrupt_every, fonts)


WAVE_ROWS = 1_000_000    # line items whose workbooks are in a folder at one time


def in_folders(spark: SparkSession, sf_dir: str, found: Callable[[str], DataFrame], beside: DataFrame | None = None) -> DataFrame:
    """What ``found(folder)`` gives of all order workbooks, written to folders with the files ``beside`` and read
    there.  A workbook of a few line items takes a block of the disk, so the workbooks of at most about ``WAVE_ROWS``
    line items are there at a time: each folder's rows are stored, then it is deleted and the next one is written.  An
    order's workbooks are in one folder."""
    waves = -(-table(spark, sf_dir, "lineitem", "l_orderkey").count() // WAVE_ROWS) or 1
    flat = flat_grid(spark, sf_dir)
    wave = F.pmod(F.xxhash64("sheet_id"), F.lit(waves))
    got = []
    for k in range(waves):
        folder = scratch_folder(spark, "workbooks")
        files = _encoded(flat.where(wave == k))
        write_binary_files(files if beside is None else files.unionByName(beside), folder)
        got.append(written(found(folder), "found"))
        delete_folder(spark, folder)
    return reduce(DataFrame.unionByName, got)


def _encoded(flat: DataFrame, corrupt_every: int | None = None, fonts: bool = False) -> DataFrame:
    """The workbooks of a flat grid.

    The shuffle is keyed on (order, chunk) with an explicit partition count
    (at least the cluster's cores): the rows are small but encoding is CPU
    work, so AQE must not coalesce it into a few tasks, and a hot order's
    chunks spread over many tasks."""
    flat = flat.withColumn("chunk", F.floor(F.col("row_index") / CHUNK_ROWS).cast("bigint"))
    parts = (flat.repartition(explicit_partitions(flat), "sheet_id", "chunk")
                 .sortWithinPartitions("sheet_id", "chunk", "row_index")
                 .select("sheet_id", "chunk", *_FIELDS))
    return parts.mapInArrow(_encoder(corrupt_every, fonts), "path string, content binary")
