"""Cell access over the ``cells`` array column."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.functions.text import utrim


def cells_col(cells: Column | str = "cells") -> Column:
    return F.col(cells) if isinstance(cells, str) else cells


def held(rows: DataFrame, *columns: str) -> DataFrame:
    """The same rows with ``columns`` (else their cells) made once.  Functions over arrays are interpreted, and the optimizer moves the
    expression that makes the cells into them, where it is interpreted too and evaluated at every use (a plain
    explode of the cells evaluates it twice: for its rows and for a filter on their number).  It moves nothing past
    a generator over an array of one."""
    if len(columns) < 2:
        name = columns[0] if columns else "cells"
        return rows.withColumn(name, F.explode(F.array(F.col(f"`{name}`"))))
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*rest, F.inline(F.array(F.struct(*columns))))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), fn), 0)


def cell_at(i: int, cells: Column | str = "cells") -> Column:
    """Cell by 0-based position; NULL when the row has no such cell."""
    return F.get(cells_col(cells), F.lit(int(i)))


def is_blank(content: Column) -> Column:
    return utrim(content) == F.lit("")


def first_non_empty(cells: Column | str = "cells") -> Column:
    """First cell whose trimmed content is not empty (NULL for a blank row)."""
    return F.get(F.filter(cells_col(cells), lambda c: ~is_blank(c["content"])), 0)


def contents(cells: Column | str = "cells") -> Column:
    """Row as an array of cell contents."""
    return F.transform(cells_col(cells), lambda c: c["content"])


def column_span(merge: Column) -> Column:
    """Columns covered by a merge range (``end_col - start_col + 1``; NULL
    when the cell is not merged).  A vertical-only merge spans 1 column."""
    return merge["end_col"] - merge["start_col"] + 1


def row_span(merge: Column) -> Column:
    """Rows covered by a merge range (``end_row - start_row + 1``)."""
    return merge["end_row"] - merge["start_row"] + 1
