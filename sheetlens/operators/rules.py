"""Recognition rules that compile to boolean Spark columns over ``cells``.

Every rule's column is never NULL (three-valued logic is closed with
``coalesce(..., false)``), so rules compose with AND/OR and CASE WHEN safely.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field
from typing import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetlens.functions.cells import cell_at, cells_col, column_span, first_non_empty
from sheetlens.functions.text import utrim
from sheetlens.model import WHITE
from sheetlens.operators.patterns import java_pattern, matches


@dataclass(frozen=True)
class RuleContext:
    """Where a rule finds its inputs: the cells column and, when classify has
    materialised it once, the first-non-empty-cell column."""

    cells: str = "cells"
    first_non_empty: str | None = None

    def cell(self, column_index: int | None) -> Column:
        if column_index is not None:
            return cell_at(column_index, self.cells)
        if self.first_non_empty:
            return F.col(self.first_non_empty)
        return first_non_empty(self.cells)

    def cells_col(self) -> Column:
        return cells_col(self.cells)


DEFAULT_CONTEXT = RuleContext()


class Rule:
    """Base rule: a name, a static confidence and a boolean column."""

    name: str

    def to_column(self, ctx: RuleContext = DEFAULT_CONTEXT) -> Column:
        raise NotImplementedError

    def confidence(self) -> float:
        return 1.0

    def children(self) -> Sequence["Rule"]:
        return ()


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def color_hex(color: str | tuple[int, int, int]) -> str:
    if isinstance(color, tuple):
        r, g, b = color
        return f"{r:02X}{g:02X}{b:02X}"
    s = color.lstrip("#").upper()
    if len(s) == 8:
        s = s[2:]
    if not re.fullmatch(r"[0-9A-F]{6}", s):
        raise ValueError(f"not an RGB colour: {color!r}")
    return s


@dataclass
class ColorRule(Rule):
    """Background colour of column ``column_index`` (or of the first non-empty
    cell when None) equals ``color`` exactly; no fill counts as white; a missing
    cell never matches."""

    name: str
    color: str | tuple[int, int, int]
    column_index: int | None = None

    def to_column(self, ctx: RuleContext = DEFAULT_CONTEXT) -> Column:
        cell = ctx.cell(self.column_index)
        bg = F.coalesce(cell["style"]["background_color"], F.lit(WHITE))
        return _false_if_null(cell.isNotNull() & (bg == F.lit(color_hex(self.color))))


@dataclass(frozen=True)
class Exact:
    text: str


@dataclass(frozen=True)
class Contains:
    text: str


@dataclass(frozen=True)
class Regex:
    pattern: str


@dataclass
class TextRule(Rule):
    """Text of column ``column_index``, trimmed, against an Exact / Contains /
    Regex pattern.  The pattern itself is not trimmed.  Case-insensitive mode
    lower-cases both sides (regex: ``(?i)``).  A regex takes no exponential time
    (:func:`sheetlens.operators.patterns.matches`)."""

    name: str
    column_index: int
    pattern: Exact | Contains | Regex
    case_sensitive: bool = True

    def to_column(self, ctx: RuleContext = DEFAULT_CONTEXT) -> Column:
        content = utrim(ctx.cell(self.column_index)["content"])
        p = self.pattern
        if isinstance(p, Regex):
            java = java_pattern(p.pattern, self.case_sensitive)
            if java is None:
                warnings.warn(f"invalid regex {p.pattern!r} in rule {self.name!r}: never matches")
                return F.lit(False)
            return _false_if_null(matches(content, java))
        target = F.lit(p.text)
        if not self.case_sensitive:
            content, target = F.lower(content), F.lower(target)
        if isinstance(p, Exact):
            return _false_if_null(content == target)
        return _false_if_null(content.contains(target))


@dataclass(frozen=True)
class MergedAcross:
    start_col: int
    end_col: int


@dataclass(frozen=True)
class MergedMinColumns:
    n: int


@dataclass(frozen=True)
class NotMerged:
    pass


@dataclass
class MergeRule(Rule):
    """Merge state of the row's cells."""

    name: str
    requirement: MergedAcross | MergedMinColumns | NotMerged

    def to_column(self, ctx: RuleContext = DEFAULT_CONTEXT) -> Column:
        cells = ctx.cells_col()
        req = self.requirement
        if isinstance(req, MergedAcross):
            return _false_if_null(F.exists(cells, lambda c: (c["merge_info"]["start_col"] == req.start_col)
                                            & (c["merge_info"]["end_col"] == req.end_col)))
        if isinstance(req, MergedMinColumns):
            return _false_if_null(F.exists(cells, lambda c: column_span(c["merge_info"]) >= req.n))
        return _false_if_null(F.forall(cells, lambda c: c["merge_info"].isNull()))


@dataclass
class CompositeRule(Rule):
    """AND / OR of child rules (nestable).  Empty AND is true, empty OR false.
    Confidence: AND = mean of children, OR = max of all children, none = 0."""

    name: str
    rules: list[Rule] = field(default_factory=list)
    logic: str = "and"

    def __post_init__(self):
        if self.logic not in ("and", "or"):
            raise ValueError("logic must be 'and' or 'or'")

    def children(self) -> Sequence[Rule]:
        return self.rules

    def to_column(self, ctx: RuleContext = DEFAULT_CONTEXT) -> Column:
        if self.logic == "and":
            out = F.lit(True)
            for r in self.rules:
                out = out & r.to_column(ctx)
        else:
            out = F.lit(False)
            for r in self.rules:
                out = out | r.to_column(ctx)
        return out

    def confidence(self) -> float:
        if not self.rules:
            return 0.0
        cs = [r.confidence() for r in self.rules]
        return sum(cs) / len(cs) if self.logic == "and" else max(cs)


def And(name: str, *rules: Rule) -> CompositeRule:  # noqa: N802
    return CompositeRule(name, list(rules), "and")


def Or(name: str, *rules: Rule) -> CompositeRule:  # noqa: N802
    return CompositeRule(name, list(rules), "or")


@dataclass
class ExprRule(Rule):
    """User rule from any Column-building function of the rule context."""

    name: str
    fn: Callable[[RuleContext], Column]
    conf: float = 1.0

    def to_column(self, ctx: RuleContext = DEFAULT_CONTEXT) -> Column:
        return _false_if_null(self.fn(ctx))

    def confidence(self) -> float:
        return self.conf


@dataclass
class PythonRule(Rule):
    """User rule in plain Python, for logic the Column rules cannot express:
    ``fn(contents, backgrounds, merges) -> bool`` per row, where ``merges`` is
    a list of ``(start_col, end_col)`` or None per cell.  Evaluated by a
    pandas UDF (Arrow batches of rows); the slow path, so prefer the Column
    rules or :class:`ExprRule` when they fit."""

    name: str
    fn: Callable[[list, list, list], bool]
    conf: float = 1.0

    def to_column(self, ctx: RuleContext = DEFAULT_CONTEXT) -> Column:
        from pyspark.sql.functions import pandas_udf

        fn = self.fn

        @pandas_udf("boolean")
        def evaluate(contents: pd.Series, bgs: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
            out = []
            for c, b, s, e in zip(contents, bgs, starts, ends):
                merges = [None if a is None or pd.isna(a) else (int(a), int(z)) for a, z in zip(s, e)]
                out.append(bool(fn(list(c), list(b), merges)))
            return pd.Series(out, dtype=bool)

        cells = ctx.cells_col()
        return _false_if_null(evaluate(
            F.transform(cells, lambda c: c["content"]), F.transform(cells, lambda c: c["style"]["background_color"]),
            F.transform(cells, lambda c: c["merge_info"]["start_col"]),
            F.transform(cells, lambda c: c["merge_info"]["end_col"])))

    def confidence(self) -> float:
        return self.conf


class CellBatch:
    """The cells of a batch of rows end to end: flat Arrow arrays ``contents``, ``backgrounds`` (strings),
    ``starts`` and ``ends`` (columns of the cell's merge, null without one); the cells of row i are those from
    ``offsets[i]`` up to ``offsets[i + 1]``."""

    def __init__(self, contents: pa.Array, backgrounds: pa.Array, starts: pa.Array, ends: pa.Array):
        sizes = contents.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.contents, self.backgrounds, self.starts, self.ends = (
            a.flatten() for a in (contents, backgrounds, starts, ends))

    def count(self, flags: pa.Array | np.ndarray) -> np.ndarray:
        """For each row how many of its cells are flagged; a null flag counts as none."""
        if isinstance(flags, (pa.Array, pa.ChunkedArray)):
            flags = flags.fill_null(False).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def at(self, column: int, flags: pa.Array | np.ndarray) -> np.ndarray:
        """For each row whether the cell in this place is there and flagged."""
        place = self.offsets[:-1] + column
        there = place < self.offsets[1:]
        out = np.zeros(len(place), dtype=bool)
        if isinstance(flags, (pa.Array, pa.ChunkedArray)):
            flags = flags.fill_null(False).to_numpy(zero_copy_only=False)
        out[there] = flags[place[there]]
        return out


@dataclass
class ArrowRule(Rule):
    """User rule over whole batches: ``fn(cells) -> booleans``, one for each row, gets a :class:`CellBatch` and
    is called once a batch, so rows and cells are not looped over in Python.  For logic that the Column rules
    cannot express."""

    name: str
    fn: Callable[[CellBatch], pa.Array | np.ndarray]
    conf: float = 1.0

    def to_column(self, ctx: RuleContext = DEFAULT_CONTEXT) -> Column:
        from pyspark.sql.functions import arrow_udf

        fn, name = self.fn, self.name

        @arrow_udf("boolean")
        def evaluate(contents: pa.Array, bgs: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
            out = fn(CellBatch(contents, bgs, starts, ends))
            if len(out) != len(contents):
                raise ValueError(f"rule {name!r} gave {len(out)} values for {len(contents)} rows")
            return out if isinstance(out, pa.Array) else pa.array(out, pa.bool_())

        cells = F.coalesce(ctx.cells_col(), F.array())
        return _false_if_null(evaluate(
            F.transform(cells, lambda c: c["content"]), F.transform(cells, lambda c: c["style"]["background_color"]),
            F.transform(cells, lambda c: c["merge_info"]["start_col"]),
            F.transform(cells, lambda c: c["merge_info"]["end_col"])))

    def confidence(self) -> float:
        return self.conf
