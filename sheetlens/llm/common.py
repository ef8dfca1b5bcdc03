"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sheetlens.scratch import clean_scratch, drop, written  # noqa: F401 - for the operators

def bytes_of(column: pa.Array | pa.ChunkedArray) -> Iterator[memoryview | None]:
    """The UTF-8 bytes of each row of an Arrow string column, without a copy."""
    for chunk in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]):
        if pa.types.is_string(chunk.type):
            chunk = chunk.cast(pa.large_string())
        _, offs, data = chunk.buffers()
        off = np.frombuffer(offs, np.int64)[chunk.offset:chunk.offset + len(chunk) + 1].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        valid = chunk.is_valid().to_pylist()
        for i, ok in enumerate(valid):
            yield view[off[i]:off[i + 1]] if ok else None


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows, so that what a task builds per batch stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def own_names(df: DataFrame, names: list[str]) -> dict[str, str]:
    """For each name one that no column of ``df`` has (extra columns may clash)."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for n in names:
        new = n
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out[n] = new
    return out


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of these names renamed, so that an operator does not replace them, and the function
    that gives a result ``df``'s columns again."""
    clash = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    new = {c: own_names(df, [f"_own_{c}"])[f"_own_{c}"] for c in clash}
    back = [F.col(f"`{new.get(c, c)}`").alias(c) for c in df.columns]
    return df.withColumnsRenamed(new), lambda out: out.select(*back)


def ordered_prefix(df: DataFrame, by: list[str], order: list[Column], value: str, out: str,
                   spread: Column, per_bucket: int = 100_000) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``by`` group
    that come earlier in the order (``spread``'s bucket, then ``order``).

    ``spread`` is a hash (any long); a group is cut into as many ranges of it as
    it needs for about ``per_bucket`` rows each, so a hot group is dealt over many
    tasks: sums per range first (map-side combined), then a window inside a range.
    ``df`` must be cheap and stable to read twice (a written table)."""
    n = own_names(df, ["_cut", "_n", "_before", "_sum"])
    cut, cnt, before, tot = n["_cut"], n["_n"], n["_before"], n["_sum"]
    k = [F.col(c) for c in by]
    same = [c for c in by]
    sizes = df.groupBy(*same).agg(F.count(F.lit(1)).alias(cnt))
    if not by:
        cuts = max(1, -(-df.count() // per_bucket))
        d = df.withColumn(cut, F.pmod(F.shiftrightunsigned(spread, 16), F.lit(cuts)))
    else:
        d = _join_null_safe(df, sizes, same).withColumn(
            cut, F.pmod(F.shiftrightunsigned(spread, 16), F.ceil(F.col(cnt) / F.lit(per_bucket)))).drop(cnt)
    sums = d.groupBy(*same, cut).agg(F.sum(value).alias(tot))
    w = Window.partitionBy(*k).orderBy(cut) if by else Window.orderBy(cut)
    sums = sums.withColumn(before, F.coalesce(
        F.sum(tot).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(tot)
    inside = Window.partitionBy(*k, cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = _join_null_safe(d, sums, [*same, cut])
    return (d.withColumn(out, F.col(before) + F.coalesce(F.sum(value).over(inside), F.lit(0)))
             .drop(cut, before))


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names where null equals null; keeps the left's columns once."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(r[f"__r_{c}"])
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in on])


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null or blank text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_arrays(df: DataFrame, inputs: list[str], fn: Callable, added: str, rows: int = 512) -> DataFrame:
    """``df`` with the columns ``added`` (DDL): ``make = fn()`` is called once a task, and
    ``make(*lists)`` gives, for the values of ``inputs`` in at most ``rows`` rows at a time, one
    list for each new column.  Like a pandas UDF, but what a task holds at once is bounded by
    ``rows`` and not by the session's batch size."""
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*df.schema.fields, *new.fields])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    at = [df.columns.index(c) for c in inputs]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fn()
        for b in slices(batches, rows):
            out = make(*(b.column(k).to_pylist() for k in at))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(o, k) for o, k in zip(out, kinds))],
                                             names=[f.name for f in schema.fields])

    return df.mapInArrow(scan, schema)
