"""Row numbering that never puts a whole hot group into one task.

A window without ``partitionBy`` sends the whole table to one task, and one with
it sends every row of a key to one task.  Here the table is range-partitioned on
the full sort key and *written once* with every row's position in its partition;
the per-partition counts (one row per partition, a proven size bound) and the
rows are both read from that table, so the numbers are right whatever the
optimizer reuses, prunes or recomputes.  The sort key ends with every remaining
input column (maps and other unorderable types through a hash), so the order is
total and the numbers are the same in every run.

Numbers within groups come from an ordinary window (one shuffle) except in
groups of more than ``HOT`` rows, which are numbered by the range form.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetlens.scratch import written

HOT = 1_000_000  # rows of a group above which it is dealt over tasks
_POS_BITS = 33  # monotonically_increasing_id = partition id << 33 | position


def _orderable(dt: T.DataType) -> bool:
    if isinstance(dt, (T.MapType, T.VariantType)):
        return False
    if isinstance(dt, T.ArrayType):
        return _orderable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(_orderable(f.dataType) for f in dt.fields)
    return True


def _total_order(df: DataFrame, order: Sequence[str | Column]) -> list[Column]:
    named = {c for c in order if isinstance(c, str)}
    rest = [f for f in df.schema.fields if f.name not in named]
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    keys += [F.col(f"`{f.name}`") for f in rest if _orderable(f.dataType)]
    unorderable = [F.col(f"`{f.name}`") for f in rest if not _orderable(f.dataType)]
    if unorderable:
        keys.append(F.xxhash64(*[F.to_json(c) for c in unorderable]))
    return keys


def explicit_partitions(df: DataFrame) -> int:
    """Partition count for a shuffle with an explicit count (CPU work per row, so
    AQE must not coalesce it): the session's shuffle partitions, at least the
    cluster's cores.  Size it for the job with ``spark.sql.shuffle.partitions``."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def global_row_number(df: DataFrame, order: Sequence[str | Column], name: str = "row_number",
                      partitions: int | None = None) -> DataFrame:
    """1-based row number over the whole table in ``order`` (remaining columns
    break ties)."""
    keys = _total_order(df, order)
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    s = written(ranged.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    s = (s.withColumn("_pid", F.shiftright("_mid", _POS_BITS))
          .withColumn("_pos", F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1)))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: a single-partition window here is bounded by the partition count
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_off")
    return (s.join(F.broadcast(offsets), "_pid")
             .withColumn(name, F.col("_off") + F.col("_pos") + 1)
             .drop("_mid", "_pid", "_pos", "_off"))


def row_number_within(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "rn",
                      count_name: str | None = None, partitions: int | None = None, hot: int | None = HOT) -> DataFrame:
    """1-based row number inside each ``by`` group in ``order`` (and, when
    ``count_name`` is given, the group size).  NULL keys form a group.  ``hot=None``: the groups are bounded
    and not counted first."""
    by = list(by)
    if hot is None:
        return _windowed(df, by, order, name, count_name)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > hot)
    if not sizes.limit(1).count():
        return _windowed(df, by, order, name, count_name)
    sizes = written(sizes, "hot-groups").select(*[F.col(c).alias(f"_hot_{c}") for c in by], "_size")
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in by])
    g = global_row_number(df.join(sizes.drop("_size"), match, "left_semi"), [*by, *order], "_g", partitions)
    starts = g.groupBy(*[F.col(c).alias(f"_hot_{c}") for c in by]).agg(
        F.min("_g").alias("_g0"), *([F.count(F.lit(1)).alias(count_name)] if count_name else []))
    big = (g.join(starts, match).withColumn(name, F.col("_g") - F.col("_g0") + 1)
            .drop("_g", "_g0", *[f"_hot_{c}" for c in by]))
    small = _windowed(df.join(sizes.drop("_size"), match, "left_anti"), by, order, name, count_name)
    return small.unionByName(big)


def _windowed(df: DataFrame, by: list[str], order: Sequence[str | Column], name: str,
              count_name: str | None) -> DataFrame:
    w = Window.partitionBy(*by)
    keys = _total_order(df, [*by, *order])[len(by):]
    out = df.withColumn(name, F.row_number().over(w.orderBy(*keys)).cast("bigint"))
    return out.withColumn(count_name, F.count(F.lit(1)).over(w)) if count_name else out
