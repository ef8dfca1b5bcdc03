"""Run-history (ledger) table: one row per batch run.

Schema ``model.LEDGER_SCHEMA``: ``seq`` (insertion order), ``id`` (uuid),
``timestamp`` (UTC), processor id / name, input / output folder and the run
``result`` struct (total_files, successful, failed, errors, duration) and
``status_path``, the run's per-file status table.  Entries recorded here keep
failed files in that table (distributed) and leave ``errors`` empty; the
array is filled only by imported histories that carry it inline.

The ledger is an ordinary table (parquet in a folder); every operation is a
DataFrame transformation; recency is a bounded top-k and retention a selection,
never a single-partition window.  :mod:`sheetlens.operators.ledger_table` keeps it
in a folder that several jobs append to.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetlens.model import LEDGER_SCHEMA
from sheetlens.operators.numbering import global_row_number

LEDGER_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]


def result_struct(total_files: Column, successful: Column, failed: Column,
                  errors: Column | None = None, duration: Column | None = None) -> Column:
    """The run ``result`` struct from counter columns."""
    err_t = "array<struct<file:string,error_message:string>>"
    return F.struct(total_files.cast("bigint").alias("total_files"), successful.cast("bigint").alias("successful"),
                    failed.cast("bigint").alias("failed"),
                    (errors if errors is not None else F.array().cast(err_t)).cast(err_t).alias("errors"),
                    (duration if duration is not None else F.lit(0)).cast("bigint").alias("duration"))


def new_entries(stats: DataFrame, processor_id: str, processor_name: str, input_dir: str,
                output_dir: str, status_path: str | None = None) -> DataFrame:
    """History entries for run statistics rows (``BatchRun.stats()``): a new
    uuid and the current UTC time each; ``seq`` is assigned on append."""
    return stats.select(
        F.lit(None).cast("bigint").alias("seq"), F.expr("uuid()").alias("id"),
        F.current_timestamp().alias("timestamp"), F.lit(processor_id).alias("processor_id"),
        F.lit(processor_name).alias("processor_name"), F.lit(input_dir).alias("input_dir"),
        F.lit(output_dir).alias("output_dir"),
        result_struct(F.col("total_files"), F.col("successful"), F.col("failed"),
                      duration=F.col("duration")).alias("result"),
        F.lit(status_path).cast("string").alias("status_path"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def append(ledger: DataFrame, entries: DataFrame, max_entries: int | None = None,
           order: Sequence[str | Column] = ("timestamp",)) -> DataFrame:
    """``ledger`` + ``entries`` with ``seq`` continuing after the ledger's
    largest (entries numbered in ``order``, equal ones as they come), then
    retention to the newest ``max_entries``.  Only the ledger's max(seq)
    reaches the driver."""
    base = ledger.agg(F.max("seq")).first()[0] or 0    # one scalar to the driver
    entries = entries.drop("seq").withColumn("_in", F.monotonically_increasing_id())
    numbered = global_row_number(entries, [*order, "_in"], "_k")
    added = numbered.withColumn("seq", F.lit(base) + F.col("_k")).select(*LEDGER_COLUMNS)
    out = ledger.select(*LEDGER_COLUMNS).unionByName(added)
    return trim(out, max_entries) if max_entries is not None else out


def all_entries(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy("seq")


def recent(ledger: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recent entries, newest first (top-k: ``n`` rows reach one task)."""
    return ledger.orderBy(F.col("seq").desc()).limit(n)


_BUCKETS = 1024  # counts of a round of the selection: what a round sends to the driver


def newest_threshold(ledger: DataFrame, n: int) -> tuple[int, int] | None:
    """(t, k): the newest ``n`` entries are those with ``seq`` over t and k of those with ``seq`` t; None if there
    are no more than ``n``.  Rounds of counts in equal ranges of ``seq`` narrow down the range that holds t, so
    nothing is sorted and only ``seq`` is read."""
    seqs = ledger.select("seq").where("seq is not null")
    low, high, total = seqs.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
    if total <= n:
        return None
    above = 0  # entries over ``high``
    while high > low:
        step = (high - low) // _BUCKETS + 1
        inside = seqs.where(F.col("seq").between(low, high))
        counts = dict(inside.groupBy(F.floor((F.col("seq") - low) / step).alias("b")).agg(F.count(F.lit(1))).collect())
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= n:
                break
            above += counts[b]
        low, high = low + b * step, min(high, low + (b + 1) * step - 1)
    return low, n - above


def trim(ledger: DataFrame, n: int) -> DataFrame:
    """Keep the newest ``n`` entries by insertion order.  A selection finds the least ``seq`` that stays and a filter
    applies it: no sort, however large ``n``.  Only entries that share that very ``seq`` (there are several after two
    unguarded appends) are ranked, by their other columns.  An entry without ``seq`` is older than all others."""
    if n <= 0:
        return ledger.limit(0)
    found = newest_threshold(ledger, n)
    if found is None:
        if ledger.where("seq is null").isEmpty():
            return ledger
        ranked = global_row_number(ledger, [F.col("seq").desc()], "_rank")
        return ranked.where(F.col("_rank") <= n).drop("_rank")
    t, k = found
    if ledger.where(F.col("seq") == t).count() <= k:
        return ledger.where(F.col("seq") >= t)
    tied = global_row_number(ledger.where(F.col("seq") == t), ["seq"], "_rank")
    return ledger.where(F.col("seq") > t).unionByName(tied.where(F.col("_rank") <= k).drop("_rank"))


def by_id(ledger: DataFrame, entry_id: str) -> DataFrame:
    return ledger.where(F.col("id") == F.lit(entry_id))


def by_processor(ledger: DataFrame, processor_id: str) -> DataFrame:
    return ledger.where(F.col("processor_id") == F.lit(processor_id))


def is_successful(result: Column | None = None) -> Column:
    result = F.col("result") if result is None else result
    return result["failed"] == 0


def successful(ledger: DataFrame) -> DataFrame:
    return ledger.where(is_successful())


def failed(ledger: DataFrame) -> DataFrame:
    return ledger.where(~is_successful())


def remove(ledger: DataFrame, entry_id: str) -> DataFrame:
    """Drop the entry ``entry_id``; an unknown id is an error (one count)."""
    if ledger.where(F.col("id") == F.lit(entry_id)).limit(1).count() == 0:
        raise KeyError(f"history entry {entry_id!r} not found")
    return ledger.where(F.col("id") != F.lit(entry_id))


def success_rate_pct(result: Column | None = None, dtype: str = "float") -> Column:
    """successful / total x 100 (FLOAT like the reference, or ``dtype``), 0
    when there were no files."""
    result = F.col("result") if result is None else result
    return F.when(result["total_files"] > 0,
                  result["successful"].cast("double") / result["total_files"] * 100).otherwise(0.0).cast(dtype)


def progress(processed: Column, total: Column) -> tuple[Column, Column]:
    """(percent FLOAT, complete BOOLEAN) of a run's progress."""
    pct = F.when(total > 0, processed.cast("double") / total * 100).otherwise(0.0).cast("float")
    return pct, processed >= total


def import_entries(ledger: DataFrame, imported: DataFrame, ordinal: str = "ordinal",
                   max_entries: int | None = None) -> DataFrame:
    """Merge imported entries (``ordinal`` = position in the imported file): an
    id already in the ledger keeps the ledger's entry; among imported
    duplicates the first (lowest ordinal) wins.  All entries are then put in
    order of time (entries of the ledger before imported ones of the same
    time, each in their own order), numbered anew and trimmed to the newest
    ``max_entries``."""
    cols = [c for c in LEDGER_COLUMNS if c not in ("id", "seq")] + [ordinal]
    first = (imported.groupBy("id").agg(F.min_by(F.struct(*cols), F.col(ordinal)).alias("_e"))
             .select("id", "_e.*"))
    new = first.join(ledger.select("id"), "id", "left_anti")
    both = (ledger.select(*LEDGER_COLUMNS, F.lit(0).alias("_origin"), F.col("seq").alias("_place"))
            .unionByName(new.select(F.lit(None).cast("bigint").alias("seq"), *[c for c in LEDGER_COLUMNS if c != "seq"],
                                    F.lit(1).alias("_origin"), F.col(ordinal).cast("bigint").alias("_place"))))
    numbered = global_row_number(both, ["timestamp", "_origin", "_place", "id"], "_k")
    out = numbered.withColumn("seq", F.col("_k")).select(*LEDGER_COLUMNS)
    return trim(out, max_entries) if max_entries is not None else out


# ------------------------------------------------------------------ storage

def save(ledger: DataFrame, path: str, mode: str = "append") -> None:
    ledger.select(*LEDGER_COLUMNS).write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    empty(spark).write.mode("overwrite").parquet(path)


def export_json(ledger: DataFrame, path: str) -> None:
    """JSON Lines, one entry per line, in seq order within each file."""
    ledger.select(*LEDGER_COLUMNS).sortWithinPartitions("seq").write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, on_corrupt: str = "fail") -> DataFrame:
    """Read exported entries: JSON Lines, or one JSON array a file.  Damage
    anywhere in the files makes the history unreadable: an error, or an empty
    ledger with ``on_corrupt='empty'`` (the whole input is parsed to know).

    A file whose first character that is not white space is ``[`` is an array."""
    array = F.first(F.when(F.trim("value") != "", F.ltrim("value").startswith("["))  # lines of a file come in order
                    , ignorenulls=True)
    heads = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"))
    arrays = heads.groupBy("f").agg(array.alias("a")).where("a").limit(1).count() > 0
    schema = T.StructType([*LEDGER_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    df = (spark.read.schema(schema).option("multiLine", arrays).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_broken").json(path))
    bad = df.select("_broken", "id").where(F.col("_broken").isNotNull() | F.col("id").isNull()).limit(1).count()
    if not bad:
        return df.drop("_broken")
    if on_corrupt == "empty":
        return empty(spark)
    raise ValueError(f"unreadable history in {path}")
