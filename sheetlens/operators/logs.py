"""Application log lines as a table.

Line format ``[YYYY-MM-DD HH:MM:SS] [LEVEL] message`` with LEVEL one of
DEBUG / INFO / WARN / ERROR, one file per day named ``app_YYYYMMDD.log``.
Logs are read with ``spark.read.text`` (or ``readStream.text``), parsed with
``regexp_extract`` (JVM-side), filtered by exact level, cut to the newest N
lines with a bounded top-k and rendered back to text per row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.model import LOG_LEVELS
from sheetlens.operators.numbering import explicit_partitions

# The log line's timestamp format, the daily file pattern and
# the number of newest lines kept by the in-memory log.
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
LINE_RE = (r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] \[(" + "|".join(LOG_LEVELS) + r")\] (.*)$")
FILE_GLOB = "app_*.log"
MAX_KEPT = 1000


def format_line(ts: Column, level: Column, message: Column) -> Column:
    """The file form of one entry."""
    return F.concat(F.lit("["), F.date_format(ts, TS_FORMAT), F.lit("] ["), level, F.lit("] "), message)


def log_file_name(ts: Column) -> Column:
    """``app_YYYYMMDD.log`` of the entry's day."""
    return F.concat(F.lit("app_"), F.date_format(ts, "yyyyMMdd"), F.lit(".log"))


def parse_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Add ``ts`` (TIMESTAMP_NTZ, wall clock as written), ``level``,
    ``message`` and ``parsed`` (false for a line not in the format; its
    fields are NULL)."""
    v = F.col(col)
    ok = v.rlike(LINE_RE)
    ts_text = F.regexp_extract(v, LINE_RE, 1)
    return (lines.withColumn("parsed", ok)
            .withColumn("ts", F.when(ok, F.try_to_timestamp(ts_text, F.lit(TS_FORMAT)).cast("timestamp_ntz")))
            .withColumn("level", F.when(ok, F.regexp_extract(v, LINE_RE, 2)))
            .withColumn("message", F.when(ok, F.regexp_extract(v, LINE_RE, 3))))


def read_logs(spark: SparkSession, directory: str, glob: str = FILE_GLOB) -> DataFrame:
    """Parsed lines of every log file in ``directory`` with ``file`` and the
    line's position ``seq`` (file order, then line order) as tie-break."""
    raw = (spark.read.option("pathGlobFilter", glob).text(directory)
           .withColumn("file", F.col("_metadata.file_path"))
           .withColumn("seq", F.monotonically_increasing_id()))
    return parse_lines(raw)


def filter_level(logs: DataFrame, level: str | None = None) -> DataFrame:
    """Exact level match (not a threshold); ``None`` keeps every line."""
    if level is None:
        return logs
    if level not in LOG_LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return logs.where(F.col("level") == F.lit(level))


def last_n(logs: DataFrame, n: int = MAX_KEPT, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The newest ``n`` lines (top-k on ``order``; ``n`` rows reach one task),
    returned oldest first."""
    newest = logs.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)
    return newest.orderBy(*order)


def render(logs: DataFrame) -> DataFrame:
    """Viewer text per line: ``YYYY-MM-DD HH:MM:SS [LEVEL] message``."""
    return logs.withColumn("text", F.concat(F.date_format("ts", TS_FORMAT), F.lit(" ["), F.col("level"),
                                            F.lit("] "), F.col("message")))


def write_logs(entries: DataFrame, out_dir: str, mode: str = "append") -> None:
    """Write ``(ts, level, message)`` entries as daily log text files
    (``day=app_YYYYMMDD.log`` folders, Spark ``part-*.txt`` files inside).
    Range partitioning on time gives every task a contiguous time slice, so a
    busy day is split over several tasks and each file is in time order."""
    n = explicit_partitions(entries)
    (entries.select(log_file_name(F.col("ts")).alias("day"), F.col("ts"),
                    format_line(F.col("ts"), F.col("level"), F.col("message")).alias("value"))
     .repartitionByRange(n, "ts").sortWithinPartitions("day", "ts").drop("ts")
     .write.mode(mode).partitionBy("day").text(out_dir))
