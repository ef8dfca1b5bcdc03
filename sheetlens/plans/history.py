"""Run-history and log inputs derived from the given tables.

Ledger: every order is one batch run of processor ``o_orderpriority``; its
line items are the run's files and the returned ones (``l_returnflag = 'R'``)
the failed files, so the counters come from a real aggregate over
``lineitem`` (partial aggregation before the join on the order key).
Logs: every event is one log line; the level follows the event type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.operators.ledger import LEDGER_COLUMNS, result_struct
from sheetlens.operators.logs import format_line
from sheetlens.plans.tables import table

LEDGER_SQL = """
SELECT o_orderkey AS seq, 'run-' || CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS ts,
       o_orderpriority AS processor_id, o_orderstatus AS processor_name,
       'in/c' || CAST(o_custkey AS VARCHAR) AS input_dir, 'out/c' || CAST(o_custkey AS VARCHAR) AS output_dir,
       coalesce(l.total_files, 0) AS total_files, coalesce(l.total_files - l.failed, 0) AS successful,
       coalesce(l.failed, 0) AS failed
FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS total_files,
                              COUNT(*) FILTER (WHERE l_returnflag = 'R') AS failed
                       FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey"""


def with_ledger(select_sql: str) -> str:
    return f"WITH led AS ({LEDGER_SQL}) {select_sql}"


def ledger_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    li = (table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag")
          .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("total_files"),
                                     F.count_if(F.col("l_returnflag") == "R").alias("failed")))
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")
    total, bad = F.coalesce(F.col("total_files"), F.lit(0)), F.coalesce(F.col("failed"), F.lit(0))
    return j.select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderpriority").alias("processor_id"),
        F.col("o_orderstatus").alias("processor_name"),
        F.concat(F.lit("in/c"), F.col("o_custkey").cast("string")).alias("input_dir"),
        F.concat(F.lit("out/c"), F.col("o_custkey").cast("string")).alias("output_dir"),
        result_struct(total, total - bad, bad).alias("result"),
        F.lit(None).cast("string").alias("status_path")).select(*LEDGER_COLUMNS)


LEVEL_SQL = ("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' "
             "ELSE 'INFO' END")
MESSAGE_SQL = "event_type || ' [user ' || CAST(user_id AS VARCHAR) || '] ' || coalesce(props, '')"
LINES_SQL = (f"SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || {LEVEL_SQL} || '] ' || "
             f"{MESSAGE_SQL} AS value FROM events")


def with_lines(select_sql: str) -> str:
    return f"WITH lines AS ({LINES_SQL}) {select_sql}"


def log_lines_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): the events as log lines in the file format."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    et = F.col("event_type")
    level = (F.when(et == "error", "ERROR").when(et == "signup", "WARN").when(et == "view", "DEBUG")
             .otherwise("INFO"))
    msg = F.concat(et, F.lit(" [user "), F.col("user_id").cast("string"), F.lit("] "),
                   F.coalesce(F.col("props"), F.lit("")))
    return e.select("event_id", format_line(F.col("ts"), level, msg).alias("value"))
