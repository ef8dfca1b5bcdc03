"""Incremental batch (file stream, availableNow) and the log stream."""

import os
import tempfile

from pyspark.sql import functions as F

from sheetlens.operators import logs as LG
from sheetlens.sources.xlsx_writer import workbook_bytes
from sheetlens.streaming.incremental import run_incremental_batch, run_stats
from sheetlens.streaming.logs import stream_logs

TABLE = [["a", "b"], ["1", "2"], ["3", "4"]]


def _write(d, name, content):
    with open(os.path.join(d, name), "wb") as f:
        f.write(content)


def test_second_run_sees_only_new_files(spark):
    root = tempfile.mkdtemp(prefix="sheetlens-stream-")
    in_dir, out_dir, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    os.makedirs(in_dir)
    _write(in_dir, "a.xlsx", workbook_bytes([("S", TABLE, [])]))
    _write(in_dir, "b.xlsx", b"not a zip")
    st = run_incremental_batch(spark, in_dir, out_dir, ck)
    assert st.count() == 2
    _write(in_dir, "c.xlsx", workbook_bytes([("S", TABLE, [])]))
    st = run_incremental_batch(spark, in_dir, out_dir, ck)
    per_batch = {r["batch_id"]: r["n"] for r in st.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sorted(per_batch.values()) == [1, 2]
    s = run_stats(st).first()
    assert (s["total_files"], s["successful"], s["failed"]) == (3, 2, 1)
    from sheetlens.operators.batch import read_csv_lines
    lines = read_csv_lines(spark, os.path.join(out_dir, "tables")).where(F.col("file") == "c.xlsx")
    assert sorted(r["value"] for r in lines.collect()) == ["1,2", "3,4", "a,b"]


def test_log_stream_parses_new_files(spark):
    root = tempfile.mkdtemp(prefix="sheetlens-logstream-")
    logs, ck = os.path.join(root, "logs"), os.path.join(root, "ck")
    os.makedirs(logs)
    with open(os.path.join(logs, "app_20240101.log"), "w") as f:
        f.write("[2024-01-01 10:00:00] [INFO] started\n[2024-01-01 10:00:01] [ERROR] bad, \"x\"\nnot a log line\n")
    q = (stream_logs(spark, logs).writeStream.format("memory").queryName("log_stream_test")
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.table("log_stream_test").orderBy("ts").collect()
    assert [(r["level"], r["message"], r["parsed"]) for r in rows if r["parsed"]] == [
        ("INFO", "started", True), ("ERROR", 'bad, "x"', True)]
    assert sum(1 for r in rows if not r["parsed"]) == 1


def test_log_helpers(spark):
    df = spark.createDataFrame([("[2024-01-01 10:00:00] [WARN] a",), ("[2024-01-01 10:00:02] [INFO] b",),
                                ("[2024-01-01 10:00:01] [WARN] c",)], "value string")
    p = LG.parse_lines(df).withColumn("seq", F.monotonically_increasing_id())
    assert [r["message"] for r in LG.filter_level(p, "WARN").orderBy("ts").collect()] == ["a", "c"]
    assert [r["message"] for r in LG.last_n(p, 2).collect()] == ["c", "b"]
    assert LG.render(p).orderBy("ts").first()["text"] == "2024-01-01 10:00:00 [WARN] a"


def test_binary_sink_accepts_file_uris(spark):
    from sheetlens.sources.files import write_binary_files

    d = tempfile.mkdtemp(prefix="sheetlens-sink-")
    df = spark.createDataFrame([("x/a.bin", b"12"), ("y/b.bin", b"345")], "path string, content binary")
    write_binary_files(df, "file:" + d + "/out")
    write_binary_files(df, "file:" + d + "/out")                 # a rerun rewrites the same files
    assert sorted(os.listdir(d + "/out")) == ["a.bin", "b.bin"]
    with open(os.path.join(d, "out", "b.bin"), "rb") as f:
        assert f.read() == b"345"


def test_text_sink_one_file_per_key_and_rerun_safe(spark):
    from sheetlens.sources.files import write_text_files

    d = tempfile.mkdtemp(prefix="sheetlens-text-")
    df = spark.createDataFrame([("p/a", "a", 0, "h"), ("p/a", "a", 1, "x,y"), ("p/b", "b", 0, "h2"), ("p/a", "a", 2, "z"),
                                ("p/c", "no/such/c", 0, "h")], "source_file string, file string, row_index int, value string")
    ordered = df.repartition(3, "source_file").sortWithinPartitions("source_file", "row_index")
    for _ in range(2):                                           # rerun: same files, no duplicates
        failed = write_text_files(ordered, d, suffix=".csv").collect()
        assert [r.source_file for r in failed] == ["p/c"] and "Error" in failed[0].error
    assert sorted(os.listdir(d)) == ["a.csv", "b.csv"]           # no temporary files left
    with open(os.path.join(d, "a.csv")) as f:
        assert f.read() == "h\nx,y\nz\n"
