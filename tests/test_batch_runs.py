"""Batch runs: complete outputs and failures isolated per file; history; regex dialect; shared folder."""

import os
import tempfile
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheetlens.model import LEDGER_SCHEMA
from sheetlens.operators import batch as B
from sheetlens.operators import ledger as L
from sheetlens.operators.patterns import java_pattern
from sheetlens.sources import xlsx as XL
from sheetlens.sources.manifest import validate_input
from sheetlens.sources.xlsx_writer import workbook_bytes


def book(rows):
    return workbook_bytes([("S", [[{"v": v} for v in r] for r in rows], [])])


def files(spark, items):
    return spark.createDataFrame(items, "path string, content binary")


def read(d):
    out = {}
    for name in sorted(os.listdir(d)):
        if name.endswith(".csv"):
            with open(os.path.join(d, name), encoding="utf-8") as f:
                out[name] = f.read().splitlines()
    return out


def test_header_only_same_names_and_broken_files(spark):
    d = tempfile.mkdtemp(prefix="sheetlens-batch-")
    src = files(spark, [("a/x.xlsx", book([["h"], ["1"]])), ("b/x.xlsx", book([["h"], ["2"]])),
                        ("a/only.xlsx", book([["p", ""]])), ("a/bad.xlsx", b"no zip")])
    run = B.run_batch(spark, src, d)
    out = read(d)
    assert out.pop("only.xlsx.csv") == ["p,Column_1"]
    assert len(out) == 2 and all(n.startswith("x~") for n in out) and sorted(out.values()) == [["h", "1"], ["h", "2"]]
    s = {r.file: r.error for r in run.status.collect()}
    assert s.pop("a/bad.xlsx") and set(s.values()) == {None} and len(s) == 3
    assert tuple(run.stats().first())[:4] == (4, 3, 1, True)
    assert run.counts == {"total_files": 4, "failed": 1}
    assert "parquet" not in run.stats()._jdf.queryExecution().toString().lower()   # not read again
    assert tuple(B.read_tables(src).stats().first())[:4] == (4, 3, 1, True)


def test_user_code_fails_one_file(spark):
    d = tempfile.mkdtemp(prefix="sheetlens-batch-")
    src = files(spark, [("g.xlsx", book([["k", "v"], ["b", "1"], ["a", "2"]])), ("f.xlsx", book([["k"], ["boom"]])),
                        ("e.xlsx", book([["k"]])), ("z.xlsx", b"")])

    def user(pdf):
        if (pdf.iloc[:, 0] == "boom").any():
            raise ValueError("refused")
        return pdf.assign(n=range(1, len(pdf) + 1))

    run = B.run_batch(spark, src, d, per_file=user)
    assert read(d) == {"g.xlsx.csv": ["k,v,n", "b,1,1", "a,2,2"], "e.xlsx.csv": ["k,n"]}
    s = {r.file: r.error for r in run.status.collect()}
    assert s["f.xlsx"] == "ValueError: refused" and s["z.xlsx"] and s["g.xlsx"] is None and s["e.xlsx"] is None
    assert tuple(run.stats().first())[:3] == (4, 2, 2)


def test_row_numbers_after_dedupe_and_column_clash(spark):
    src = files(spark, [("g.xlsx", book([["k"], ["a"], ["a"], ["b"]])), ("c.xlsx", book([["行号"], ["a"]])),
                        ("e.xlsx", book([["k"]]))])
    run = B.read_tables(src)
    good = run.tables.where("source_file = 'g.xlsx'")
    got = B.number_rows_per_file(B.dedupe_per_file(good)).select("values", "header").collect()
    assert sorted(tuple(r["values"]) for r in got) == [("1", "a"), ("2", "b")] and got[0].header == ["行号", "k"]
    with pytest.raises(Exception, match="duplicate column names"):
        B.number_rows_per_file(run.tables).collect()
    numbered = B.number_run(run)
    s = {r.file: (r.error, r.header) for r in numbered.status.collect()}
    assert s["c.xlsx"] == (B.DUPLICATE, None) and s["e.xlsx"] == (None, ["行号", "k"]) and s["g.xlsx"][0] is None
    assert numbered.tables.select("source_file").distinct().count() == 1


def test_per_file_rows_arrive_in_order(spark):
    rows = spark.range(5000).select(F.lit("f").alias("file"), (4999 - F.col("id")).alias("row_index"))
    out = B.per_file_apply(rows.repartition(7), lambda p: p.iloc[:1].assign(ok=p["row_index"].is_monotonic_increasing),
                           "file string, ok boolean, error string").first()
    assert out.ok and out.error is None


def entry(i, when, seq=None):
    return (seq, f"id{i}", when, "p", "P", "in", "out", (1, 1, 0, [], 0), None)


def test_import_keeps_the_newest_by_time(spark):
    t = datetime(2024, 1, 1)
    led = spark.createDataFrame([entry(1, t, 1), entry(2, t + timedelta(1), 2)], LEDGER_SCHEMA)
    old = spark.createDataFrame([entry(3, datetime(2020, 1, 1)), entry(4, datetime(2020, 1, 2)), entry(1, datetime(2019, 1, 1))],
                                LEDGER_SCHEMA).withColumn("ordinal", F.monotonically_increasing_id())
    assert [r.id for r in L.import_entries(led, old, max_entries=2).orderBy("seq").collect()] == ["id1", "id2"]
    every = L.import_entries(led, old).orderBy("seq").collect()
    assert [(r.id, r.seq) for r in every] == [("id3", 1), ("id4", 2), ("id1", 3), ("id2", 4)]


def test_append_keeps_the_order_of_one_call(spark):
    t = datetime(2024, 1, 1)
    new = spark.createDataFrame([entry(k, t) for k in (9, 3, 7, 1)], LEDGER_SCHEMA).coalesce(1)
    out = L.append(L.empty(spark), new).orderBy("seq").collect()
    assert [r.id for r in out] == ["id9", "id3", "id7", "id1"]


def test_damage_late_in_a_history_file(spark):
    d = tempfile.mkdtemp(prefix="sheetlens-json-")
    good = '{"seq":%d,"id":"a%d","timestamp":"2024-01-01T00:00:00Z"}'
    with open(d + "/h.json", "w") as f:
        f.write("\n".join(good % (i, i) for i in range(50)) + "\n{broken\n")
    with pytest.raises(ValueError):
        L.load_json(spark, d)
    assert L.load_json(spark, d, on_corrupt="empty").count() == 0
    e = tempfile.mkdtemp(prefix="sheetlens-json-")
    with open(e + "/h.json", "w") as f:
        f.write("[\n" + ",\n".join(good % (i, i) for i in range(5)) + "\n]\n")
    assert L.load_json(spark, e).count() == 5


@pytest.mark.parametrize("pattern,text,match", [
    ("[*+]", "a+b", True), (r"\++", "c++", True), (r"\\1", "x\\1", True), (r"a{2}?", "aa", True), ("[]a]", "]", True),
    (r"\v", "\x0b", True), (r"\u{e9}", "é", True), ("[[:digit:]]+x", "12x", True), ("(?P<n>a)b", "ab", True), ("(?u)a", "a", True),
    (r"[^\d]", "5", False), (r"\p{L}", "ß", True)])
def test_valid_patterns(spark, pattern, text, match):
    java = java_pattern(pattern)
    assert java is not None
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(java)).first()[0] is match


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?=a)", "(?<!a)", "(?>a)", r"\h", r"\Qa\E", r"\Z", "a++", r"\d{2}+", "(", "[", "*", r"\k<n>", "(?U)a"])
def test_invalid_patterns(spark, pattern):
    assert java_pattern(pattern) is None


def test_pattern_check_needs_a_session(spark, monkeypatch):
    from pyspark.sql import SparkSession

    monkeypatch.setattr(SparkSession, "getActiveSession", classmethod(lambda cls: None))
    with pytest.raises(RuntimeError):
        java_pattern("a")


def test_existence_in_the_analyzer_rule(spark):
    given = spark.createDataFrame([("a.xlsx",), ("b.xlsx",), ("c",)], "file string")
    there = spark.createDataFrame([("a.xlsx",), ("c",)], "file string")
    out = {r.file: (r.valid, r.reason) for r in validate_input(given, "analyzer", there).collect()}
    assert out == {"a.xlsx": (True, None), "b.xlsx": (False, "file does not exist"), "c": (False, "no file extension")}


class _Fake:
    """A session of a cluster without a shared folder."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder
        self.sparkContext = self.conf = self

    def get(self, key, default=None):
        return self.folder

    def set(self, key, value):
        self.folder = value

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        self.used = path


def test_shared_folder_is_asked_for_on_a_cluster():
    from sheetlens.session import ensure_checkpoint_dir

    for master in ("yarn", "k8s://x", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(_Fake(master))
        assert ensure_checkpoint_dir(_Fake(master, "hdfs:///shared")) == "hdfs:///shared"
    assert os.path.isdir(ensure_checkpoint_dir(_Fake("local[4]")))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_per_file_apply_takes_many_files_a_batch(spark, batch):
    """A file may go on over several batches; nulls of one file do not change the types of another."""
    def cells_of(pdf):
        """What user code sees of its file: rows, types and null places."""
        if pdf["file"].iloc[0] == "bad":
            raise ValueError("refused")
        return pdf[["file"]].iloc[:1].assign(rows=",".join(str(v) for v in pdf["row_index"]), n=len(pdf), kinds=f"{pdf['k'].dtype} {pdf['ok'].dtype}",
                                             nulls=f"{pdf['k'].isna().sum()} {sum(v is None for v in pdf['ok'])}")

    big = (1 << 53) + 1
    rows = [(f"f{i}", j, big + j, True) for i in range(20) for j in range(7)]
    rows += [("nulls", j, None if j == 1 else j, None if j == 2 else False) for j in range(4)]
    rows += [(None, 0, 1, True), (None, 1, 2, True), ("bad", 0, 1, True)]
    df = spark.createDataFrame(rows, "file string, row_index bigint, k bigint, ok boolean").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = B.per_file_apply(df, cells_of, "file string, rows string, n bigint, kinds string, nulls string, error string")
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # a group a file costs a batch each
        got = {r.file: tuple(r)[1:] for r in out.collect()}
        dates = B.per_file_apply(df, lambda p: p[["file"]].iloc[:1].assign(d=pd.Timestamp("2020-01-02")), "file string, d date, error string")
        assert {(str(r.d), r.error) for r in dates.collect()} == {("2020-01-02", None)} and dates.count() == 23
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plain = ("0,1,2,3,4,5,6", 7, "int64 bool", "0 0", None)
    assert got == {**{f"f{i}": plain for i in range(20)}, "nulls": ("0,1,2,3", 4, "float64 object", "1 1", None),
                   None: ("0,1", 2, "int64 bool", "0 0", None), "bad": (None, None, None, None, "ValueError: refused")}


def test_run_is_cut_once(spark, monkeypatch):
    """The status and the tables of a run read the same parts, and numbering its rows decodes nothing first."""
    calls = []
    monkeypatch.setattr(XL, "cut_workbooks", lambda *a, _cut=XL.cut_workbooks: calls.append(a) or _cut(*a))
    book = workbook_bytes([("S", [["a", "b"], [1, 2], [3, 4]], [])])
    files = spark.createDataFrame([("x.xlsx", book), ("y.xlsx", book[:50])], "path string, content binary")
    run = B.read_tables(files)
    assert len(calls) == 1
    numbered = []
    monkeypatch.setattr(type(run.tables), "count", lambda self: numbered.append(self) or 0)
    out = B.number_rows_per_file(run.tables)
    assert not numbered and sorted(tuple(r["values"]) for r in out.collect()) == [("1", "1", "2"), ("2", "3", "4")]
    assert {r.file: r.error is None for r in run.status.collect()} == {"x.xlsx": True, "y.xlsx": False} and len(calls) == 1
