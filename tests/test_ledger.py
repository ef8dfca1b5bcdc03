"""Run-history ledger (the reference's history tests plus import/export)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import ledger as L


def _stats(spark, rows):
    return spark.createDataFrame(
        [(t, s, f, 0) for t, s, f in rows], "total_files bigint, successful bigint, failed bigint, duration bigint")


def test_add_recent_trim_clear(spark):
    led = L.empty(spark)
    led = L.append(led, L.new_entries(_stats(spark, [(10, 10, 0)]), "cargo_analysis", "货物", "in", "out"))
    assert led.count() == 1
    for _ in range(9):
        led = L.append(led, L.new_entries(_stats(spark, [(10, 8, 2)]), "p", "n", "in", "out")).checkpoint()
    assert led.count() == 10
    assert sorted(r["seq"] for r in led.collect()) == list(range(1, 11))
    assert [r["seq"] for r in L.recent(led, 3).collect()] == [10, 9, 8]
    assert sorted(r["seq"] for r in L.trim(led, 5).collect()) == [6, 7, 8, 9, 10]
    assert L.successful(led).count() == 1 and L.failed(led).count() == 9
    assert L.by_processor(led, "cargo_analysis").count() == 1
    rate = led.select(L.success_rate_pct().alias("r")).orderBy("r").collect()
    assert rate[0]["r"] == pytest.approx(80.0) and rate[-1]["r"] == pytest.approx(100.0)


def test_remove_unknown_id_raises(spark):
    led = L.append(L.empty(spark), L.new_entries(_stats(spark, [(1, 1, 0)]), "p", "n", "i", "o"))
    eid = led.first()["id"]
    assert L.remove(led, eid).count() == 0
    with pytest.raises(KeyError):
        L.remove(led, "no-such-id")


def test_export_import(spark):
    led = L.append(L.empty(spark), L.new_entries(_stats(spark, [(1, 1, 0), (2, 1, 1)]), "p", "n", "i", "o"))
    path = os.path.join(tempfile.mkdtemp(prefix="sheetlens-ledger-"), "h")
    L.export_json(led, path)
    back = L.load_json(spark, path)
    assert sorted(r["id"] for r in back.collect()) == sorted(r["id"] for r in led.collect())
    imp = back.withColumn("ordinal", F.col("seq")).unionByName(
        back.withColumn("id", F.concat(F.lit("x"), "id")).withColumn("ordinal", F.col("seq") + 10))
    merged = L.import_entries(led, imp)
    assert merged.count() == 4                          # existing ids kept once, two new ones
    assert sorted(r["seq"] for r in merged.collect()) == [1, 2, 3, 4]
    bad = os.path.join(tempfile.mkdtemp(prefix="sheetlens-ledger-"), "bad.json")
    with open(bad, "w") as f:
        f.write("{not json")
    assert L.load_json(spark, bad, on_corrupt="empty").count() == 0


def test_save_load_clear(spark):
    led = L.append(L.empty(spark), L.new_entries(_stats(spark, [(3, 3, 0)]), "p", "n", "i", "o", status_path="o/_status"))
    path = os.path.join(tempfile.mkdtemp(prefix="sheetlens-ledger-"), "ledger")
    L.save(led, path)
    back = L.load(spark, path)
    assert back.count() == 1 and back.first()["status_path"] == "o/_status"
    L.clear(spark, path)
    assert L.load(spark, path).count() == 0
