"""The history in a shared folder: appends side by side, retention, removal; retention by selection."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from sheetlens.operators import ledger as L
from sheetlens.operators.ledger_table import LedgerTable


def entries(spark, tag, n):
    stats = spark.range(n).select(F.lit(3).alias("total_files"), F.lit(3).alias("successful"), F.lit(0).alias("failed"), F.lit(0).alias("duration"))
    return L.new_entries(stats, tag, "n", "i", "o").withColumn("id", F.concat(F.lit(tag + "-"), F.monotonically_increasing_id().cast("string")))


def test_two_writers(spark, tmp_path):
    """Appends that race lose nothing and get numbers of their own."""
    path, found = str(tmp_path / "h"), []

    def write(tag):
        t = LedgerTable(spark, path)
        found.extend(t.append(entries(spark, f"{tag}{k}", 3)) for k in range(4))

    threads = [threading.Thread(target=write, args=(c,)) for c in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = LedgerTable(spark, path).read().collect()
    assert sorted(r.seq for r in rows) == list(range(1, 37)) and len({r.id for r in rows}) == 36
    assert sorted(found) == list(range(0, 36, 3)) and LedgerTable(spark, path).version() == 12
    for tag in {r.processor_id for r in rows}:  # an append stays together
        own = sorted(r.seq for r in rows if r.processor_id == tag)
        assert own == list(range(own[0], own[0] + 3))


def test_second_commit_of_a_version_is_refused(spark, tmp_path, monkeypatch):
    t = LedgerTable(spark, str(tmp_path / "h"))
    t.append(entries(spark, "a", 2))
    assert not t._create(1, {"action": "clear"}) and t.version() == 1
    # a writer that read the last version before another committed tries again on the new one
    stale, own = [{"version": 0, "end": 0, "floor": 0, "cleared": 0}], t._last
    monkeypatch.setattr(t, "_last", lambda: stale.pop() if stale else own())
    assert t.append(entries(spark, "b", 2)) == 2
    assert sorted(r.seq for r in t.read().collect()) == [1, 2, 3, 4]


def test_segment_without_commit_does_not_show(spark, tmp_path, monkeypatch):
    t = LedgerTable(spark, str(tmp_path / "h"))
    t.append(entries(spark, "a", 2))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(t, "_commit", lambda make: (_ for _ in ()).throw(RuntimeError("job lost")))
        t.append(entries(spark, "b", 5))
    assert t.append(entries(spark, "c", 1)) == 2
    assert sorted((r.seq, r.processor_id) for r in t.read().collect()) == [(1, "a"), (2, "a"), (3, "c")]


def test_operations(spark, tmp_path):
    t = LedgerTable(spark, str(tmp_path / "h"))
    assert t.read().count() == 0 and t.version() == 0
    t.append(entries(spark, "a", 10))
    t.append(entries(spark, "b", 10), max_entries=12)
    assert sorted(r.seq for r in t.read().collect()) == list(range(9, 21))
    t.remove("b-0") if t.read().where("id = 'b-0'").count() else None
    n = t.read().count()
    with pytest.raises(KeyError):
        t.remove("none")
    t.trim(5)
    assert t.read().count() == min(5, n) and max(r.seq for r in t.read().collect()) >= 19
    t.clear()
    assert t.read().count() == 0
    assert t.append(entries(spark, "c", 2)) == 20
    t.trim(0)
    assert t.read().count() == 0 and t.append(entries(spark, "d", 0)) == 22 and t.read().count() == 0


@pytest.mark.parametrize("n", [1, 7, 250, 499, 500, 600])
def test_selection(spark, monkeypatch, n):
    monkeypatch.setattr(L, "_BUCKETS", 4)
    rnd = random.Random(n)
    seqs = rnd.sample(range(-10_000, 10_000_000_000), 500)
    led = spark.createDataFrame([(s, f"i{s}") for s in seqs], "seq long, id string")
    assert sorted(r.seq for r in L.trim(led, n).collect()) == sorted(seqs)[-n:]


def test_selection_with_ties_and_nulls(spark):
    seqs = [1, 2, 2, 2, 2, 3, 3, None]
    led = spark.createDataFrame([(s, f"i{k}") for k, s in enumerate(seqs)], "seq long, id string")
    for n in range(10):
        got = [r.seq for r in L.trim(led, n).collect()]
        want = sorted(seqs, key=lambda s: -1 if s is None else s)[-n:] if n else []
        assert sorted(got, key=str) == sorted(want, key=str)
    assert L.trim(led.limit(0), 3).count() == 0


def test_no_sort_in_the_plan(spark):
    led = spark.range(1000).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("id"))
    plan = L.trim(led, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
