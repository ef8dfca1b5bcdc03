"""Merge containment by dyadic boxes against a nested loop."""

import random

import pytest
from pyspark.sql import functions as F

from sheetlens.operators.merges import _dyadic, assign_merges

CELLS = "file string, sheet_index int, row_index long, column_index int"
MERGES = "file string, sheet_index int, ordinal int, start_row int, end_row int, start_col int, end_col int"


def test_dyadic_intervals(spark):
    rnd = random.Random(1)
    pairs = [(0, 0), (0, 1048575), (5, 4), (2**31 - 1, 2**31 - 1), (0, 2**31 - 1)]
    pairs += [(a, a + rnd.randint(0, 5000)) for a in (rnd.randint(0, 10**6) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", _dyadic(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        ranges = sorted((p.node << p.level, ((p.node + 1) << p.level) - 1) for p in r.p)
        assert len(ranges) <= 2 * max(1, (r.b - r.a + 1).bit_length())
        at = r.a
        for lo, hi in ranges:
            assert lo == at
            at = hi + 1
        assert at == max(r.b + 1, r.a)


@pytest.mark.parametrize("few", [64, 15, 0])  # 20 ranges a sheet or so: one array, some of each, dyadic boxes
def test_equals_nested_loop(spark, few):
    rnd = random.Random(2)
    merges = [("f" + str(rnd.randint(0, 2)), 0, k, a, a + rnd.choice([0, 0, 1, 5, 40]), c, c + rnd.choice([0, 1, 7]))
              for k in range(60) for a, c in [(rnd.randint(0, 50), rnd.randint(0, 12))]]
    merges += [("f0", 0, 99, 0, 1_048_575, 3, 3), ("f1", 0, 98, 30, 20, 0, 5)]
    cells = [(f"f{f}", 0, r, c) for f in range(4) for r in range(0, 100, 3) for c in range(14)] + [("f0", 0, None, 1), ("f0", 0, 0, 3), (None, 0, 1, 1)]
    out = assign_merges(spark.createDataFrame(cells, CELLS), spark.createDataFrame(merges, MERGES), few=few).collect()
    assert len(out) == len(cells)
    for r in out:
        own = [m for m in merges if m[0] == r.file and r.row_index is not None and m[3] <= r.row_index <= m[4] and m[5] <= r.column_index <= m[6]]
        want = min(own, key=lambda m: m[2], default=None)
        assert (r.merge and tuple(r.merge)) == (want and (want[2], want[5], want[6], want[3], want[4]))


def test_full_height_ranges(spark):
    """10,000 ranges over all rows: the work follows the cells, not the ranges' heights or number."""
    merges = spark.range(10_000).selectExpr("'f' file", "0 sheet_index", "int(10000 - id) ordinal", "0 start_row", "1048575 end_row",
                                            "int(id % 100) start_col", "int(id % 100 + id % 3) end_col")
    cells = spark.range(3000).selectExpr("'f' file", "0 sheet_index", "id * 349 row_index", "int(id % 120) column_index")
    out = assign_merges(cells, merges)
    got = {r.row_index: r.merge and r.merge.ordinal for r in out.collect()}
    by_col = {}
    for i in range(10_000):
        for c in range(i % 100, i % 100 + i % 3 + 1):
            by_col[c] = min(by_col.get(c, 10**9), 10_000 - i)
    assert got == {i * 349: by_col.get(i % 120) for i in range(3000)}
    boxes = merges.select(F.explode(_dyadic(F.col("start_row").cast("bigint"), F.col("end_row").cast("bigint"))))
    assert boxes.count() == 10_000  # one box for a full column of 2**20 rows


def test_empty(spark):
    cells, merges = spark.createDataFrame([("f", 0, 1, 1)], CELLS), spark.createDataFrame([], MERGES)
    assert assign_merges(cells, merges).first().merge is None and assign_merges(cells.limit(0), merges).count() == 0


def test_few_ranges_shuffle_cells_once(spark):
    """Cells of sheets with few ranges are not looked up box by box: no row for a cell beside its own."""
    merges = spark.range(300).selectExpr("concat('f', id % 100) file", "0 sheet_index", "int(id div 100) ordinal", "0 start_row",
                                         "int(id % 7) end_row", "0 start_col", "1 end_col")
    cells = spark.range(5000).selectExpr("concat('f', id % 120) file", "0 sheet_index", "id % 9 row_index", "int(id % 2) column_index")
    out = assign_merges(cells, merges)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Generate" not in plan
    assert out.count() == 5000 and 0 < out.where("merge is not null").count() < 5000
