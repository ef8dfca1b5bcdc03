"""Row numbering without a per-key or single-partition window, under skew."""

import pytest
from pyspark.sql import functions as F

from sheetlens.operators.numbering import explicit_partitions, global_row_number, row_number_within
from sheetlens.operators.tables import number_rows


def _skewed(spark, n=3000):
    # key 0 holds a third of all rows; values repeat so the order needs the tie-break columns
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
                                 (F.col("id") % 17).alias("v"), F.col("id").alias("payload"))


@pytest.mark.parametrize("hot", [1_000_000, 500, 1])
def test_within_groups_matches_python(spark, hot):
    df = _skewed(spark)
    got = row_number_within(df, ["k"], ["v"], name="rn", count_name="n", partitions=8, hot=hot).collect()
    rows = sorted(df.collect(), key=lambda r: (r["k"], r["v"], r["payload"]))
    expected, last, i = {}, None, 0
    for r in rows:
        i = i + 1 if r["k"] == last else 1
        last = r["k"]
        expected[r["payload"]] = i
    assert {r["payload"]: r["rn"] for r in got} == expected
    counts = {r["k"]: r["n"] for r in got}
    assert counts[0] == sum(1 for r in rows if r["k"] == 0) >= 1000


def test_hot_key_spread_over_partitions(spark):
    g = global_row_number(_skewed(spark), ["k", "v"], "g", partitions=8)
    parts = g.where(F.col("k") == 0).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 2
    assert sorted(r["g"] for r in g.collect()) == list(range(1, 3001))


def test_number_rows_global_and_per_group(spark):
    df = _skewed(spark, 600)
    whole = number_rows(df, ["payload"]).collect()
    assert sorted(r["行号"] for r in whole) == list(range(1, 601))
    assert all(r["行号"] == r["payload"] + 1 for r in whole)
    per = number_rows(df, ["payload"], by=["k"]).where(F.col("k") == 0).orderBy("payload").collect()
    hot = df.where(F.col("k") == 0).count()
    assert [r["行号"] for r in per] == list(range(1, hot + 1))


def test_numbers_do_not_rest_on_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(200_000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("payload"))
        g = global_row_number(df, ["k"], "g")
        r = g.agg(F.count_distinct("g").alias("d"), F.min("g").alias("a"), F.max("g").alias("b")).first()
        assert (r.d, r.a, r.b) == (200_000, 1, 200_000)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), (None, 1)], "k string, v int")
    for hot in (1_000_000, 2):
        out = sorted((str(r.k), r.v, r.rn, r.n) for r in row_number_within(df, ["k"], ["v"], count_name="n", hot=hot).collect())
        assert out == [("None", 1, 1, 3), ("None", 1, 2, 3), ("None", 3, 3, 3), ("a", 2, 1, 1)]


def test_partition_count_does_not_follow_a_size_guess(spark):
    two = spark.createDataFrame([(1,), (2,)], "a int")
    assert explicit_partitions(two) <= max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                           spark.sparkContext.defaultParallelism)
    assert global_row_number(two, ["a"], "g").rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
