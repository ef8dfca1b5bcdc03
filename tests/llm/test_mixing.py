"""Mixing: targets by water filling, exact words by source, training positions."""

import random

import pytest

from sheetlens.llm import mixing
from sheetlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string"


def words(text):
    import re
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, ceiling=3):
    """sizes: {source: words}; by the contract's words, source after source."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > ceiling * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = ceiling * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows, out):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = plain_targets(sizes)
    taken = {}
    assert len(out) == len(rows)
    for r in out:
        assert r["size"] == words(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r["size"] and len(r.positions) >= r.copies
        assert r.positions == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5 + 1e-6 * want[s]


def corpus(seed, n=400):
    rnd = random.Random(seed)
    names = ["a", "b", "Z", "é", "zz", None, "tiny", "b2"]
    rows = []
    for i in range(n):
        s = "a" if rnd.random() < 0.35 else rnd.choice(names)
        k = rnd.randint(0, 2) if s == "tiny" else rnd.choice([0, 3, 40, 200])
        rows.append((i, " ".join(["w"] * k), s))
    return rows + [(1000, None, "a"), (5, "same row here", "b"), (5, "same row here", "b"), (None, "no id", "zz")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words(spark, seed):
    rows = corpus(seed)
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, out)
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    key = lambda r: (str(r.doc_id), str(r.text), str(r.source), r.taken, str(r.positions))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_small_buckets_give_the_same(spark, monkeypatch):
    from sheetlens.llm import common

    rows = corpus(3)
    df = spark.createDataFrame(rows, SCHEMA)
    plain = common.ordered_prefix
    monkeypatch.setattr(mixing, "ordered_prefix", lambda *a, **k: plain(*a, **k, per_bucket=7))
    check(rows, mixing.mix(df).collect())


def test_order_follows_the_schedule(spark):
    rows = [(i, "w " * 50, s) for i in range(300) for s in ["abc"[i % 3]]]
    out = [r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect() if r.position is not None]
    assert [r.position for r in out] == sorted(r.position for r in out)
    mean = {s: sum(p for r in out if r.source == s for p in r.positions) / sum(len(r.positions) for r in out if r.source == s)
            for s in "abc"}
    assert mean["a"] < 0.47 < mean["b"] < 0.53 < mean["c"]     # early, even, late


def test_position_inverts_the_demand(spark):
    from pyspark.sql import functions as F

    for slope in (0.5, 0.0, -0.5, 0.9):
        df = spark.range(21).select((F.col("id") * 5.0).alias("c"))
        for r in df.select("c", mixing.due(F.col("c"), F.lit(100.0), F.lit(slope)).alias("t")).collect():
            assert r.t + slope * r.t * (1 - r.t) == pytest.approx(r.c / 100)


def test_query_and_edges(spark):
    out = QUERIES["op7_curriculum_mix"](spark, SF001).collect()
    assert len(out) == 1000 and sum(r.taken for r in out) == pytest.approx(sum(r["size"] for r in out), rel=1e-3)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "x")], SCHEMA)
    assert {(r["size"], r.taken, r.copies, r.position) for r in mixing.mix(blank).collect()} == {(0, 0, 0, None)}
    clash = spark.createDataFrame([(1, "a b", "s", 7, "w")], SCHEMA + ", weight int, _key string")
    r = mixing.mix(clash).first()
    assert (r.weight, r._key, r.taken) == (7, "w", 2)
