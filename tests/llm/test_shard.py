"""Shards of near equal bytes: the law, the slots and the exact histogram."""

import random
import zlib

import numpy as np

from sheetlens.llm import shard
from sheetlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def test_query_on_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = QUERIES["op9_histogram_shards"](spark, SF001).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    total, places = {}, {}
    for r in out:
        b = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        total[r.shard] = total.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert sorted(total) == list(range(16)) and max(total.values()) < 1.06 * np.mean(list(total.values()))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_many_ranges_and_a_hot_text(spark):
    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randint(0, 300)) for i in range(4000)] + [(10_000 + i, "the same text " * 10) for i in range(2000)]
    for per in (200_000, 50):
        out = shard.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=5, rows_per_range=per).collect()
        assert len(out) == 6000
        total, places = [0] * 5, {}
        for r in out:
            total[r.shard] += r["size"]
            places.setdefault(r.shard, []).append(r.slot)
        assert max(total) - min(total) < 0.045 * sum(total) / 5
        assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_copies_stay_together_where_bytes_allow(spark):
    rnd = random.Random(2)
    rows = [(i, f"text {i % 2000} " + "y" * (i % 2000 % 60)) for i in range(6000)]
    rnd.shuffle(rows)
    out = shard.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=8).collect()
    where = {}
    for r in out:
        where.setdefault(r.text, set()).add(r.shard)
    assert max(map(len, where.values())) == 1


def test_histogram_is_exact(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(-5, 5), rnd.randint(0, 9), rnd.randint(1, 50)) for _ in range(500)]
    probes = sorted({(rnd.randint(-6, 6), rnd.randint(0, 9)) for _ in range(20)} | {(0, shard._LOW)})
    got = shard._histogram(spark.createDataFrame(rows, "h long, i long, size long"), probes)
    for p, (size, n) in zip(probes, got.tolist()):
        below = [r for r in rows if (r[0], r[1]) < p]
        assert (size, n) == (sum(r[2] for r in below), len(below))


def test_edges(spark):
    assert shard.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None), (None, "a"), (2, ""), (2, ""), (3, "é" * 50_000)]
    out = shard.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=3).collect()
    assert sorted(r["size"] for r in out) == [1, 1, 1, 2, 100_001] and {r.shard for r in out} <= {0, 1, 2}
    clash = spark.createDataFrame([(1, "a", 9, "h", 3)], SCHEMA + ", size int, _h string, shard int")
    r = shard.shard_documents(clash, shards=1).first()
    assert (r["size"], r._h, r.shard, r.slot) == (2, "h", 0, 0)


def test_place_with_several_texts_cut_by_id():
    rnd = np.random.default_rng(5)
    h, i = rnd.integers(0, 4, 500), rnd.integers(0, 30, 500)
    probes = sorted({(int(a), int(b)) for a, b in zip(rnd.integers(0, 4, 25), rnd.integers(0, 30, 25))})
    ph, pi = (np.array([p[k] for p in probes]) for k in range(2))
    want = [sum(p <= (a, b) for p in probes) for a, b in zip(h.tolist(), i.tolist())]
    assert shard._place(h, i, ph, pi).tolist() == want


def test_two_hot_texts_cut_by_id(spark):
    rows = ([(k, "first hot text " * 20) for k in range(3000)] + [(k, "second hot text " * 20) for k in range(3000, 6000)]
            + [(k, f"own {k}") for k in range(6000, 6500)])
    out = shard.shard_documents(spark.createDataFrame(rows, SCHEMA), shards=7, rows_per_range=50).collect()
    total, places = [0] * 7, {}
    for r in out:
        total[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 6500 and max(total) - min(total) < 0.03 * sum(total) / 7
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
