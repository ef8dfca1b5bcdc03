"""Vector searches against brute force."""

import math

import numpy as np

from sheetlens.llm import ann, topk
from sheetlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>"
EACH = "id % 50 = 0"


def made(seed, n, dim=12, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(7, dim))[rng.integers(0, 7, n)]
    x[: copies] = x[0]
    return [(i * 5, v.tolist()) for i, v in enumerate(x)]


def by_cosine(rows, k=5):
    m = np.array([v for _, v in rows])
    out = {}
    for i, (d, q) in enumerate(rows):
        if d % 50 == 0:
            s = ann.cosines(m, m[i])
            best = sorted((-s[j], rows[j][0]) for j in range(len(rows)) if j != i)[:k]
            out[d] = [(b, -a) for a, b in best]
    return out


def by_product(rows, k=5):
    m = [[math.floor(256 * x) for x in v] for _, v in rows]
    out = {}
    for i, (d, _) in enumerate(rows):
        if d % 50 == 0:
            out[d] = [(b, -a) for a, b in sorted((-sum(x * y for x, y in zip(m[i], m[j])), rows[j][0])
                                                 for j in range(len(rows)) if j != i)[:k]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(a, want):
    return np.mean([len({x for x, _ in a.get(q, [])} & {x for x, _ in w}) / max(len(w), 1) for q, w in want.items()])


def test_ann_recall_and_scores(spark):
    rows = made(1, 4000)
    out, want = got(ann.nearest(spark.createDataFrame(rows, SCHEMA), EACH)), by_cosine(rows)
    assert set(out) == set(want) and recall(out, want) > 0.95
    m = dict((d, np.array(v)) for d, v in rows)
    for q, found in out.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 5
        for d, s in found:
            assert abs(s - m[q] @ m[d] / np.linalg.norm(m[q]) / np.linalg.norm(m[d])) < 1e-12


def test_ann_on_the_given_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    out, want = got(QUERIES["op4_adaptive_ann"](spark, SF001)), by_cosine(rows)
    assert set(out) == set(want) and recall(out, want) >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    rows = made(2, 3000, copies=1200)[::-1]
    df = spark.createDataFrame(rows, SCHEMA)
    out = got(ann.nearest(df, EACH))
    assert [d for d, _ in out[0]] == [5, 10, 15, 20, 25] and [d for d, _ in out[50]] == [0, 5, 10, 15, 20]
    assert got(topk.top_products(df, EACH, data=256, queries=32)) == by_product(rows)


def test_products_exact(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    assert got(QUERIES["op10_cover_tree_topk"](spark, SF001)) == by_product(rows)
    for seed, dim in ((3, 2), (4, 40)):
        rows = made(seed, 1500, dim)
        assert got(topk.top_products(spark.createDataFrame(rows, SCHEMA), EACH, data=400, queries=16)) == by_product(rows)


def test_cover_tree_holds_every_point_once():
    for x in (np.random.default_rng(1).normal(size=(900, 3)), np.zeros((300, 2)), np.random.default_rng(2).normal(size=(700, 60))):
        t = topk.CoverTree(x)
        leaves = np.concatenate([p for p in t.points if p is not None])
        assert sorted(leaves.tolist()) == list(range(len(x)))
        for k in range(len(t.center)):
            assert np.sqrt(((x[t.under[k]] - t.c[k]) ** 2).sum(1)).max() <= t.r[k] + 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]),
            (1, [0.5, 0.5]), (None, [1.0, 0.0]), (2, [3.0]), (0, [1.0, 0.0]), (3, [])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, EACH).collect()]
    h = 0.5 / math.sqrt(0.5)
    assert sorted(out)[::2] == [(0, 1, 0, 1.0), (0, 2, 1, h)] and len(out) == 4
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_products(df, EACH).collect())
    assert [x for x in out if x[0] == 0][::2] == [(0, 1, 0, 65536), (0, 2, 1, 32768), (0, 3, 50, 0)]
    assert [x for x in out if x[0] == 50] == [(50, 1, 0, 0), (50, 2, 0, 0), (50, 3, 1, 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(empty, EACH).count() == 0 == topk.top_products(empty, EACH).count()
    big = spark.createDataFrame([(0, [1e7, 3.0]), (1, [1e7, 1.0]), (2, [1e300, 1.0])], SCHEMA)
    assert [r.score for r in topk.top_products(big, EACH).collect()] == [(1 << 63) - 1, 256 * 256 * (10 ** 14 + 3)]
    clash = spark.createDataFrame([(0, [1.0], 7, "x"), (4, [2.0], 8, "y")], SCHEMA + ", id int, row string")
    assert ann.nearest(clash, EACH).count() == 1 == topk.top_products(clash, EACH).count()
