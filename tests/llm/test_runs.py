"""Periodic runs of words against a plain search by definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sheetlens.llm import runs
from sheetlens.llm.queries import QUERIES

SF0001 = "/root/testdata/sf0.001"


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if all(w[i] == w[i + p] for i in range(len(w) - p)))


def brute(w, least=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and smallest_period(w[i:j + q]) == q:
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def folded(text, doc_id):
    w, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def expected(text, doc_id):
    w = folded(text, doc_id)
    r = brute(w)
    gone = {k for s, n, q in r for k in range(s + q, s + n)}
    best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(r), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def words(rnd):
    """Texts with runs of many kinds: nested, adjacent, of periods that divide one another, in random words."""
    out = []
    while len(out) < rnd.randint(0, 160):
        kind = rnd.random()
        if kind < 0.3:
            out += [rnd.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 20))]
        elif kind < 0.6:
            unit = [rnd.choice(b"abc") for _ in range(rnd.randint(1, 9))]
            out += (unit * 30)[:rnd.randint(1, 60)]
        elif kind < 0.8:
            inner = [rnd.choice(b"xy")] * rnd.randint(10, 14) + [rnd.choice(b"uvw")]
            out += inner * rnd.randint(1, 3)
        else:
            out += [rnd.choice(b"ab") for _ in range(rnd.randint(1, 30))]
    return [bytes([x]) for x in out]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_equals_brute_force(least):
    rnd = random.Random(least)
    texts = [words(rnd) for _ in range(150)]
    got = runs.text_runs(texts, least)
    for t, r in zip(texts, got):
        assert r == brute(t, least)


def test_splitting_leaves_only_what_can_hold_a_run():
    w = np.array([0, 1, 2, 3] + [4, 5] * 8 + [6, 0, 1] + [7, 8, 7, 9, 8] + [9] * 3)
    assert runs.surviving(w, np.zeros(len(w), np.int64), 12) == [(4, 20)]
    assert runs.surviving(np.arange(50), np.zeros(50, np.int64), 12) == []
    assert runs.surviving(np.empty(0, np.int64), np.empty(0, np.int64), 12) == []


def test_long_texts():
    rnd = np.random.default_rng(1)
    unit = rnd.integers(0, 50, 3000)
    w = np.concatenate([rnd.integers(100, 200, 500), np.tile(unit, 4), rnd.integers(200, 300, 500)])
    r = max(runs.lag_scan(w), key=lambda x: x[1])
    assert r[2] == 3000 and r[0] <= 500 and r[1] >= 12_000
    assert runs.lag_scan(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def test_query_on_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    out = sorted(tuple(r) for r in QUERIES["op11_frequency_split_runs"](spark, SF0001).collect())
    assert [r[0] for r in out] == sorted(docs) and sum(r[1] for r in out) > 20
    short = [r for r in out if len((docs[r[0]] or "").split()) <= 1500]
    assert len(short) > 150
    for r in short:
        assert r == expected(docs[r[0]], r[0])


def test_edges(spark, tmp_path):
    schema = "doc_id long, text string, runs int, collapsed string, start int, best string"
    rows = [(1, None, 1, "c", 2, "b"), (2, "", 1, "c", 2, "b"), (3, " \t\n", 1, "c", 2, "b"), (None, "a b " * 30, 1, "c", 2, "b"),
            (4, "é " * 12, 1, "c", 2, "b"), (4, "é " * 12, 1, "c", 2, "b"), (5, "x y " * 11, 1, "c", 2, "b")]
    df = spark.createDataFrame(rows, schema)
    out = {(r.doc_id, r.text): r for r in runs.find_runs(df).collect()}
    assert all(out[k, rows[k - 1][1]].runs == [] and out[k, rows[k - 1][1]].collapsed == "" for k in (1, 2, 3))
    assert [tuple(x) for x in out[None, "a b " * 30].runs] == [(0, 60, 2)] and out[None, "a b " * 30].collapsed == "a b"
    assert [tuple(x) for x in out[4, "é " * 12].runs] == [(0, 12, 1)] and out[4, "é " * 12].best == "b"
    assert out[5, "x y " * 11].runs == []
    assert runs.find_runs(df).count() == 7 and runs.find_runs(df.limit(0)).count() == 0
    df.select("doc_id", "text", "start", "best").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op11_frequency_split_runs"](spark, str(tmp_path)).collect()}
    assert got[1].n_runs == 0 and got[1].start is None and got[1].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].n_runs == 1 and got[None].exponent_milli == 30_000
