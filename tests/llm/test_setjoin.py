"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from sheetlens.llm import setjoin
from sheetlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def shingled(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85, width=4):
    sets = [shingled(t, width) for _, t in rows]
    where, at = list(range(len(rows))), {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)

    def find(i):
        while where[i] != i:
            where[i] = i = where[where[i]]
        return i

    for i, s in enumerate(sets):
        near = {j for x in s for j in at[x] if j < i}
        for j in near:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                where[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.jaccard_components(df, **kw).collect()), key=str)


def corpus(seed, n=150, common=0):
    """Copies with edits around the threshold; ``common``: words of a line that all share."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "C", "dé"]) + str(rnd.randint(0, 300))
    line = [word() for _ in range(common)]
    rows = []
    while len(rows) < n:
        base = line + [word() for _ in range(rnd.choice([0, 1, 3, 5, 8, 12, 30, 80, 200]))]
        for _ in range(rnd.randint(1, 7)):
            w = list(base)
            for _ in range(rnd.randint(0, 1 + len(w) // 30)):
                if w:
                    w[rnd.randrange(len(w))] = word()
            if w and rnd.random() < 0.3:
                del w[rnd.randrange(len(w)):][:rnd.randint(0, 4)]
            rows.append((len(rows), " ".join(w)))
    return rows + [(1000, None), (1001, "  "), (None, rows[3][1]), (4, rows[4][1]), (4, rows[4][1]), (None, "alone here")]


@pytest.mark.parametrize("seed,common,kw", [(1, 0, {}), (2, 25, {}), (3, 25, {"upgrade": 0, "pass_cost": 0}), (4, 60, {"upgrade": 3, "pass_cost": 0})])
def test_equals_all_pairs(spark, seed, common, kw):
    rows = corpus(seed, common=common)
    assert got(spark.createDataFrame(rows, SCHEMA), **kw) == brute(rows)


def test_upgrades_are_used(spark, monkeypatch):
    """Value 2 is given, and what it finds is compared."""
    names, own = [], setjoin.written
    monkeypatch.setattr(setjoin, "written", lambda df, name: names.append(name) or own(df, name))
    rows = corpus(3, common=25)
    assert got(spark.createDataFrame(rows, SCHEMA), upgrade=0, pass_cost=0) == brute(rows) and "sets-requests" in names
    names.clear()
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows) and "sets-requests" not in names


def test_blocks_and_full_filters(spark, monkeypatch):
    """Small blocks; a filter bitmap so small that it lets nearly all through."""
    monkeypatch.setattr(setjoin, "BLOCK", 3)
    monkeypatch.setattr(setjoin, "FILTER_BITS", 128)
    rows = corpus(5, common=25)
    assert got(spark.createDataFrame(rows, SCHEMA), upgrade=2, pass_cost=0) == brute(rows)
    assert got(spark.createDataFrame(rows, SCHEMA), percent=60, width=2) == brute(rows, 60, 2)


def test_pigeonhole():
    """Every linked pair has a segment that differs in fewer elements than any values of the right sum say."""
    bands, rng = setjoin.Bands(85), np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(7, 400))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        d = int(rng.integers(0, bands.differ(len(a)) + 1))
        gone = int(rng.integers(0, d + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 62, d - gone, dtype=np.uint64)]))
        x, y = (a, b) if len(a) >= len(b) else (b, a)
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common):
            continue
        k = bands.of(len(x))
        assert k == bands.of(len(y)) or k in bands.others(len(y))
        m, need = bands.segments(k), bands.need(len(x))
        assert m >= need
        value = np.zeros(m, int)
        value[rng.permutation(m)[:need]] = 1
        hot = rng.permutation(np.flatnonzero(value))[:need // 3]
        up = np.setdiff1d(np.flatnonzero(value), hot)[:len(hot)]
        value[hot], value[up] = 0, 2
        assert value.sum() >= need
        fx, fy = setjoin.own_keys(x, k, bands), setjoin.own_keys(y, k, bands)
        equal = (fx == fy) & (value > 0)
        (sx, dx), (sy, dy) = setjoin.deletions(x, k, bands), setjoin.deletions(y, k, bands)
        near = set(fx[up]) & set(dy) or set(dx[np.isin(sx, up)]) & set(fy)
        assert equal.any() or near


def test_parity_never_exceeds_the_difference():
    bands, rng = setjoin.Bands(85), np.random.default_rng(2)
    for n in (5, 50, 900):
        a, b = (np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: n // 2], b[: n // 2]]))
        k = bands.of(len(a))
        bits = int(np.bitwise_count(setjoin.parity(a, k, bands) ^ setjoin.parity(b, k, bands)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_query_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op13_pigeonhole_jaccard"](spark, SF001).collect()), key=str)
    assert out == brute(rows) and any(r[0] != r[2] for r in out)


def test_empty_and_extra_columns(spark):
    assert setjoin.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e", 5, "r", 7), (2, None, 1, "k", 3)], SCHEMA + ", node int, key string, n int")
    assert got(df) == [(1, 2, 1), (2, 0, 2)]


def test_members_of_a_key_are_joined_once_for_a_role(spark):
    """A key's members meet what is known of the key once as probing sets and once as the others; the band comes with it."""
    rows = [(5, k, k, 7, k < 3) for k in range(6)] + [(6, 10, 10, 7, False), (6, 11, 11, 7, False), (7, 12, 12, 7, True)]
    members = spark.createDataFrame(rows, "key long, node long, comp long, n long, probe boolean")
    band = setjoin.Bands(85).of(7)
    marks = spark.createDataFrame([(r[1], band, bytearray(24)) for r in rows], "node long, band int, bits binary")
    out = setjoin._compared(members, marks, 85, False)
    assert {(r.a, r.b) for r in out.collect()} == {(a, b) for a in range(3) for b in range(a + 1, 6)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 2 and plan.count("Join Inner") <= 6
