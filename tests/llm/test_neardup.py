"""Near-duplicates against brute force over all pairs of full sets."""

import random

import numpy as np
import pytest

from sheetlens.llm import neardup
from sheetlens.llm.components import components
from sheetlens.llm.queries import QUERIES

SF0001 = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def word_set(text, k=5):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()


def brute(rows):
    sets = [(d, word_set(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    rows, bases = [], [[word() for _ in range(rnd.choice([7, 40, 200]))] for _ in range(12)]
    for i in range(160):
        ws = list(rnd.choice(bases)) if rnd.random() < 0.7 else [word() for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            if ws:
                ws[rnd.randrange(len(ws))] = word()
        rows.append((i * 3 + 1, (" " if i % 2 else "\t\n").join(w.upper() if i % 3 == 0 else w for w in ws)))
    return rows + [(900, None), (901, "  \n"), (902, "one two"), (903, "One  two"), (904, "one two three"),
                   (905, "Été a b c d"), (906, "été a b c d"), rows[0], rows[0], (None, rows[5][1]),
                   (None, "quite alone here now yes indeed")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    want = [(d, n, c, d == c) for d, n, c, _ in brute(rows)]
    out = got(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert out == sorted(want, key=str)


def test_second_round_finds_links_between_later_members(spark):
    """A chain in which the first member of a bucket is linked with few of the others."""
    rnd = random.Random(4)
    ws = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(ws)))
        ws = ws[4:] + [f"w{rnd.randrange(10**6)}" for _ in range(4)]
    out = got(neardup.near_duplicates(spark.createDataFrame(rows[::-1], SCHEMA)))
    assert {r[2] for r in out} == {0} == {r[2] for r in brute(rows)}


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(3)
    probes = neardup._probes(neardup.BUCKETS)
    for n, keep in [(8, 6), (100, 75), (5000, 4000), (5000, 500)]:
        both = []
        for _ in range(20):
            x = rng.integers(0, 1 << 63, 2 * n - keep, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(x[:n]), np.sort(x[n - keep:])
            same = (neardup.registers(a, probes) == neardup.registers(b, probes)).sum()
            both.append(neardup.estimate(np.array([same]), np.array([n]), np.array([n]))[0])
        assert abs(np.mean(both) - keep / (2 * n - keep)) < 0.03


def test_registers_by_plain_reading():
    rng = np.random.default_rng(5)
    h = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    regs = neardup.registers(h, neardup._probes(256))
    for bucket in range(256):
        rest = min(int(x) << 8 & (1 << 64) - 1 | 1 for x in h if int(x) >> 56 == bucket)
        text = f"{rest:064b}"
        zeros = text.index("1")
        assert regs[bucket] == (zeros << 10) | int((text[zeros + 1:] + "0" * 10)[:10], 2)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    rnd.shuffle(edges)
    out = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    assert got(QUERIES["op1_hyperminhash_dedup"](spark, SF0001)) == brute(rows)


def test_empty_and_extra_columns(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c", "x", 3, 4), (2, "a b c", "y", 5, 6)],
                               "doc_id long, text string, _rid string, kept int, node int")
    out = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert out[2].component_id == 1 and out[2]._rid == "y" and out[2].node == 6 and not out[2].kept and out[1].kept
