"""Repeated-passage removal against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sheetlens.llm import suffix
from sheetlens.llm.queries import QUERIES

SF0001 = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def brute(rows, length, least_words=0):
    seen = Counter(b[i:i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        i = 0
        while least_words and i < len(b):
            j = i
            while j < len(b) and gone[j] == gone[i]:
                j += 1
            space = lambda k: not 0 <= k < len(b) or b[k] in b" \t\n\r\v\f"
            ends = sum(not space(k - 1) and not space(k) for k in (i, j))
            if gone[i] and len(b[i:j].split()) - ends < least_words:
                gone[i:j] = bytes(j - i)
            i = j
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def corpus(seed, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rnd.randint(4, 25))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(0, 20)))
                 for _ in range(rnd.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 90), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 10_000), (2, 10_000), (3, 3)])
def test_equals_brute_force(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    out = suffix.remove_repeats(df, length=30, gram=8, block=block)
    assert got(out) == brute(rows, 30)


def test_least_words(spark):
    rows = corpus(7)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 20, 9)
    assert got(suffix.remove_repeats(df, length=20, gram=8, least_words=9)) == want
    assert 0 < sum(r[2] for r in want) < sum(r[2] for r in brute(rows, 20))
    out = suffix.remove_repeats(df, length=20, gram=8, least_words=9, decode="left")
    assert out.columns == ["doc_id", "text", "left", "n_bytes", "n_removed", "n_spans"]
    assert all(r.left == (r.text or "") for r in out.collect() if not r.n_removed)


def test_chunked_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_CHUNK", 64)
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcd") for _ in range(3000))
    b = (text + text[500:900] + "x" + text[100:140]).encode()
    whole = {s: a for a, f, l, p in [suffix.segments(np.frombuffer(b, np.uint8), 30, 8)]
             for f_, l_, p_ in zip(f, l, p) for s, a in [(w, p_) for w in range(f_, l_ + 1)]}
    monkeypatch.setattr(suffix, "_CHUNK", 1 << 19)
    again = {s: a for a, f, l, p in [suffix.segments(np.frombuffer(b, np.uint8), 30, 8)]
             for f_, l_, p_ in zip(f, l, p) for s, a in [(w, p_) for w in range(f_, l_ + 1)]}
    assert whole == again and len(whole) == len(b) - 29


def test_suffix_sort_and_collisions(monkeypatch):
    rnd = random.Random(6)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    group = np.sort(np.array([rnd.randint(0, 9) for _ in strings]))
    want = sorted(range(300), key=lambda i: (group[i], strings[i], i))
    order, lcp = suffix._Suffixes(strings, group).sort()
    assert [(group[i], strings[i]) for i in order] == [(group[i], strings[i]) for i in want]
    bad = suffix._Suffixes(strings, group)
    bad.prefix[:] = 0  # every hash collides
    order2, lcp2 = bad.sort()
    assert [strings[i] for i in order2] == [strings[i] for i in order] and lcp2.tolist() == lcp.tolist()


def test_query_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    out = got(QUERIES["op5_suffix_dedup"](spark, SF0001))
    assert out == brute(rows, 400) and sum(r[2] for r in out) > 0


def test_empty_and_extra_columns(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "x" * 900, 5, "r", 7)], "doc_id long, text string, n_bytes int, _rid string, anchor int")
    r = suffix.remove_repeats(df).first()
    assert (r.n_bytes, r.n_removed, r._rid, r.anchor, r.kept) == (900, 900, "r", 7, b"")


def test_like_segments_are_packed(spark):
    """Segments of one content cross the shuffle as one row for each ``PACK`` of a task."""
    rows = [(1, 2, r, r) for r in range(200)] + [(1, 3, r, r) for r in range(5)] + [(-4, 2, 7, 7)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "anchor long, seg long, rid long, at long").coalesce(1)
    out = suffix._packed(df).collect()
    assert sorted(((r.anchor, r.seg, len(r.rids)) for r in out)) == [(-4, 2, 1), (1, 2, 8), (1, 2, 64), (1, 2, 64), (1, 2, 64), (1, 3, 5)]
    assert sorted((r.anchor, r.seg, x, y) for r in out for x, y in zip(r.rids, r.ats)) == sorted(rows)
    assert suffix._packed(df.limit(0)).count() == 0


def test_passage_of_very_many_texts(spark):
    """A passage that nearly all texts hold goes from each of them."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = text(150)
    rows = [(i, text(rnd.randint(0, 60)) + (passage if i % 10 else "") + text(rnd.randint(0, 60))) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plan = suffix.repeated_windows(df, "doc_id", "text", 30, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "rids" in plan  # the lookup gets packed rows
    assert got(suffix.remove_repeats(df, length=30, gram=8)) == brute(rows, 30)


def test_a_text_gets_one_row_of_a_share(spark):
    """However many segments of a text repeat, a share of the texts gives a row for each text, with runs that do not touch."""
    at = lambda first, n: (first << 20) | (n << 10) | 3
    rows = [([7, 9], [at(0, 10), at(100, 10)], None), ([7, 9], [at(10, 5), at(110, 5)], None), ([7], [at(20, 8)], [0, 1, 6, 7]),
            ([9], [at(115, 4)], [0, 0]), ([9], [at(100, 10)], None), ([8], [at(50, 9)], [2, 4])]
    df = spark.createDataFrame(rows, "rids array<long>, ats array<long>, runs array<int>").coalesce(1)
    out = {r.rid: r.ranges for r in suffix._gathered(df).collect()}
    assert out == {7: [0, 14, 20, 21, 26, 27], 8: [52, 54], 9: [100, 115]}
    assert suffix._gathered(df.limit(0)).count() == 0


def test_lookup_makes_no_row_for_each_segment(spark):
    """Segments stay packed until a text's windows are one row."""
    df = spark.createDataFrame([(i, "abcdefgh" * 40) for i in range(50)], SCHEMA)
    out = suffix.repeated_windows(df, "doc_id", "text", 30, 8)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.doc_id for r in df.join(out, df.doc_id == out.rid).collect()) == list(range(50))
