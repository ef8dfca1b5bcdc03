"""Packing: exact ids, gapless offsets, few sequences."""

import random
import zlib

import numpy as np
import pytest

from sheetlens.llm import packing
from sheetlens.llm.queries import QUERIES, RANKS, TOKENIZER

SF001 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def plain_ids(text):
    from tokenizers import Tokenizer
    global _TOK
    if "_TOK" not in globals():
        _TOK = Tokenizer.from_file(TOKENIZER)
    return _TOK.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, out, length=1024):
    seqs, docs = {}, {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= length
    for d, t in rows:
        ids = plain_ids(t)
        p = sorted(docs[d], key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p))) and sum(r.length for r in p) == len(ids)
        assert len(p) == -(-len(ids) // length) and all(r.length == length for r in p[1:])
        for r in p:
            part = np.array(ids[r.start:r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
    return len(seqs), -(-sum(r.length for r in out) // length)


def test_query_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    n, least = check(rows, QUERIES["op3_best_fit_packing"](spark, SF001).collect())
    assert n <= 1.015 * least


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> and <|endoftext|>"), (4, "a" * 30_000), (5, " \n" * 4000), (6, "é😀‍" * 900),
            (7, "word " * 1023), (8, "word " * 1024)]
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), TOKENIZER, RANKS).collect()
    check(rows, out)
    slow = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), TOKENIZER, None).collect()
    crc = lambda x: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in x)
    assert crc(out) == crc(slow)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0
    twice = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x")], SCHEMA)
    assert packing.pack_documents(twice, TOKENIZER).count() == 3
    clash = spark.createDataFrame([(1, "a", 3, "b")], SCHEMA + ", bin int, unit string")
    assert packing.pack_documents(clash, TOKENIZER).first().length == 2


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_open_bins(limit):
    rnd = random.Random(limit)
    bins = packing.OpenBins(100, limit)
    used, opened = {}, []
    for _ in range(3000):
        size = rnd.randint(1, 99)
        fit = [100 - u for b, u in opened if 100 - u >= size]
        name, at = bins.put(size)
        assert used.get(name, 0) == at
        if fit:
            assert 100 - at == min(fit)                        # the fullest bin it fits
        else:
            assert at == 0
        used[name] = at + size
        opened = [(b, u) for b, u in opened if b != name] + ([(name, at + size)] if at + size < 100 else [])
        if len(opened) > limit:                                # the fullest closed
            left = dict(bins.left())
            gone = [b for b, u in opened if b not in left]
            assert len(gone) == 1 and dict(opened)[gone[0]] == max(u for _, u in opened)
            opened = [x for x in opened if x[0] not in gone]
        assert sorted(bins.left()) == sorted(opened)


def test_rounds_merge_what_tasks_leave(spark):
    rnd = random.Random(9)
    cut = spark.createDataFrame([(i, 0, 0, rnd.randint(1, 64), 0) for i in range(6000)],
                                "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.best_fit_pack(cut, length=64, open_bins=50, pieces_per_task=300).collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert len(out) == 6000 and len(seqs) <= 1.12 * sum(r.length for r in out) / 64
