"""Language models against plain Kneser-Ney, and held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from sheetlens.llm import langid
from sheetlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"


def plain(texts, alphabet):
    """Interpolated Kneser-Ney on strings, by its formula."""
    grams = Counter()
    for t in texts:
        s = "  " + "".join(chr(c) for c in langid.characters(t))
        grams.update(s[i:i + 4] for i in range(len(s) - 3))
    levels = [grams]
    for k in (3, 2, 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    d = [langid.discount_of(sum(v == 1 for v in lv.values()), sum(v == 2 for v in lv.values())) for lv in levels]

    def chance(g):
        if not g:
            return 1 / alphabet
        lv = levels[4 - len(g)]
        same = {x: n for x, n in lv.items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        lower = chance(g[1:])
        return (max(lv[g] - d[4 - len(g)], 0) + d[4 - len(g)] * len(same) * lower) / total if total else lower

    return chance


def test_model_is_kneser_ney(spark):
    texts = ["Abba baba, cab! 12 bad", "a bad cab ébb", "dab " * 5]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    model = langid.learn(df, "text", "lang")["x"]
    alphabet = len({c for t in texts for c in langid.characters(t).tolist()})
    chance = plain(texts, alphabet)
    probe = [" bab", "abba", "zzzz", "dab ", "  ab", "zab ", "cabé"]
    keys = np.array([int.from_bytes(b"".join(ord(c).to_bytes(2, "big") for c in g), "big") for g in probe], dtype=np.uint64)
    np.testing.assert_allclose(model.log2(keys), [math.log2(chance(g)) for g in probe], rtol=1e-9)
    every = {c for t in texts for c in langid.characters(t).tolist()}
    full = np.array([int.from_bytes(b"".join(ord(c).to_bytes(2, "big") for c in "bab") + c.to_bytes(2, "big"), "big")
                     for c in every], dtype=np.uint64)
    assert abs((2.0 ** model.log2(full)).sum() - 1) < 1e-9


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang").collect()}
    out = QUERIES["op6_kneser_ney_langid"](spark, SF001).collect()
    assert len(out) == len(docs)
    held = [r for r in out if r.held_out]
    assert 0.25 < len(held) / len(out) < 0.42
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_edges(spark):
    rnd = random.Random(1)
    words = {"aa": ["kala", "kivi", "talo", "puu"], "bb": ["house", "tree", "stone", "fish"]}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(30)), k) for i in range(60) for k in [("aa", "bb")[i % 2]]]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "123 !!", None), (103, "KALA kivi " * 3, None), (None, "stone fish tree", "bb"),
             (103, "KALA kivi " * 3, None)]
    out = defaultdict(list)
    for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect():
        out[r.doc_id].append(r)
    assert [out[k][0].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "aa", "bb"]
    assert out[102][0].score == 0 and len(out[103]) == 2
    odd = spark.createDataFrame(rows + [(200, "zzz qqq xxx " * 20, None)], SCHEMA)
    assert langid.identify(odd).where("doc_id = 200").first().rejected
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc", None)], SCHEMA)).first().lang_pred == "und"
    clash = spark.createDataFrame([(2, "abc", "x", 1, 2.0)], SCHEMA + ", _p int, score double")
    assert langid.identify(clash).first()._p == 1


def test_no_string_is_left_out(spark):
    """A rare string of a large language counts, whatever the shards it lies in."""
    texts = ["abcd bcda cdab " * 40_000, "qrst zuvw", "zuvx"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    chance = plain(texts, len({c for t in texts for c in langid.characters(t).tolist()}))
    probe = ["qrst", "zuvw", "zuvx", "zuvq", "abcd", " qrs", "uvw ", "qqst"]
    keys = np.array([int.from_bytes(b"".join(ord(c).to_bytes(2, "big") for c in g), "big") for g in probe], dtype=np.uint64)
    for shard, pack in ((langid.SHARD, langid.PACK), (3, 4)):
        model = langid.learn(df, "text", "lang", shard, pack)["x"]
        np.testing.assert_allclose(model.log2(keys), [math.log2(chance(g)) for g in probe], rtol=1e-9)


def test_calibration_on_whole_texts_of_every_language(spark):
    """A long document's cross-entropy is that of its whole text, and a rare language has its own limit."""
    rnd = random.Random(3)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(5))
    texts = lambda letters: " ".join(word(letters) for _ in range(40))
    rows = [(i, texts("abcde"), "aa") for i in range(300)] + [(1000 + i, texts("klmno"), "bb") for i in range(6)]
    rows += [(2000 + i, ("xyxy " * 500) + texts("uvwqr") * 20, "cc") for i in range(12)]
    rows += [(5000, "qzj wxk " * 40 + texts("klmno"), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in langid.identify(df, calibrated=10).collect()}
    assert out[5000].lang_pred == "bb" and out[5000].rejected
    train = df.where("lang is not null")
    models = langid.learn(train, "text", "lang")
    own = langid.entropies([r[1] for r in rows if r[2] == "cc"], models)[:, 2]
    mid = np.median(own)
    _, limits = langid._calibration(train, "text", "lang", "doc_id", models, 10_000)
    np.testing.assert_allclose(limits[2], mid + 5 * max(1.4826 * np.median(np.abs(own - mid)), 0.05))


def test_letters_of_every_plane():
    assert len(langid.characters(chr(0x32001) + chr(0x20001))) == 4 and not len(langid.characters(chr(0x1F600)))
