"""Weak labels: the vote model against plain arithmetic, accuracy against the labels, defined cases."""

import itertools
import random

import numpy as np
import pytest

from sheetlens.llm import quality
from sheetlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def test_error_rates_are_recovered():
    """Votes drawn from known error rates: expectation maximisation finds them, and the posteriors follow Bayes."""
    rng = np.random.default_rng(1)
    true = np.array([[0.02, 0.9], [0.05, 0.7], [0.01, 0.6], [0.1, 0.8]])
    bad = rng.random(40_000) < 0.2
    votes = rng.random((40_000, 4)) < np.where(bad[:, None], true[:, 1], true[:, 0])
    counts = {}
    for p in votes @ (1 << np.arange(4)):
        counts[int(p)] = counts.get(int(p), 0) + 1
    rates, post = quality.expectation_maximisation(counts, 4, rounds=500)
    assert np.abs(rates - true).max() < 0.03
    for p in post:
        v = np.array([p >> k & 1 for k in range(4)], dtype=bool)
        like = [np.prod(np.where(v, rates[:, c], 1 - rates[:, c])) for c in (0, 1)]
        assert post[p] == pytest.approx(0.2 * like[1] / (0.2 * like[1] + 0.8 * like[0]), abs=0.05)
    assert quality.expectation_maximisation({}, 3)[1] == {}


def test_accuracy_against_the_labels(spark):
    labels = {r.doc_id: (r.quality == 0, r.toxic == 1) for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    out = {r.doc_id: r for r in QUERIES["op2_weak_label_quality"](spark, SF001).collect()}
    assert len(out) == 1000
    sound = [d for d, (q, t) in labels.items() if not q and not t]
    junk = [d for d, (q, _) in labels.items() if q]
    abuse = [d for d, (_, t) in labels.items() if t]
    assert sum(out[d].kept for d in sound) >= 0.99 * len(sound)
    assert sum(not out[d].kept for d in junk) >= 0.97 * len(junk)
    assert sum(not out[d].kept for d in abuse) >= 0.8 * len(abuse)   # few labelled in the rarer languages here
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in out.values())


def test_votes_by_kind_of_fault():
    flags = quality._Flags(frozenset({"zork", "blab-"}))
    prose = "The quick brown fox, which had seen better days, sat down. It thought about the long road home and sighed."

    def votes(t):
        from collections import Counter
        w = t.split()
        j, a, _ = quality.signals(w, Counter(w), flags)
        return ({n for k, n in enumerate(quality.JUNK) if j >> k & 1}, {n for k, n in enumerate(quality.ABUSE) if a >> k & 1})

    assert votes(prose) == (set(), set()) == votes("")
    words = prose.split()
    assert "symbols" in votes(" ".join(w + "***" for w in words))[0]
    assert {"marks", "capitals"} <= votes(" ".join(w.upper() + "!!" for w in words))[0]
    assert "bars" in votes(" | ".join(words))[0]
    assert {"repeats", "one_word"} <= votes("spam " * 100)[0]
    assert votes(prose + " You idiot. Zork, blabber!")[1] == {"insult", "listed_word", "listed_start", "two_hits"}


def test_list_is_learned_from_labels(spark):
    rnd = random.Random(2)
    stems, ends = ["river", "stone", "cloud", "field", "house", "brook"], ["", "s", "let", "side", "bank", "fall", "way", "ton"]
    rows, labels = [], []
    for i in range(300):
        ws = [f"{rnd.choice(stems)}{rnd.choice(ends)}" for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            ws[rnd.randrange(30)] = rnd.choice(["gnarfus", "gnarfen", "Gnarfig!"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    listed = quality.learn_list(docs, lab, "text", "doc_id")
    assert {"gnar-", "gnarf-"} <= listed and not listed & {"river", "stones", "rive-"}
    out = {r.doc_id: r.kept for r in quality.classify(docs, lab).collect()}
    assert all(out[i] for i in out if i % 6) and sum(not out[i] for i in out) >= 20   # few labels: one sign alone is weak


def test_edges(spark):
    assert quality.classify(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Fine words here."), (4, "Fine words here."), (None, "a b c"), (5, "x" * 200_000),
            (6, "!!! ??? ***")]
    out = quality.classify(spark.createDataFrame(rows, SCHEMA), none).collect()
    assert len(out) == len(rows) and len({(r.score, r.kept) for r in out if r.doc_id == 4}) == 1
    clash = spark.createDataFrame([(1, "a", 7, "k")], SCHEMA + ", junk int, rid string")
    r = quality.classify(clash).first()
    assert r.rid == "k" and 0 <= r.junk <= 1
    assert list(itertools.islice(quality.classify(clash).columns, 3)) == ["doc_id", "text", "rid"]


def test_rare_words_of_abuse_are_tested_before_common_ones(spark):
    """More common words than any list holds do not push out an insult of a few documents, however many are labelled."""
    common = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(5000))
    rows = [(i, (common if i < 40 else "plain prose of some words") + (" gnarfusal" if i < 5 else "")) for i in range(30_000)]
    labels = [(i, int(i < 20 or i % 20 == 0)) for i, _ in rows]
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    listed = quality.learn_list(docs, lab, "text", "doc_id")
    assert "gnarfusal" in listed and not listed & {"plain", "prose", "aaa"}


def test_few_words_at_every_length():
    from collections import Counter
    paragraph = " ".join(f"w{k}" for k in range(30)).split()
    rnd = random.Random(5)
    long_prose = [f"w{int(rnd.paretovariate(0.3))}" for _ in range(400_000)]
    few = 1 << quality.JUNK.index("few_words")
    for words, wanted in ((paragraph * 90, True), (paragraph * 110, True), (paragraph * 3000, True), (long_prose, False)):
        assert bool(quality.signals(words, Counter(words), quality._Flags(frozenset()))[0] & few) == wanted


def test_votes_are_taken_once(spark, tmp_path):
    """Every text is looked at for faults once (and again only if it trains), and rows alike or without id get the same."""
    seen, rnd = str(tmp_path), random.Random(4)
    rows = [(k, " ".join(rnd.choice(["river", "Stone,", "cloud", "FIELD!!", "x***"]) for _ in range(k % 40))) for k in range(300)]
    rows += [rows[7], rows[7], (None, rows[8][1]), (None, None), (400, None), (400, "")]
    df = spark.createDataFrame(rows, SCHEMA)

    def counted(words, counts, flags, own=quality.signals):
        import os
        import tempfile
        os.close(tempfile.mkstemp(dir=seen)[0])
        return own(words, counts, flags)

    own, quality.signals = quality.signals, counted
    try:
        out = quality.classify(df, trained=20).collect()
    finally:
        quality.signals = own
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(rows, key=str)
    assert all(r.score is not None and r.junk_votes is not None for r in out)
    assert len({tuple(r)[2:] for r in out if not r.text}) == 1 and len({tuple(r) for r in out if r.doc_id == 7}) == 1
    assert len(rows) <= len(list(tmp_path.iterdir())) < 1.5 * len(rows)
