"""Quality classifier from weak labels.

Two faults are looked for, junk (a text that isn't prose) and abuse.  For each, a
set of overlapping heuristic labellers votes on every document.  The votes are
counted by pattern over all documents (at most 2**12 patterns), and expectation
maximisation over the counts estimates every labeller's error rates in both
classes and the posterior of each pattern (Dawid and Skene's model).  The
posteriors are the labels on which a hashed linear scorer (logistic regression over
hashed words, word beginnings and shapes) is trained; the scorer decides.

One labeller pair for abuse uses a word list that is learned: words and word
beginnings that labelled abusive documents have and others lack.

Bounds: the list is learned from ``labelled`` labelled documents at most, the
scorer from ``trained`` documents at most, both taken by a hash of the id.  Votes,
counts, error rates and scores cover all documents.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.common import own_names, slices, with_arrays, written

LABELLED = 40_000
TRAINED = 10_000
SLOTS = 1 << 18
SUPPORT = 3           # labelled abusive documents that a listed word must be in
FALSE = 0.2           # share of the learned words that may be there by chance
BLOCK = 3000          # words over which different ones are counted
SMALL = 0.1           # weights of the scorer nearer to 0 are left out

#: English insults, a short public list; other words are learned from labels.
INSULTS = frozenset("idiot moron stupid scum trash worthless pathetic disgusting loser clown "
                    "imbecile dumbass retard bastard asshole bitch".split())
STRIP = ".,;:!?\"'()[]{}*$%#&«»„“”…-"

JUNK = ("symbols", "some_symbols", "marks", "capitals", "bars", "repeats", "one_word", "few_words", "odd_chars",
        "not_prose")
ABUSE = ("insult", "listed_word", "listed_start", "two_hits")
COLUMNS = ["junk_votes", "abuse_votes", "junk_weak", "abuse_weak", "junk", "abuse", "score", "kept"]  # what the operator adds


def _words(text: str) -> list[str]:
    return text.split()


class _Flags(dict):
    """Per word: 1 symbol run at the end, 2 doubled mark at the end, 4 capitals,
    8 no letter or digit, 16 insult, 32 listed word, 64 listed beginning.  Long
    words, which seldom come again, are not kept."""

    def __init__(self, listed: frozenset[str]):
        self.listed = listed
        self.starts = frozenset(w[:-1] for w in listed if w[-1] == "-")

    def __missing__(self, w: str) -> int:
        if w.isalpha():
            core, f = w.lower(), 0
        else:
            core = w.strip(STRIP).lower()
            end = w[-3:]
            f = 1 if len(w) > 3 and end[0] == end[1] == end[2] and not end[0].isalnum() else 0
            f |= 2 if len(w) > 2 and w[-1] == w[-2] and w[-1] in "!?" else 0
            f |= 8 if not any(map(str.isalnum, w)) else 0
        if core:
            f |= 4 if len(core) > 1 and core.upper() in w and core.upper() != core else 0
            f |= 16 if core in INSULTS else 0
            f |= 32 if core in self.listed else 0
            if len(core) > 4 and (core[:4] in self.starts or (len(core) > 5 and core[:5] in self.starts)):
                f |= 64
        if len(w) < 13:
            if len(self) > 100_000:
                self.clear()
            self[w] = f
        return f


def starts(core: str) -> list[str]:
    """Word beginnings of 4 and 5 letters, marked as such."""
    return [core[:k] + "-" for k in (4, 5) if len(core) > k]


def signals(words: list[str], counts: Counter, flags: _Flags) -> tuple[int, int, tuple[float, ...]]:
    """Vote patterns for junk and abuse (one bit a labeller, set: at fault), and the
    shares of symbol runs, marks, capitals, bars, repeats, the top word and new words."""
    n = len(words)
    if not n:
        return 0, 0, (0.0,) * 6 + (1.0,)
    sums = [0] * 7
    hits = 0
    for f, c in zip(map(flags.__getitem__, counts), counts.values()):
        if f:
            for k in range(7):
                if f >> k & 1:
                    sums[k] += c
            hits += f >= 16
    sym, marks, caps, bars = (sums[k] / n for k in range(4))
    same = sum(map(operator.eq, words, words[1:])) / n
    top = max(counts.values()) / n if n >= 20 else 0.0
    new = len(counts) / n if n >= 30 else 1.0
    if n > BLOCK:  # long prose repeats its words: the mean share of blocks of about the same length
        cuts = [n * k // -(-n // BLOCK) for k in range(-(-n // BLOCK) + 1)]
        new = sum(len(set(words[i:j])) / (j - i) for i, j in zip(cuts, cuts[1:])) / (len(cuts) - 1)
    odd = 0.0
    if sym + marks + bars > 0:
        letters = "".join(words)
        odd = 1 - sum(map(str.isalnum, letters)) / len(letters)
    some = min(1.0, n / 20)  # shares of a short text say less
    fault = (sym >= 0.2, sym >= 0.05, marks >= 0.2, caps >= 0.4, bars >= 0.15, same * some >= 0.15, top >= 0.3,
             new <= 0.1, odd >= 0.2,
             sym >= 0.02 or marks >= 0.05 or caps * some >= 0.25 or bars * some >= 0.05 or (same >= 0.05 and same * n > 3.5))
    abuse = (sums[4] > 0, sums[5] > 0, sums[6] > 0, hits >= 2)
    return (sum(int(v) << k for k, v in enumerate(fault)), sum(int(v) << k for k, v in enumerate(abuse)),
            (sym, marks, caps, bars, same, top, new))


def expectation_maximisation(counts: dict[int, int], labellers: int, rounds: int = 50) -> tuple[np.ndarray, dict[int, float]]:
    """Error rates of the labellers and the posterior of each vote pattern.

    ``counts``: documents by pattern.  Rates come as (labellers, 2): the chance to vote
    fault in a sound and in a faulty document, with a weak prior (one document of a
    hundred); the start is that any vote makes a fault."""
    if not counts:
        return np.full((labellers, 2), 0.5), {}
    pats = np.array(sorted(counts), dtype=np.int64)
    weight = np.array([counts[p] for p in pats], dtype=float)
    votes = (pats[:, None] >> np.arange(labellers)) & 1
    post = np.where(votes.any(1), 0.9, 0.01)
    rates = np.empty((labellers, 2))
    for _ in range(rounds):
        for c, p in ((0, 1 - post), (1, post)):
            rates[:, c] = ((weight * p) @ votes + (0.01, 1.0)[c]) / ((weight * p).sum() + (1.0, 2.0)[c])
        prior = ((weight * post).sum() + 1) / (weight.sum() + 20)
        score = np.log(prior) - np.log1p(-prior) + votes @ np.log(rates[:, 1] / rates[:, 0]) + \
            (1 - votes) @ np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))
        new = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return rates, dict(zip(pats.tolist(), post.tolist()))


def _sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows, by a hash of ``key`` (the same rows in every run)."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(1 << 20)) < int((1 << 20) * most * 0.97 / n))


def learn_list(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, most: int = LABELLED) -> frozenset[str]:
    """Words and word beginnings of labelled abusive documents that other labelled ones
    lack: in at least ``SUPPORT`` of the former, 150 times as often there, and in so many that
    at most ``FALSE`` of the list is there by chance (by each word's own counts, in any
    language; Benjamini and Hochberg's rule over all words tested)."""
    rows = _sampled(labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic"), "doc_id", most)
    rows = F.broadcast(rows.select(F.col("doc_id").alias("_id"), "toxic"))  # at most ``most`` rows of two numbers
    marked = docs.where(F.col(text).isNotNull()).join(rows, docs[doc_id].cast("long") == F.col("_id")).select("toxic", text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, list[int]] = {}
        seen = [0, 0]

        def out() -> pa.RecordBatch:
            rows = [("", *seen), *((t, *c) for t, c in count.items())]
            count.clear()
            seen[:] = [0, 0]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                               pa.array([r[1] for r in rows], pa.int64()),
                                               pa.array([r[2] for r in rows], pa.int64())], names=["t", "sound", "bad"])

        for b in slices(batches):
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cores = {w.strip(STRIP).lower() for w in set(_words(t))} - {""}
                side = int(bool(toxic))
                seen[side] += 1
                for token in cores | {s for c in cores for s in starts(c)}:
                    count.setdefault(token, [0, 0])[side] += 1
            if len(count) > 150_000:
                yield out()
        yield out()

    totals = marked.mapInArrow(scan, "t string, sound long, bad long").groupBy("t").agg(
        F.sum("sound").alias("sound"), F.sum("bad").alias("bad"))
    totals = totals.where((F.col("t") == "") | (F.col("bad") >= SUPPORT)).persist()
    none = F.col("t") == ""
    whole = totals.agg(F.sum(F.when(none, F.col("sound"))).alias("sound"), F.sum(F.when(none, F.col("bad"))).alias("bad"),
                       F.count_if(~none).alias("tested")).first()
    found = frozenset()
    if whole["bad"] and whole["sound"]:
        share = whole["bad"] / (whole["bad"] + whole["sound"])
        bad, sound = F.col("bad"), F.col("sound")
        often = bad * (whole["sound"] / whole["bad"]) >= 150 * (sound + F.when(bad >= 5, 0.5).otherwise(0.0))
        # Chernoff's bound on the chance that a word of bad + sound documents has so many abusive ones
        unlikely = bad * F.ln(bad / ((bad + sound) * share)) + F.when(
            sound > 0, sound * F.ln(sound / ((bad + sound) * (1 - share)))).otherwise(0.0)
        rows = totals.where(~none & often).select("t", unlikely.alias("u")).orderBy(F.desc("u"), "t").collect()
        chance = [max(whole["tested"], 1) * math.exp(-r["u"]) for r in rows]  # words that chance makes so unlikely
        least = min((r["u"] for k, r in enumerate(rows, 1) if chance[k - 1] <= FALSE * k), default=math.inf)
        found = frozenset(r["t"] for r in rows if r["u"] >= least)  # words of ``most`` documents at most
    totals.unpersist()
    return found


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


class _Starts(dict):
    """Slots of a word's beginnings of four and five letters, by its first six characters."""

    def __init__(self, used: list[bool] | None):
        self.used = used

    def __missing__(self, head: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        core = head.lstrip(STRIP).lower()
        got = self[head] = tuple(k for k in map(_hash, starts(core)) if self.used is None or self.used[k])
        return got


class _Slots(dict):
    """Hashed features of words: a word of less than 13 characters gives itself, its beginnings and the marks at its
    end, a longer one its beginnings.  With ``used`` only slots that have a weight."""

    def __init__(self, used: np.ndarray | None = None):
        self.used = None if used is None else used.tolist()
        self.starts = _Starts(self.used)

    def __missing__(self, w: str) -> tuple[int, ...]:
        if w.isalpha():
            core, got = w.lower(), ()
        else:
            bare = w.rstrip(STRIP)
            core, got = bare.lstrip(STRIP).lower(), self._kept("#" + w[len(bare):][-3:])
        if len(core) > 4:
            got += self.starts[core[:6]]
        if core:
            got += self._kept(core)
        if len(self) > 100_000:
            self.clear()
        self[w] = got
        return got

    def _kept(self, feature: str) -> tuple[int, ...]:
        k = _hash(feature)
        return (k,) if self.used is None or self.used[k] else ()

    def of(self, counts: Counter) -> set[int]:
        """The slots of a text's words."""
        return set().union(*map(self.__getitem__, [w for w in counts if len(w) < 13]),
                           *map(self.starts.__getitem__, {w[:6] for w in counts if len(w) > 12}))


def _shares(shares: tuple[float, ...]) -> list[int]:
    """Hashed bins of the shares, each with those below it (a step function by weights)."""
    out = []
    for name, s in zip(("sym", "marks", "caps", "bars", "same", "top", "old"), (*shares[:6], 1 - shares[6])):
        out += [_hash(f"{name}>{edge}") for edge in (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 0.9) if s >= edge]
    return out


def _marks(junk: int, abuse: int, shares: tuple[float, ...]) -> list[int]:
    """Hashed features of the votes and shares."""
    return ([_hash(f"vote {n}") for k, n in enumerate(JUNK) if junk >> k & 1]
            + [_hash(f"vote {n}") for k, n in enumerate(ABUSE) if abuse >> k & 1] + _shares(shares))


def _scale(n: int) -> float:
    """Value of each of a text's n word features: long texts don't drown the others."""
    return 1 / np.sqrt(max(n, 1))


def _train(sample: DataFrame, listed: frozenset[str], epochs: int = 6) -> np.ndarray:
    """Weights (2, SLOTS + 1) of two logistic regressions on a bounded sample (text,
    posteriors), by AdaGrad in one task; the last weight is the intercept."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_of, flags = _Slots(), _Flags(listed)
        docs, marks, target = [], [], []
        for b in slices(batches):
            for t, j, a in zip(*(b.column(k).to_pylist() for k in range(3))):
                words = _words(t)
                counts = Counter(words)
                docs.append(np.array(sorted(slots_of.of(counts)), dtype=np.int32))
                marks.append(np.array(_marks(*signals(words, counts, flags)), dtype=np.int32))
                target.append((j, a))
        w = np.zeros((2, SLOTS + 1))
        if docs:
            seen = np.bincount(np.concatenate(docs), minlength=SLOTS)
            docs = [d[seen[d] >= 3] for d in docs]
            y = np.array(target)
            square = np.full((2, SLOTS + 1), 1e-3)
            rng = np.random.default_rng(17)
            for _ in range(epochs):
                for i in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 32)):
                    rows = [np.concatenate([docs[k], marks[k], [SLOTS]]) for k in i]
                    sizes = np.array([len(r) for r in rows])
                    value = np.concatenate([np.append(np.full(len(docs[k]), _scale(len(docs[k]))),
                                                      np.ones(len(marks[k]) + 1)) for k in i])
                    flat = np.concatenate(rows)
                    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    slots, inverse = np.unique(flat, return_inverse=True)
                    for c in range(2):
                        z = np.add.reduceat(w[c, flat] * value, begin)
                        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i, c]
                        g = np.bincount(inverse, np.repeat(err, sizes) * value) / len(i) + 1e-4 * w[c, slots]
                        square[c, slots] += g * g
                        w[c, slots] -= 0.3 * g / np.sqrt(square[c, slots])
        w[:, :SLOTS][np.abs(w[:, :SLOTS]) < SMALL] = 0
        used = np.flatnonzero(w.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[0, used]), pa.array(w[1, used])], names=["s", "j", "a"])

    w = np.zeros((2, SLOTS + 1))
    for r in sample.coalesce(1).mapInArrow(fit, "s long, j double, a double").collect():  # at most SLOTS rows
        w[:, r["s"]] = r["j"], r["a"]
    return w


def classify(df: DataFrame, labels: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id",
             labelled: int = LABELLED, trained: int = TRAINED) -> DataFrame:
    """``df`` with ``junk_votes`` and ``abuse_votes`` (bits in the order of ``JUNK`` and
    ``ABUSE``), ``junk_weak`` and ``abuse_weak`` (posteriors), ``junk``, ``abuse`` (the
    scorer's probabilities), ``score`` (1 less the larger) and ``kept`` (score at least 0.5).

    ``labels`` (doc_id, toxic) may be left out; the list is then the public one.  A null
    or blank text gets no votes and is scored like an empty one; repeated rows are scored
    alike; an empty table gives an empty result.  Input columns with the names of the new
    ones are replaced."""
    base = df.drop(*COLUMNS)
    listed = learn_list(base, labels, text, doc_id, labelled) if labels is not None else frozenset()

    def voters():
        flags = _Flags(listed)

        def vote(texts):
            rows = []
            for t in texts:
                words = _words(t or "")
                rows.append(signals(words, Counter(words), flags))
            return [list(c) for c in zip(*rows)]
        return vote

    # a row's key: its id's and text's hash, and a second one of the text alone, which decides all that follows
    key = [F.xxhash64(doc_id, text).alias("rid"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("tid")]
    rows = base.select(*key, F.col(text).alias("_t"))
    votes = written(with_arrays(rows, ["_t"], voters, "junk int, abuse int, shares array<double>").drop("_t"), "votes")
    tables = []
    for col, n in (("junk", len(JUNK)), ("abuse", len(ABUSE))):
        counts = {r[col]: r["n"] for r in votes.groupBy(col).agg(F.count(F.lit(1)).alias("n")).collect()}  # <= 2**n rows
        tables.append(expectation_maximisation(counts, n)[1])
    junk_of, abuse_of = tables

    picked = _sampled(votes, "rid", trained).select("rid", "junk", "abuse").dropDuplicates(["rid"])
    weak = lambda col, t: F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), F.col(col)) \
        if t else F.lit(0.0)
    picked = picked.select("rid", weak("junk", junk_of).alias("j"), weak("abuse", abuse_of).alias("a"))
    sample = (base.select(F.xxhash64(doc_id, text).alias("rid"), F.col(text).alias("_t")).where("_t is not null")
                  .join(F.broadcast(picked), "rid").select("_t", "j", "a"))  # at most ``trained`` rows of three numbers
    w = _train(sample, listed)

    def scorers():
        slots_of = _Slots(w[:, :SLOTS].any(0))
        wj, wa = w[0], w[1]

        def add(texts):
            out = [[], []]
            for t in texts:
                ids = slots_of.of(Counter(_words(t or "")))
                at = np.fromiter(ids, dtype=np.int64, count=len(ids))
                scale = _scale(len(ids))
                for c, v in zip(out, (wj, wa)):
                    c.append(float(v[at].sum() * scale))
            return out
        return add

    @F.pandas_udf("junk_weak double, abuse_weak double, junk double, abuse double")
    def decided(j, a, shares, words_j, words_a):
        import pandas as pd
        out = []
        for x, y, s, zj, za in zip(j.tolist(), a.tolist(), shares, words_j, words_a):
            mark = _marks(x, y, s)
            z = np.clip((zj + w[0][mark].sum() + w[0][SLOTS], za + w[1][mark].sum() + w[1][SLOTS]), -30, 30)
            out.append((junk_of.get(x, 0.0), abuse_of.get(y, 0.0), *(1 / (1 + np.exp(-z))).tolist()))
        return pd.DataFrame(out, columns=["junk_weak", "abuse_weak", "junk", "abuse"])

    # the votes are not taken again: a text's word weights meet them by the key, without the text
    words = with_arrays(rows, ["_t"], scorers, "words_j double, words_a double").drop("_t").dropDuplicates(["rid", "tid"])
    known = words.join(votes.dropDuplicates(["rid", "tid"]), ["rid", "tid"]).withColumn(
        "d", decided("junk", "abuse", "shares", "words_j", "words_a"))
    n = own_names(base, ["_rid", "_tid"])
    known = known.select(F.col("rid").alias(n["_rid"]), F.col("tid").alias(n["_tid"]), F.col("junk").alias("junk_votes"),
                         F.col("abuse").alias("abuse_votes"), "d.junk_weak", "d.abuse_weak", "d.junk", "d.abuse")
    out = base.select("*", key[0].alias(n["_rid"]), key[1].alias(n["_tid"])).join(known, list(n.values()), "left").select(
        *[F.col(f"`{c}`") for c in base.columns], *COLUMNS[:6])
    return (out.withColumn("score", 1 - F.greatest("junk", "abuse")).withColumn("kept", F.col("score") >= 0.5))
