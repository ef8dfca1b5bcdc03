"""Language identification by interpolated Kneser-Ney character models.

A text becomes lower-case letters with single blanks between words.  Every language
has a model of order four: counts of four-character strings over all its training
documents are added up in Spark, and the lower orders follow from them there, as
Kneser-Ney smoothing asks for the number of different characters before a string and not
for its frequency.  A four-character string is a 64-bit key, and a model is sorted arrays
of keys with their counts, searched by bisection.

The language with the lowest cross-entropy per character is chosen.  Confidence is a
softmax of the cross-entropies whose temperature is fitted on training documents, and a
text is marked as rejected if its cross-entropy is above what nearly all training
documents of that language have.

No string is left out.  The arrays are cut between contexts into shards, and shards are
broadcast in packs of about ``PACK`` strings: the driver holds one pack at a time, and a
task at most ``HELD`` of them, reading the others again from its executor's disk.

Bounds: the two calibrations use about ``calibrated`` training documents, equally many of
each language as far as it has them and never none, whole texts.  Counts and predictions
cover all documents.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.common import own_names, slices, written

ORDER = 4
SHARD = 1 << 18       # strings of a shard, more only where one context has more
PACK = 1 << 20        # strings of a pack
HELD = 4              # packs a task holds at once
CALIBRATED = 6000
UNKNOWN = "und"
_LUT: list[np.ndarray] = []
_PACKS: OrderedDict[str, list[tuple[np.ndarray, ...]]] = OrderedDict()


def _table() -> np.ndarray:
    """Code point -> lower-case letter, or a blank; letters beyond 16 bits share a private range."""
    if not _LUT:
        t = np.full(0x110000, 32, dtype=np.uint16)
        for c in range(0x10000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
        wide = np.arange(0x10000, 0x110000)
        letters = np.fromiter((chr(c).isalpha() for c in wide.tolist()), dtype=bool, count=len(wide))
        t[wide[letters]] = 0xE000 + wide[letters] % 6400
        _LUT.append(t)
    return _LUT[0]


def characters(text: str) -> np.ndarray:
    """Letters of a text with single blanks between words, a blank before and after; empty if it has no letter."""
    x = _table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (x != 32).any():
        return x[:0]
    x = np.concatenate([[np.uint16(32)], x, [np.uint16(32)]])
    return x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]


def keys(x: np.ndarray) -> np.ndarray:
    """The four-character strings that end at each character after the first; blanks stand before the text."""
    p = np.concatenate([np.full(2, 32, dtype=np.uint16), x]).astype(np.uint64)
    return (p[:-3] << np.uint64(48)) | (p[1:-2] << np.uint64(32)) | (p[2:-1] << np.uint64(16)) | p[3:]


class Pack:
    """Shards that are broadcast together."""

    def __init__(self, spark, shards: list[tuple[np.ndarray, np.ndarray, float]]):
        self.name = uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast(shards)

    def shard(self, k: int) -> tuple[np.ndarray, ...]:
        """Strings, discounted counts, contexts, their totals, and what the discounts leave to the lower order."""
        if self.name not in _PACKS:
            while len(_PACKS) >= HELD:
                _PACKS.popitem(last=False)
            _PACKS[self.name] = [_prepared(*x) for x in self.sent.value]
            self.sent.__dict__.pop("_value", None)  # it stays on disk
        _PACKS.move_to_end(self.name)
        return _PACKS[self.name][k]


def _prepared(grams: np.ndarray, counts: np.ndarray, d: float) -> tuple[np.ndarray, ...]:
    ctx, first = np.unique(grams >> np.uint64(16), return_index=True)
    kinds = np.diff(np.append(first, len(grams)))
    return grams, np.maximum(counts - d, 0), ctx, np.add.reduceat(counts.astype(float), first), d * kinds


class Model:
    """One language: for each order the shards of its strings (first context, pack, place in it)."""

    def __init__(self, levels: list[list[tuple[int, Pack, int]]], alphabet: int):
        self.levels = [sorted(x, key=lambda s: s[0]) for x in levels]
        self.base = 1.0 / max(alphabet, 1)

    def log2(self, wanted: np.ndarray) -> np.ndarray:
        """log2 of the chance of the last character of each string after the others."""
        p = np.full(len(wanted), self.base)
        for length, shards in enumerate(self.levels, 1):
            part = wanted & np.uint64((1 << (16 * length)) - 1) if length < ORDER else wanted
            context = part >> np.uint64(16)
            which = np.searchsorted(np.array([s[0] for s in shards], dtype=np.uint64), context, side="right") - 1
            for i in np.unique(which[which >= 0]):
                grams, counts, ctx, total, left = shards[i][1].shard(shards[i][2])
                at_ = np.flatnonzero(which == i)
                at, known = _find(grams, part[at_])
                c, seen = _find(ctx, context[at_])
                up = np.where(known, counts[at], 0.0)
                p[at_] = np.where(seen, (up + left[c] * p[at_]) / total[c], p[at_])
        return np.log2(p)


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def discount_of(once: int, twice: int) -> float:
    """Kneser-Ney's discount from the numbers of strings seen once and twice."""
    return min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5


def learn(df: DataFrame, text: str, lang: str, shard: int = SHARD, pack: int = PACK) -> dict[str, Model]:
    """A model for each language of ``df``, which holds the training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                k, n = _add(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.view(np.int64)),
                                                  pa.array(n)], names=["lang", "k", "n"])
            held.clear()

        for b in slices(batches):
            texts: dict[str, list[np.ndarray]] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = characters(t)
                if len(x):
                    texts.setdefault(name, []).append(keys(x))
            for name, ks in texts.items():
                k, n = np.unique(np.concatenate(ks), return_counts=True)
                held.setdefault(name, []).append((k, n))
                size += len(k)
                if len(held[name]) > 16:
                    held[name] = [_add(held[name])]
            if size > 4_000_000:
                yield from out()
                size = 0
        yield from out()

    grams = (df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(lang, text)
               .mapInArrow(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")))
    grams = grams.persist()  # read once an order; a lost part is counted again from the documents
    levels = [grams.withColumn("o", F.lit(ORDER))]
    for length in range(ORDER - 1, 0, -1):  # strings of ``length`` characters, by the different characters before each
        short = F.col("k").bitwiseAND(F.lit((1 << (16 * length)) - 1))
        levels.append(levels[-1].groupBy("lang", short.alias("k")).agg(F.count(F.lit(1)).alias("n"))
                      .withColumn("o", F.lit(length)))
    strings = levels[0]
    for x in levels[1:]:
        strings = strings.unionByName(x)
    strings = written(strings, "strings")
    grams.unpersist()
    sums = strings.groupBy("lang", "o").agg(  # one row a language and order
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()
    alphabet = strings.where("o = 1").select("k").distinct().count()
    discounts = {(r["lang"], r["o"]): discount_of(r["one"], r["two"]) for r in sums}
    parts = 8 + sum(r["n"] for r in sums) // pack
    found: dict[str, list[list[tuple[int, Pack, int]]]] = {name: [[] for _ in range(ORDER)] for name, _ in sorted(discounts)}
    held: list[tuple[str, int, int, tuple[np.ndarray, np.ndarray, float]]] = []

    def send() -> None:
        one = Pack(df.sparkSession, [x[3] for x in held])
        for k, (name, o, first, _) in enumerate(held):
            found[name][o - 1].append((first, one, k))
        held.clear()

    size = 0
    for r in _shards(strings, shard).coalesce(parts).toLocalIterator():
        k, n = np.frombuffer(r["k"], np.uint64), np.frombuffer(r["n"], np.int64)
        held.append((r["lang"], r["o"], int(k[0]) >> 16, (k, n, discounts[r["lang"], r["o"]])))
        size += len(k)
        if size >= pack:
            send()
            size = 0
    if held:
        send()
    return {name: Model(x, alphabet) for name, x in found.items()}


def _shards(strings: DataFrame, most: int) -> DataFrame:
    """(lang, o, k, n): sorted strings of an order and their counts as bytes, cut between contexts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(key: tuple[str, int], k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()),
                                               pa.array([k.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())],
                                              names=["lang", "o", "k", "n"])

        def taken(key: tuple[str, int]) -> tuple[np.ndarray, np.ndarray]:
            parts = held.pop(key)
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

        for b in batches:
            names = b.column(0).dictionary_encode()
            code, o = names.indices.to_numpy(), b.column(1).to_numpy()
            k, n = b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy()
            edges = np.flatnonzero((code[1:] != code[:-1]) | (o[1:] != o[:-1])) + 1
            for i, j in zip([0, *edges], [*edges, len(k)]):
                if i == j:
                    continue
                key = (names.dictionary[int(code[i])].as_py(), int(o[i]))
                for other in [x for x in held if x != key]:
                    yield out(other, *taken(other))
                held.setdefault(key, []).append((k[i:j], n[i:j]))
                if sum(len(p[0]) for p in held[key]) >= most:
                    ks, ns = taken(key)
                    context = ks >> np.uint64(16)
                    whole = int(np.searchsorted(context, context[-1]))  # the last context may go on
                    if whole:
                        yield out(key, ks[:whole], ns[:whole])
                    held[key] = [(ks[whole:], ns[whole:])]
        for key in list(held):
            yield out(key, *taken(key))

    context = F.shiftrightunsigned("k", 16)
    return (strings.select("lang", "o", "k", "n").repartitionByRange("lang", "o", context)
                   .sortWithinPartitions("lang", "o", context, "k").mapInArrow(cut, "lang string, o int, k binary, n binary"))


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)


def entropies(texts: list[str | None], models: dict[str, Model]) -> np.ndarray:
    """Cross-entropy per character (rows: texts, columns: languages in order); NaN without a letter."""
    out = np.full((len(texts), len(models)), np.nan)
    todo, ks = [], []
    for i, t in enumerate(texts):
        x = characters(t) if t else ()
        if len(x):
            todo.append(i)
            ks.append(keys(x))
    if not todo or not models:
        return out
    sizes = np.array([len(k) for k in ks])
    unique, inverse = np.unique(np.concatenate(ks), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for j, m in enumerate(models.values()):
        out[todo, j] = -np.add.reduceat(m.log2(unique)[inverse], starts) / sizes
    return out


def _softmax(h: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-(h - h.min(1, keepdims=True)) * temperature)
    return e / e.sum(1, keepdims=True)


def calibrate(h: np.ndarray, langs: list[str], names: list[str], sizes: dict[str, int]) -> tuple[float, np.ndarray]:
    """From the cross-entropies of a sample of each language: the softmax temperature with the least log loss over
    all documents (``sizes`` of each language), and per language the cross-entropy above which a text is rejected,
    five robust deviations above the median of its documents."""
    ok = ~np.isnan(h).any(1) & np.array([x in names for x in langs], dtype=bool) if len(h) else np.zeros(0, bool)
    if not ok.any():
        return 4.0, np.full(len(names), np.inf)
    h, y = h[ok], np.array([names.index(x) for x, k in zip(langs, ok) if k])
    weight = np.array([sizes.get(x, 0) for x in names])[y] / np.bincount(y, minlength=len(names))[y]
    grid = [0.5, 1, 2, 4, 8, 16, 32]
    loss = [np.average(-np.log(np.maximum(_softmax(h, t)[np.arange(len(y)), y], 1e-6)), weights=weight) for t in grid]
    limits = []
    for j in range(len(names)):
        own = h[y == j, j]
        mid = np.median(own) if len(own) else np.inf
        limits.append(mid + 5 * max(1.4826 * np.median(np.abs(own - mid)), 0.05) if len(own) else np.inf)
    return grid[int(np.argmin(loss))], np.array(limits)


def _calibration(train: DataFrame, text: str, lang: str, doc_id: str, models: dict[str, Model],
                 calibrated: int) -> tuple[float, np.ndarray]:
    """``calibrate`` on whole texts, about equally many of each language and at least one."""
    names = list(models)
    mark = F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(text)), 24)
    rows = train.where(F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.col(text).alias("t"), mark.alias("h"))
    groups = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h")).collect()  # one row a language
    sizes = {r["l"]: r["n"] for r in groups}
    if not names or not sizes:
        return 4.0, np.full(len(names), np.inf)
    if sum(sizes.values()) > calibrated:
        share = max(calibrated // len(sizes), 1)
        most = F.create_map(*[F.lit(x) for r in groups for x in
                              (r["l"], max(r["h"], min((1 << 40) - 1, (share << 40) // r["n"])))])
        rows = rows.where(F.col("h") <= F.element_at(most, F.col("l")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            h = entropies(b.column(1).to_pylist(), models)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(h.tolist(), pa.list_(pa.float64()))],
                                             names=["l", "h", "e"])

    found = rows.mapInArrow(scan, "l string, h long, e array<double>")
    found = found.dropDuplicates(["l", "h"]).orderBy("l", "h").toArrow()  # about ``calibrated`` rows of one number a language
    e = np.array(found["e"].to_pylist(), dtype=float).reshape(found.num_rows, len(names))
    return calibrate(e, found["l"].to_pylist(), names, sizes)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3 (a null id: as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def identify(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
             calibrated: int = CALIBRATED) -> DataFrame:
    """``df`` with ``held_out``, ``lang_pred``, ``score`` (confidence, 0 to 1), ``entropy``
    (bits per character) and ``rejected`` (too unlike the training texts of the language).

    Models are learned from the documents that are not held out and have a text and a
    language; language, source and id are no input of a prediction.  A null text or one
    without a letter is ``und`` with score 0; without any training document every text is.
    Ties go to the first language in code point order.  Input columns with the names of the
    new ones are replaced."""
    new = ["held_out", "lang_pred", "score", "entropy", "rejected"]
    base = df.drop(*new)
    train = base.where(~held_out(F.col(doc_id)) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    models = learn(train, text, lang)
    temperature, limits = _calibration(train, text, lang, doc_id, models, calibrated)
    names = list(models)
    s = own_names(base, ["_p"])["_p"]

    @F.pandas_udf("lang_pred string, score double, entropy double, rejected boolean")
    def predict(texts):
        import pandas as pd
        parts = []
        for i in range(0, len(texts), 256):
            some_ = texts.iloc[i:i + 256].tolist()
            h = entropies(some_, models)
            rows: list[tuple] = [(UNKNOWN, 0.0, None, False)] * len(some_)
            if names:
                known = np.flatnonzero(~np.isnan(h).any(1))
                p = _softmax(h[known], temperature)
                for r, i_, best in zip(p, known, h[known].argmin(1) if len(known) else []):
                    rows[i_] = (names[best], float(r[best]), float(h[i_, best]), bool(h[i_, best] > limits[best]))
            parts += rows
        return pd.DataFrame(parts, columns=["lang_pred", "score", "entropy", "rejected"])

    out = base.withColumn("held_out", held_out(F.col(doc_id))).withColumn(s, predict(F.col(text)))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], "held_out", F.col(f"{s}.*"))
