"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of five words (lower case A-Z).  The
hash of a shingle picks one of 256 buckets; the bucket's least hash is stored as
a 16-bit register, the number of its leading zeros (6 bits) and the ten bits
after them.  An empty bucket takes the register of a bucket that a fixed probe
sequence meets first, so two registers agree with probability equal to the Jaccard
similarity at any set size.

Documents with equal sets are one class.  Bands of six registers give candidates:
64 bands miss a pair at similarity 0.75 about three times in 100,000, one at 0.8
less than once in a million.  A candidate whose similarity, estimated from the
registers and corrected for chance collisions, is more than five standard errors
below the threshold is dropped; the others are confirmed on their full sets.

No bucket is expanded into all its pairs.  First every member of a bucket is
compared with the bucket's first member, and components are formed.  Then, where
a bucket still holds several components, the registers of its members outside the
bucket's largest are compared with those of the members of other components, inside
a task, by blocks of at most ``BLOCK`` a side; a finer sketch of 1024 eight-bit
registers decides there which pairs leave the task, each only from the first bucket
that the two share.  Two documents that share a bucket are so either compared or
already in one component: no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.llm.common import bytes_of, drop, own_names, slices, written
from sheetlens.llm.components import components

WORDS = 5
PERCENT = 75
BUCKETS = 256          # 2**8: the first eight bits of a hash
MANTISSA = 10
BANDS, ROWS = 64, 6
MARGIN = 0.15          # above five standard errors of the estimate: sqrt(.75 * .25 / 256) = 0.027
FINE = 1024            # registers of the finer sketch, eight bits each
FINE_MARGIN = 0.06     # above four standard errors: sqrt(.75 * .25 / 1024) = 0.0135
BLOCK = 2048           # members of a bucket, on either side, that a task compares at once
COLLISION = 0.169919487159739093975315012348630288992889  # fixed value: expected collisions, HyperMinHash paper

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                  0x85EBCA77C2B2AE63], dtype=np.uint64)
COLUMNS = ["n_shingles", "component_id", "kept"]  # what the operator adds


class _Words(dict):
    """Hash of a word, kept; emptied when it holds 200,000."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes, words: _Words, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words the whole sequence is one."""
    ws = text.lower().split()  # on bytes: A-Z, and exactly \x20 \x09-\x0D
    n = len(ws)
    h = np.fromiter(map(words.__getitem__, ws), dtype=np.uint64, count=n)
    if n == 0:
        return h
    k = min(n, width)
    s = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        s = (s + h[j:n - k + 1 + j]) * _MULT[j % 5]
    return np.unique(_mix(s))


def _probes(buckets: int) -> np.ndarray:
    """Probe sequences of the empty buckets, longest first part; a fixed rule."""
    return np.random.default_rng(11).integers(0, buckets, (4 * buckets, buckets))


def registers(hashes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a non-empty sorted set of hashes."""
    buckets = probes.shape[1]
    bits = buckets.bit_length() - 1
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # sorted: each bucket's least
    rest = (hashes[first] << np.uint64(bits)) | np.uint64(1)
    top = np.frexp(rest.astype(np.float64))[1]                           # bit length, at most one too high
    top -= (rest >> np.minimum(top - 1, 63).astype(np.uint64)) == 0
    zeros = np.minimum(64 - top, 63)
    after = (rest << (zeros + 1).astype(np.uint64) % np.uint64(64)) >> np.uint64(64 - MANTISSA)
    out = np.zeros(buckets, dtype=np.uint16)
    filled = np.zeros(buckets, dtype=bool)
    out[at[first]] = (zeros.astype(np.uint16) << MANTISSA) | after.astype(np.uint16)
    filled[at[first]] = True
    own, have = out.copy(), filled.copy()
    empty = np.flatnonzero(~filled)
    for p in probes:
        if not len(empty):
            break
        hit = have[p[empty]]
        out[empty[hit]] = own[p[empty[hit]]]
        empty = empty[~hit]
    if len(empty):
        out[empty] = own[np.flatnonzero(have)[0]]
    return out


def estimate(same: np.ndarray, n: np.ndarray, m: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Jaccard similarity from the number of equal registers of sets of n and m, less
    the collisions expected by chance."""
    small, large = np.minimum(n, m).astype(float), np.maximum(n, m).astype(float)
    r = large / np.maximum(small, 1)
    chance = COLLISION * buckets * 2.0 ** -MANTISSA * 4 * r / (1 + r) ** 2
    return np.maximum(same - chance, 0) / buckets


def _sketches(df: DataFrame, text: str, rid: str, doc_id: str, width: int) -> DataFrame:
    """(doc_id, rid, n, hi, lo, sketch) of every document; (hi, lo): 128-bit digest of the set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, probes = _Words(), _probes(BUCKETS)
        for b in slices(batches):
            n, hi, lo, sketch = [], [], [], []
            for v in bytes_of(b.column(2)):
                s = shingles(bytes(v), words, width) if v is not None else np.empty(0, np.uint64)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                hi.append((d >> 64) - (1 << 63))
                lo.append((d & ((1 << 64) - 1)) - (1 << 63))
                sketch.append(registers(s, probes).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                 pa.array(sketch, pa.binary())], names=["doc_id", "rid", "n", "hi", "lo", "sketch"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(rid).alias("rid"), F.col(text)).mapInArrow(
        scan, "doc_id long, rid long, n long, hi long, lo long, sketch binary")


class _Banding:
    """Keys of the bands of registers: fixed choices of registers and multipliers."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(13)
        self.pick = np.stack([rng.choice(BUCKETS, rows, replace=False) for _ in range(bands)])
        self.mult = rng.integers(1, 1 << 62, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = np.arange(1, bands + 1, dtype=np.uint64) * _MULT[0]

    def __call__(self, regs: np.ndarray) -> np.ndarray:
        h = np.repeat(self.salt[None, :], len(regs), 0)
        for j in range(self.pick.shape[1]):
            h = _mix(h + regs[:, self.pick[:, j]].astype(np.uint64) * self.mult[:, j])
        return h


def _bands(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node): one row for each band of registers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Banding(bands, rows)
        for b in slices(batches):
            h = keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS))
            node = np.repeat(b.column(0).to_numpy(), bands)
            band = np.tile(np.arange(bands, dtype=np.int32), len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(band), pa.array(node)],
                                             names=["key", "band", "node"])

    return reps.select("node", "sketch").mapInArrow(scan, "key long, band int, node long")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimated similarity does not rule out the threshold."""
    least = percent / 100 - MARGIN

    @F.pandas_udf("boolean")
    def keep(x, y, n, m):
        import pandas as pd
        a = np.frombuffer(b"".join(x), np.uint16).reshape(-1, BUCKETS)
        b = np.frombuffer(b"".join(y), np.uint16).reshape(-1, BUCKETS)
        return pd.Series(estimate((a == b).sum(1), n.to_numpy(), m.to_numpy()) >= least)

    side = lambda s: reps.select(F.col("node").alias(s), F.col("sketch").alias(f"s{s}"), F.col("n").alias(f"n{s}"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return (pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
                 .where(keep("sa", "sb", "na", "nb")).select("a", "b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(x, y):
        import pandas as pd
        out = []
        for p, q in zip(x, y):
            n, m = len(p) // 8, len(q) // 8
            both = np.concatenate([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)])
            both.sort(kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            out.append(100 * common >= percent * (n + m - common))
        return pd.Series(out, dtype=bool)

    side = lambda s: sets.select(F.col("node").alias(s), F.col("words").alias(f"w{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").where(linked("wa", "wb")).select("a", "b")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WORDS,
                    percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, copy: str | None = None) -> DataFrame:
    """``df`` with ``n_shingles`` (size of the document's set), ``component_id`` (the
    smallest id reachable over links, its own included) and ``kept`` (its id is the
    component's).

    A link: 100 * intersection >= percent * union of the sets.  A null or blank text has
    the empty set and no links.  A document with a null id takes part; it is kept only
    if no document with an id stands in its component, whose id is then null.  Rows
    repeated whole are equal documents with one id; ``copy`` names a column that numbers
    them from 1, so that one can be taken.  An empty table gives an empty result.  Input columns with the names of the new ones are replaced."""
    base = df.drop(*COLUMNS)
    names = own_names(base, ["_rid"])
    rid = names["_rid"]
    base = base.withColumn(rid, F.xxhash64(F.col(doc_id), F.col(text)))
    docs = written(_sketches(base, text, rid, doc_id, width), "sketches")
    reps = (docs.where("n > 0").groupBy("hi", "lo")
                .agg(F.min("doc_id").alias("first"), F.min(F.struct("rid", "n", "sketch")).alias("r"))
                .select("hi", "lo", "first", "r.*").withColumn("node", F.monotonically_increasing_id()))
    reps = written(reps, "classes")
    band = _bands(reps, bands, rows)
    pivot = band.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = written(band.join(pivot, "key"), "buckets")
    sets = written(_full_sets(base, text, rid, reps.join(shared.select("node").distinct(), "node", "left_semi"), width,
                              bands, rows), "sets")
    tried = written(shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(),
                    "pairs")
    links = written(_confirmed(_likely(tried, reps, percent), sets, percent), "links")
    first = written(components(links), "first")
    placed = written(shared.drop("pivot").join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")),
                     "placed")
    top = (placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
                 .agg(F.max(F.struct("n", "comp")).alias("t"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
                 .where("kinds > 1").select("key", F.col("t.comp").alias("top"), F.col("n").alias("members"),
                                            (F.col("n") - F.col("t.n")).alias("others")))
    mixed = written(placed.join(top, "key"), "mixed")
    rest = written(_across(mixed, sets, percent), "pairs")
    more = written(_confirmed(rest, sets, percent), "links")
    comps = written(components(links.unionByName(more)), "components")
    of = reps.select("hi", "lo", "first", "node").join(comps, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    least = of.groupBy("comp").agg(F.min("first").alias("component_id"))
    place = written(of.join(least, "comp").select("hi", "lo", "component_id"), "places")
    for t in (shared, sets, tried, links, first, placed, mixed, rest, more, comps, reps):
        drop(t)
    found = (docs.select("rid", "n", "hi", "lo").dropDuplicates(["rid"]).join(place, ["hi", "lo"], "left")
                 .select(F.col("rid").alias(rid), F.col("n").alias("n_shingles"), "component_id"))
    ident = F.col(doc_id).cast("long")
    out = base.join(found, rid)
    if copy:
        out = out.withColumn(copy, F.row_number().over(Window.partitionBy(rid).orderBy(rid)))
    return (out.drop(rid)
                .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(ident))
                .withColumn("kept", ident.eqNullSafe(F.col("component_id"))))


def _full_sets(df: DataFrame, text: str, rid: str, reps: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(node, n, words, bands, fine) of each class in ``reps``: the sorted hashes of its set, its band keys (32
    bits each) and the finer sketch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, probes, finer, keys = _Words(), _probes(BUCKETS), _probes(FINE), _Banding(bands, rows)
        for b in slices(batches):
            node, hi, lo = (b.column(k).to_pylist() for k in range(3))
            out: list[tuple] = []
            for i, v in enumerate(bytes_of(b.column(3))):
                s = shingles(bytes(v), known, width)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                if ((d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)) == (hi[i], lo[i]):
                    key = keys(registers(s, probes)[None, :])[0].astype("<u4")
                    out.append((node[i], len(s), s.tobytes(), key.tobytes(), registers(s, finer).astype(np.uint8).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)],
                                             names=["node", "n", "words", "bands", "fine"])

    docs = df.select(F.col(rid).alias("rid"), F.col(text).alias("_text"))
    return (docs.join(reps.select("rid", "node", "hi", "lo"), "rid").select("node", "hi", "lo", "_text")
                .mapInArrow(scan, "node long, n long, words binary, bands binary, fine binary").dropDuplicates(["node"]))


def _across(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different components that share a bucket and are likely links.  ``mixed``: (key, band,
    node, comp, top, members, others), all members of the buckets that hold several components."""
    least = percent / 100 - FINE_MARGIN

    def compare(x: list[tuple], y: list[tuple], band: int) -> tuple[np.ndarray, np.ndarray]:
        def part(rows: list[tuple]):
            return (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]),
                    np.array([r[3] for r in rows]), np.frombuffer(b"".join(r[4] for r in rows), "<u4").reshape(len(rows), -1),
                    np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1))

        (xn, xc, _, xs, xb, xf), (yn, yc, yo, ys, yb, yf) = part(x), part(y)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, 4_000_000 // (len(y) * max(band, 1)))
        for i in range(0, len(x), step):
            j = slice(i, i + step)
            ok = xc[j, None] != yc[None, :]
            ok &= ~yo[None, :] | (xn[j, None] < yn[None, :])  # two that are both outside the largest: once
            ok &= np.minimum(xs[j, None], ys[None, :]) * 100 >= np.maximum(xs[j, None], ys[None, :]) * percent
            if band:
                ok &= ~(xb[j, None, :band] == yb[None, :, :band]).any(2)  # an earlier bucket of both has them
            p, q = np.nonzero(ok)
            p += i
            for k in range(0, len(p), 20_000):
                a, b = p[k:k + 20_000], q[k:k + 20_000]
                same = (xf[a] == yf[b]).mean(1)
                hit = (same - 1 / 256) / (1 - 1 / 256) >= least  # eight bits agree by chance once in 256
                out.append((xn[a[hit]], yn[b[hit]]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        p, q = (np.concatenate([o[k] for o in out]) for k in range(2))
        return np.minimum(p, q), np.maximum(p, q)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def solve() -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                a, b = compare(held[0], held[1], now[3])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in slices(batches):
            for key, bo, bm, band, role, *rest in zip(*(b.column(k).to_pylist() for k in range(11))):
                if now is None or now[:3] != (key, bo, bm):
                    yield from solve()
                    now, held = (key, bo, bm, band), ([], [])
                held[role].append(rest)
        yield from solve()

    rows = mixed.select("key", "band", "node", "comp", (F.col("comp") != F.col("top")).alias("other"),
                        F.ceil(F.col("members") / BLOCK).cast("int").alias("nm"),
                        F.ceil(F.col("others") / BLOCK).cast("int").alias("no"))
    own = F.xxhash64("node")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.where("other").select("*", F.pmod(own, F.col("no")).cast("int").alias("bo"), each("nm").alias("bm"),
                                   F.lit(0).alias("role"))
    y = rows.select("*", each("no").alias("bo"), F.pmod(own, F.col("nm")).cast("int").alias("bm"), F.lit(1).alias("role"))
    both = x.unionByName(y).join(sets.select("node", "n", "bands", "fine"), "node")
    return (both.repartition("key", "bo", "bm").sortWithinPartitions("key", "bo", "bm", "role")
                .select("key", "bo", "bm", "band", "role", "node", "comp", "other", "n", "bands", "fine")
                .mapInArrow(scan, "a long, b long"))
