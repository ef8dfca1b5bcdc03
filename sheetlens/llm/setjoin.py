"""Jaccard join of shingle sets by a partitioned universe and the pigeonhole principle.

A document's set holds the hashes of its distinct shingles of four words.  Sets are
dealt into bands by size.  Two sets of similarity 0.85 or more, the larger of l
elements, differ in at most H = 2 * l * 15 / 185 of them.  A band's universe is hashed into
somewhat more than H + 1 segments, and a set's part of each segment has one key (hash
of band, segment and part).  Every set has keys in its own band and, if it can be the
smaller partner of a set there, in the next.

The larger set of a pair probes.  It gives its segments values of 0, 1 or 2 with a sum
of H + 1: then some segment differs in fewer elements than its value.  Value 1
looks up equal parts, value 2 also those that one deletion on either side makes
equal, and value 0 nothing.  A segment whose equal parts all belong to sets that are
already linked to this one costs nothing; the cheapest are taken.  Those that cost more
than ``UPGRADE`` comparisons are replaced by giving 2 to others, if what this saves is
worth the pass over all texts that looks for parts less one element (``PASS``
comparisons a set).

So the steps are: keys that two different sets share; verified links between the
sets of a key and its first set; components; values by cost; comparison of what the
values leave, in blocks inside tasks; verification on full sets; components.  Before full
sets are fetched, an exact bound drops pairs: bitmaps of parity differ in no more bits
than the sets in elements.  Copies share one set.  No bucket is expanded into all its pairs, and a key that a large part
of all sets has is aggregated before the shuffle and dealt over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.common import bytes_of, drop, own_names, slices, written
from sheetlens.llm.components import components
from sheetlens.llm.neardup import _mix, _Words, shingles

WORDS = 4
PERCENT = 85
GROWTH = 1.5           # largest size of a band over that of the one before
UPGRADE = 64           # comparisons that a segment may cost before others get value 2 for it
PASS = 50              # comparisons for each set that cost as much as a pass over all texts
ORDERS = 32            # of a key's sets, by which its first one is chosen
BLOCK = 2048           # members of a key, on either side, that a task compares at once
FILTER_BITS = 1 << 25  # of the bitmap that filters rows before a join: 4 MB at any size of the input
COLUMNS = ["n_shingles", "component_id"]  # what the operator adds

_SEGMENT, _TOKEN, _PLACE, _SIGN = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class Bands:
    """Sizes of the bands and of their universes' partitions."""

    def __init__(self, percent: int):
        self.percent = percent
        top = 1
        while self.differ(top + 1) == 0:
            top += 1
        self.tops = [top]  # sets up to here link only if they are equal
        while self.tops[-1] < 1 << 40:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * GROWTH)))
        self._tops = np.array(self.tops)

    def differ(self, n: int) -> int:
        """The most elements in which a set of n and one that is not larger can differ and still be linked."""
        return 2 * n * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self._tops, n))

    def segments(self, band: int) -> int:
        h = self.differ(self.tops[band])
        return h + 2 + h // 8

    def need(self, n: int) -> int:
        """Sum of the values that a set of n gives: one more than it can differ from a smaller one."""
        return self.differ(n) + 1

    def others(self, n: int) -> range:
        """The bands after its own whose sets can have one of n as the smaller partner."""
        return range(self.of(n) + 1, self.of(n * 100 // self.percent) + 1)


def split(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements' values by segment, where each segment starts, each segment's sum)."""
    segment = ((_mix(s * _SEGMENT) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    order = np.argsort(segment, kind="stable")
    value = _mix(s[order] + _TOKEN)
    start = np.searchsorted(segment[order], np.arange(m + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return value, start, total[start[1:]] - total[start[:-1]]


def keys(sums: np.ndarray, band: int, segment: np.ndarray) -> np.ndarray:
    place = _mix(segment.astype(np.uint64) * _PLACE + np.array([band + 1], np.uint64) * _SIGN)
    return _mix(sums + place).view(np.int64)


def own_keys(s: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    m = bands.segments(band)
    return keys(split(s, m)[2], band, np.arange(m))


def deletions(s: np.ndarray, band: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(segment, key of its part without the element) for each element."""
    m = bands.segments(band)
    value, start, sums = split(s, m)
    segment = np.repeat(np.arange(m), np.diff(start))
    return segment, keys(sums[segment] - value, band, segment)


def parity(s: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """Bitmap of twice the band's largest size: a bit is the parity of the elements that hash to it.  Bitmaps of
    two sets differ in at most as many bits as the sets in elements."""
    words = max(1, -(-2 * bands.tops[band] // 64))
    place = (_mix(s + _PLACE) % np.uint64(64 * words)).astype(np.int64)
    odd = np.bincount(place, minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


# ---------------------------------------------------------------- rows of the input

def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _keyed(df: DataFrame, text: str, doc_id: str, width: int, percent: int) -> DataFrame:
    """(doc_id, n, hi, lo, own, more, bits) of every document: (hi, lo) is its set's digest, ``own`` the keys in its
    own band, ``more`` those in the next and ``bits`` its bitmaps in these bands, given where a task first meets
    the set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bands, met = _Words(), Bands(percent), set()
        for b in slices(batches, 256):
            rows: list[tuple] = []
            for v in bytes_of(b.column(1)):
                s = shingles(bytes(v), words, width) if v is not None else np.empty(0, np.uint64)
                hi, lo = _digest(s)
                own = more = bits = None
                if len(s) and (hi, lo) not in met:
                    if len(met) >= 100_000:
                        met.clear()
                    met.add((hi, lo))
                    k = bands.of(len(s))
                    own = own_keys(s, k, bands) if k else None
                    more = [own_keys(s, j, bands) for j in bands.others(len(s))]
                    more = np.concatenate(more) if more else None
                    bits = [parity(s, j, bands).tobytes() for j in (k, *bands.others(len(s)))]
                rows.append((len(s), hi, lo, own, more, bits))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[3:5]),
                 pa.array(cols[5], pa.list_(pa.binary()))], names=["doc_id", "n", "hi", "lo", "own", "more", "bits"])

    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`")).mapInArrow(
        scan, "doc_id long, n long, hi long, lo long, own array<long>, more array<long>, bits array<binary>")


def _bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Bitmap of a column of hashes: ``FILTER_BITS`` bits, or-ed in Spark.  It only saves rows that the join after
    it would drop, so a full one does no harm."""
    slot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = df.where(F.col(column).isNotNull()).select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most a row for each word of the bitmap
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & (64 * len(bitmap) - 1)
    return (bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def _with_keys(docs: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """(key, hi, lo, own) of the sets that have one of the ``wanted`` keys (key)."""
    bitmap = _bitmap(wanted, "key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            hi, lo = (b.column(k).to_numpy() for k in range(2))
            for c, own in ((2, True), (3, False)):
                col = b.column(c)
                n = np.array([len(x) if x.is_valid else 0 for x in col], dtype=np.int64)
                key = col.flatten().to_numpy(zero_copy_only=False)
                hit = _in(bitmap, key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[hit]), pa.array(np.repeat(hi, n)[hit]), pa.array(np.repeat(lo, n)[hit]),
                     pa.array(np.full(int(hit.sum()), own))], names=["key", "hi", "lo", "own"])

    rows = docs.where("own is not null or more is not null").select("hi", "lo", "own", "more")
    return rows.mapInArrow(scan, "key long, hi long, lo long, own boolean").join(wanted, "key", "left_semi")


def _sets(df: DataFrame, text: str, doc_id: str, width: int, nodes: DataFrame) -> DataFrame:
    """(node, words) of ``nodes`` (node, hi, lo, first): the sorted hashes of the set, made again from the texts of
    the documents whose id is some node's first."""
    bitmap = _bitmap(nodes, "first")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in slices(batches, 256):
            rows: list[tuple] = []
            ids = b.column(0)
            asked = _in(bitmap, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
            for v, ask in zip(bytes_of(b.column(1)), asked.tolist()):
                s = shingles(bytes(v), known, width) if ask and v is not None else ()
                if len(s):
                    rows.append((*_digest(s), s.tobytes()))
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))],
                                             names=["hi", "lo", "words"])

    found = df.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(scan, "hi long, lo long, words binary")
    return found.join(nodes.select("node", "hi", "lo"), ["hi", "lo"]).select("node", "words").dropDuplicates(["node"])


def _possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps in the larger set's band do not rule out a link; ``pairs``: (a, na, b, nb,
    band)."""

    @F.pandas_udf("boolean")
    def fits(x, y, n):
        import pandas as pd
        bits = [int(np.bitwise_count(np.frombuffer(p, np.uint64) ^ np.frombuffer(q, np.uint64)).sum()) for p, q in zip(x, y)]
        return pd.Series(np.array(bits, dtype=np.int64) * (100 + percent) <= n.to_numpy() * (100 - percent))

    side = lambda s: marks.select(F.col("node").alias(s), "band", F.col("bits").alias(f"x{s}"))
    return (pairs.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])
                 .where(fits("xa", "xb", F.col("na") + F.col("nb"))).select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""

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


# ---------------------------------------------------------------- values

def _allocated(placed: DataFrame, nodes: DataFrame, percent: int, upgrade: int) -> DataFrame:
    """(node, ones, take, left, up, saved) of the sets that must still look up something.  ``ones``: the keys of the
    cheapest segments that cost something, if the values are 0 and 1.  Else ``take``: the keys of such segments with
    value 1, ``left``: of those with value 0, ``up``: how many segments get value 2, ``saved``: comparisons less.

    ``placed``: (key, node, comp, n, own), the members of every shared key."""
    per = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("same"))
    whole = per.groupBy("key").agg(F.sum("same").alias("all"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    cost = (placed.where("own").join(whole, "key").join(per, ["key", "comp"])
                  .select("node", F.struct((F.col("all") - F.col("same")).alias("cost"), "key").alias("c")))
    each = cost.groupBy("node").agg(F.sort_array(F.collect_list("c")).alias("l"))  # at most a set's segments
    d = each.join(nodes.select("node", "m", "need"), "node").withColumn("r", (F.col("need") - F.col("m") + F.size("l")).cast("int")).where("r > 0")
    d = d.withColumn("cheapest", F.slice("l", 1, F.col("r"))).withColumn(
        "hot", F.size(F.filter("cheapest", lambda c: c["cost"] > upgrade)))
    # of need - hot segments with value 1 each can get 2; what that cannot make up for is looked up all the same
    d = d.withColumn("kept", F.greatest(F.lit(0), F.ceil((2 * F.col("hot") - F.col("need")) / 2)).cast("int"))
    d = d.withColumn("take", F.slice("cheapest", 1, (F.col("r") - F.col("hot") + F.col("kept")).cast("int")))
    saved = F.aggregate(F.array_except("cheapest", "take"), F.lit(0).cast("long"), lambda s, c: s + c["cost"])
    return d.select("node", F.col("cheapest.key").alias("ones"), F.col("take.key").alias("take"), saved.alias("saved"), F.transform(
        F.array_except("l", "take"), lambda c: c["key"]).alias("left"), (F.col("hot") - F.col("kept")).cast("int").alias("up"))


def _requests(sets: DataFrame, ups: DataFrame, percent: int) -> DataFrame:
    """(kind, key, node) of the segments with value 2: ``kind`` 0 looks among parts less one element, 1 (one's own
    part less one element) among parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for b in slices(batches, 256):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for node, words, left, up in zip(*(b.column(k).to_pylist() for k in range(4))):
                s = np.frombuffer(words, np.uint64)
                band = bands.of(len(s))
                full = own_keys(s, band, bands)
                segment, less = deletions(s, band, bands)
                size = np.bincount(segment, minlength=len(full))
                free = np.flatnonzero(~np.isin(full, np.array(left, dtype=np.int64)))
                chosen = free[np.lexsort((free, size[free], size[free] == 0))][:up]  # the smallest that are not empty
                less = less[np.isin(segment, chosen)]
                key = np.concatenate([full[chosen], less])
                out.append((np.repeat([0, 1], [len(chosen), len(less)]), key, np.full(len(key), node)))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "key", "node"])

    return (sets.join(ups, "node").select("node", "words", "left", "up")
                .mapInArrow(scan, "kind long, key long, node long"))


def _less_one(df: DataFrame, text: str, width: int, wanted: DataFrame, percent: int) -> DataFrame:
    """(key, hi, lo) of the sets with a part that is one of the ``wanted`` keys after one deletion."""
    bitmap = _bitmap(wanted, "key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bands, met = _Words(), Bands(percent), set()
        for b in slices(batches, 256):
            out: list[tuple[np.ndarray, int, int]] = []
            for v in bytes_of(b.column(0)):
                s = shingles(bytes(v), known, width) if v is not None else ()
                if not len(s):
                    continue
                hi, lo = _digest(s)
                if (hi, lo) in met:
                    continue
                if len(met) >= 100_000:
                    met.clear()
                met.add((hi, lo))
                own = bands.of(len(s))
                for band in [*([own] if own else []), *bands.others(len(s))]:
                    key = deletions(s, band, bands)[1]
                    key = key[_in(bitmap, key)]
                    if len(key):
                        out.append((key, hi, lo))
            n = [len(o[0]) for o in out]
            cols = [np.concatenate([o[0] for o in out]) if out else [], *(np.repeat([o[k] for o in out], n) if out else [] for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "hi", "lo"])

    return (df.select(F.col(f"`{text}`")).mapInArrow(scan, "key long, hi long, lo long")
              .join(wanted, "key", "left_semi").distinct())


# ---------------------------------------------------------------- comparison in blocks

def _compared(members: DataFrame, marks: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """The pairs (a, b) of a probing set and another of the same key, not in one component and not larger, that
    the bitmaps do not rule out; ``nearest``: for a probing set only the one whose bitmap differs least.
    ``members``: (key, node, comp, n, probe), written.  A key belongs to one band, that of its probing sets."""
    fields = ["key", "bo", "bm", "probe", "node", "comp", "n", "bits"]

    def compare(x: list[tuple], y: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
        part = lambda rows: (*(np.array([r[k] for r in rows]) for k in range(3)),
                             np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1))
        (xn, xc, xs, xb), (yn, yc, ys, yb) = part(x), part(y)
        out = []
        for i in range(len(x)):
            j = np.flatnonzero((yc != xc[i]) & (ys <= xs[i]) & (100 * ys >= percent * xs[i]))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for k in range(0, len(j), max(1, 1_000_000 // yb.shape[1])):
                c = j[k:k + max(1, 1_000_000 // yb.shape[1])]
                bits = np.bitwise_count(yb[c] ^ xb[i]).sum(1, dtype=np.int64)
                fits = bits * (100 + percent) <= (ys[c] + xs[i]) * (100 - percent)
                found.append((c[fits], bits[fits]))
            c = np.concatenate([f[0] for f in found]) if found else j
            if nearest and len(c):
                c = c[[np.argmin(np.concatenate([f[1] for f in found]))]]
            if len(c):
                out.append((np.full(len(c), xn[i]), yn[c]))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def solve() -> Iterator[pa.RecordBatch]:
            for a, b in compare(*held) if held[0] and held[1] else ():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in slices(batches):
            for key, bo, bm, probe, *rest in zip(*(b.column(k).to_pylist() for k in range(8))):
                if now != (key, bo, bm):
                    yield from solve()
                    now, held = (key, bo, bm), ([], [])
                held[0 if probe else 1].append(rest)
        yield from solve()

    size = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nm"),
                                      F.ceil(F.count_if("probe") / BLOCK).cast("int").alias("no"),
                                      F.max(F.when(F.col("probe"), F.col("n"))).alias("most"),
                                      F.count_distinct("comp").alias("kinds")).where("kinds > 1 and no > 0")
    size = size.select("key", "nm", "no", _band(F.col("most"), Bands(percent)).alias("band"))
    inside = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def rows(some: DataFrame, of: DataFrame, bo: Column, bm: Column) -> DataFrame:
        return some.join(of, "key").join(marks, ["node", "band"]).select("*", bo.alias("bo"), bm.alias("bm")).select(fields)

    x = rows(members.where("probe"), size, inside("no"), each("nm"))
    other = members.withColumn("probe", F.lit(False))
    y = rows(other, size.where("no = 1"), F.lit(0), inside("nm")).unionByName(rows(other, size.where("no > 1"), each("no"), inside("nm")))
    return (x.unionByName(y).repartition("key", "bo", "bm")
             .sortWithinPartitions("key", "bo", "bm").mapInArrow(scan, "a long, b long").distinct())


def jaccard_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WORDS,
                       percent: int = PERCENT, upgrade: int = UPGRADE, pass_cost: int = PASS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``df``: the size of its set and the smallest id reachable
    over links, its own included.

    A link: 100 * intersection >= percent * union of the sets.  A null or blank text has the empty set and no
    links, its component is its own id.  A row with a null id takes part; its component has the smallest id of the
    others, null if none has one.  Repeated rows are equal sets and each gives a row; texts are taken whole; an
    empty table gives an empty result.  Other columns of ``df`` are not read, whatever their names."""
    bands = Bands(percent)
    docs = written(_keyed(df, text, doc_id, width, percent), "sets-keys")
    made: list[DataFrame] = [docs]

    def keep(t: DataFrame, name: str) -> DataFrame:
        made.append(written(t, name))
        return made[-1]

    classes = keep(docs.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("first"))
                       .withColumn("node", F.monotonically_increasing_id()), "sets-classes")
    nodes = classes.select("node", "n", "hi", "lo", "first")

    def marked(of: DataFrame) -> DataFrame:
        """(node, band, bits) of the sets in ``of``."""
        some = nodes.join(of.select("node").distinct(), "node", "left_semi")
        rows = docs.where("bits is not null").select("hi", "lo", F.posexplode("bits").alias("k", "bits")).join(some, ["hi", "lo"])
        return keep(rows.select("node", (_band(F.col("n"), bands) + F.col("k")).cast("int").alias("band"), "bits")
                        .dropDuplicates(["node", "band"]), "sets-marks")

    keyed = [docs.select("lo", F.explode(c).alias("key"), F.lit(own).alias("own")) for c, own in (("own", True), ("more", False))]
    shared = keep(keyed[0].unionByName(keyed[1]).groupBy("key").agg(
        F.min("lo").alias("a"), F.max("lo").alias("b"), F.max("own").alias("own")).where("own and a < b").select("key"), "sets-shared")
    members = keep(_with_keys(docs, shared, percent).join(nodes, ["hi", "lo"])
                       .select("key", "node", "n", "own").distinct(), "sets-members")
    marks = marked(members)
    # every key's first set against its others, by one of several orders, so that the sets of a large group meet
    # several first ones; sets that share one key only are left to the values
    order = F.xxhash64("node", F.pmod("key", F.lit(ORDERS)))
    first = (members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "n")).alias("p"))
                    .select("key", "p.node", "p.n").toDF("key", "a", "na"))
    star = (members.join(first, "key").where(f"node <> a and 100 * least(n, na) >= {percent} * greatest(n, na)")
                   .withColumn("turn", F.col("node") < F.col("a"))
                   .select(F.least("a", "node").alias("a"), F.when(F.col("turn"), F.col("n")).otherwise(F.col("na")).alias("na"),
                           F.greatest("a", "node").alias("b"), F.when(F.col("turn"), F.col("na")).otherwise(F.col("n")).alias("nb"))
                   .groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
                   .withColumn("band", _band(F.greatest("na", "nb"), bands)))
    star = keep(_possible(star, marks, percent), "sets-star")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    full = lambda of: keep(_sets(df, text, doc_id, width, nodes.join(of, "node", "left_semi")), "sets-full")
    links = keep(_verified(star, full(ends(star)), percent), "sets-links")
    comp = keep(components(links), "sets-components")
    placed = keep(members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "sets-placed")
    sizes = nodes.withColumn("need", F.expr(f"(2 * n * {100 - percent}) div {100 + percent} + 1")).withColumn(
        "m", _segments(F.col("n"), bands))
    plan = keep(_allocated(placed, sizes, percent, upgrade), "sets-values")
    saved = plan.agg(F.sum(F.when(F.col("up") > 0, F.col("saved")))).first()[0]
    upgraded = saved is not None and saved > pass_cost * classes.count()
    look = plan.select("node", F.explode("take" if upgraded else "ones").alias("key"), F.lit(True).alias("probe"))
    probed = placed.join(look.select("key").distinct(), "key", "left_semi").join(look, ["key", "node"], "left")
    every = probed.select("key", "node", "comp", "n", F.coalesce("probe", F.lit(False)).alias("probe"))
    if upgraded:
        ups = plan.where("up > 0").select("node", "left", "up")
        asked = keep(_requests(full(ups.select("node")), ups, percent), "sets-requests")
        part = [asked.where(f"kind = {k}").select("key").distinct() for k in range(2)]
        found = _less_one(df, text, width, part[0], percent).select(F.lit(0).alias("kind"), "key", "hi", "lo").unionByName(
            _with_keys(docs, part[1], percent).select(F.lit(1).alias("kind"), "key", "hi", "lo"))
        both = asked.select("kind", "key", "node", F.lit(True).alias("probe")).join(nodes.select("node", "n"), "node").unionByName(
            found.join(nodes, ["hi", "lo"]).select("kind", "key", "node", F.lit(False).alias("probe"), "n"))
        both = both.groupBy("kind", "key", "node", "n").agg(F.max("probe").alias("probe")).join(comp, "node", "left")
        every = every.unionByName(both.select(F.xxhash64("kind", "key").alias("key"), "node", F.coalesce("comp", "node").alias("comp"), "n", "probe"))
    every = keep(every, "sets-buckets")
    if upgraded:  # sets found by a deletion need share no key
        marks = marked(every)
    # a link to the nearest set of another component joins large groups; then all that is left between components
    for nearest in (True, False):
        pairs = keep(_compared(every, marks, percent, nearest), "sets-pairs")
        if pairs.isEmpty():
            break
        links = links.unionByName(keep(_verified(pairs, full(ends(pairs)), percent), "sets-links"))
        comp = keep(components(links), "sets-components")
        if nearest:
            every = keep(every.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "sets-buckets")
    of = classes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = of.groupBy("comp").agg(F.min("first").alias("component_id"))
    place = written(of.join(least, "comp").select("hi", "lo", "component_id"), "sets-places")
    for t in made[1:]:
        drop(t)
    out = docs.select("doc_id", F.col("n").alias("n_shingles"), "hi", "lo").join(place, ["hi", "lo"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(
        F.col("doc_id")).alias("component_id"))


def _band(n: Column, bands: Bands) -> Column:
    return (F.lit(0) + sum(F.when(n > t, 1).otherwise(0) for t in bands.tops)).cast("int")


def _segments(n: Column, bands: Bands) -> Column:
    out = F.lit(bands.segments(len(bands.tops) - 1))
    for k in range(len(bands.tops) - 2, -1, -1):
        out = F.when(n <= bands.tops[k], F.lit(bands.segments(k))).otherwise(out)
    return out.cast("long")
