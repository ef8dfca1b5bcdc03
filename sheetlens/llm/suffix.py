"""Removal of long passages that occur more than once, by hash-compared suffix sort.

A window is a string of ``length`` bytes.  Every window is owned by its minimizer,
the ``GRAM`` bytes inside it whose hash is least (the leftmost of equal ones), so
equal windows are owned at the same place inside them.  The windows that one
position owns form a segment, a short run of bytes; a text has about one segment
for every 185 bytes.  Two windows can be equal only if their segments have the same
anchor (hash of the owning bytes):

1. Segments alike in anchor and content are counted.  If there are two, all their
   windows repeat.  What a task has of one content leaves it as one row, so a group
   of copies, however large, crosses the shuffle as a few rows.
2. Different segments of one anchor can share some windows.  One of each content is
   fetched, and per anchor the strings to the right of the anchor and those to its left
   (reversed) are suffix-sorted.  Prefix polynomial hashes give the hash of any
   substring, so a binary search finds the common extension of two suffixes and a
   comparison is logarithmic; the sort is a mergesort over all anchors of a batch at
   once.  Neighbours' common extensions are verified on the bytes; after a hash
   collision the batch is sorted by its bytes.  A window repeats if another segment
   agrees with it far enough on both sides.  (An anchor with more than ``BLOCK``
   contents is dealt over tasks by window instead and the windows are counted.)
3. The repeated windows of a document are gathered and their bytes removed.  Segments of
   a task that are alike are looked up ``PACK`` at a time; what is found goes back to the
   share of the texts that it came from, where a text's ranges become one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.llm.common import bytes_of, drop, own_names, slices, with_arrays, written

LENGTH = 400
GRAM = 32
BLOCK = 16_384        # contents of an anchor that one task compares
PACK = 64             # segments of one content that cross a shuffle as one row
_CHUNK = 1 << 19      # window starts hashed at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POS = np.uint64((1 << 20) - 1)
_POWERS: dict[str, np.ndarray] = {}
COLUMNS = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]  # what the operator adds


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash value of each byte, and powers of the base and of its inverse mod 2**64."""
    if "c" not in _POWERS:
        _POWERS["c"] = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if len(_POWERS.get("p", ())) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("p", _BASE), ("i", inverse)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            _POWERS[name] = np.multiply.accumulate(t)
    return _POWERS["c"], _POWERS["p"], _POWERS["i"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def segments(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window, position of the anchor) of each segment of a text."""
    outs = []
    for base in range(0, max(0, len(b) - length + 1), _CHUNK):
        part = b[base:base + _CHUNK + length - 1]
        c, p, inv = _tables(len(part) + 1)
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(c[part] * p[:len(part)], out=prefix[1:])
        n = len(part) - gram + 1
        h = _mix((prefix[gram:] - prefix[:n]) * inv[:n])
        key = (h & ~_POS) | np.arange(n, dtype=np.uint64)
        w = length - gram + 1
        rows = -(-n // w)
        padded = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:n] = key
        grid = padded.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, 1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
        windows = len(part) - length + 1
        at = (np.minimum(behind[:windows], ahead[w - 1:w - 1 + windows]) & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:] - 1, windows - 1)
        a = at[first]
        outs.append((h[a].view(np.int64), first + base, last + base, a + base))
    if not outs:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*outs))


def _pack(first: np.ndarray, last: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Place of a segment in one long: first window, number of windows, anchor's distance."""
    return (first << 20) | ((last - first + 1) << 10) | (a - first)


_ROWS = ["anchor", "seg", "rid", "at", "n"]


def _segment_rows(df: DataFrame, text: str, rid: str, length: int, gram: int, combine: bool) -> DataFrame:
    """The segments of all texts: (anchor, seg, rid, at), or with ``combine`` (anchor, seg, rid, at, n), one row for
    each content of a task's share with their number."""
    names = _ROWS if combine else _ROWS[:4]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*held)] if held else [np.empty(0, np.int64)] * 4
            if combine:
                anchor, seg, rid_, at = cols
                order = np.lexsort((seg, anchor))
                a, s = anchor[order], seg[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])) if len(a) else order
                cols = [a[first], s[first], rid_[order][first], at[order][first], np.diff(np.append(first, len(a)))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)

        for batch in slices(batches, 256):
            for r, v in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                if v is None or len(v) < length:
                    continue
                anchor, first, last, a = segments(np.frombuffer(v, np.uint8), length, gram)
                hashed = xxhash.xxh3_64_intdigest
                seg = np.fromiter((hashed(v[f:e]) for f, e in zip(first.tolist(), (last + length).tolist())),
                                  dtype=np.uint64, count=len(first)).view(np.int64)
                held.append([anchor, seg, np.full(len(first), r, dtype=np.int64), _pack(first, last, a)])
                count += len(first)
            if count > 300_000:
                count = 0
                yield flush()
        yield flush()

    return df.select(rid, text).mapInArrow(scan, ", ".join(f"`{c}` long" for c in names))


def _packed(rows: DataFrame) -> DataFrame:
    """(anchor, seg, rids, ats, part) of ``rows`` (anchor, seg, rid, at): what a task, ``part``, has of one content,
    at most ``PACK`` segments in a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            anchor, seg, rid, at = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(4))
            held.clear()
            order = np.lexsort((seg, anchor))
            anchor, seg = anchor[order], seg[order]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])])
            place = np.arange(len(order))
            first = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % PACK == 0)
            ends = pa.array(np.append(first, len(order)), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(anchor[first]), pa.array(seg[first]), *(pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (rid, at)),
                 pa.array(np.full(len(first), part))], names=["anchor", "seg", "rids", "ats", "part"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) > 300_000:
                yield flush()
        if held:
            yield flush()

    return rows.select("anchor", "seg", "rid", "at").mapInArrow(
        pack, "anchor long, seg long, rids array<long>, ats array<long>, part long")


def _gathered(found: DataFrame) -> DataFrame:
    """(rid, ranges) of ``found`` (rids, ats, runs): the windows of a text that a task has, as one row of runs that do
    not touch.  ``runs``: windows inside the segment, null for all of them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            rid, first, last = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((first, rid))
            rid, first, last = rid[order], first[order], last[order]
            new = np.flatnonzero(np.concatenate([[True], (rid[1:] != rid[:-1]) | (first[1:] > last[:-1] + 1)]))
            rid, first, last = rid[new], first[new], np.maximum.reduceat(last, new)
            each = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
            ends = pa.array(2 * np.append(each, len(rid)), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(rid[each]), pa.ListArray.from_arrays(ends, pa.array(np.stack([first, last], 1).reshape(-1)))],
                names=["rid", "ranges"])

        for b in batches:
            rids, ats, runs = b.columns
            n = rids.value_lengths().to_numpy()
            rid, at = rids.flatten().to_numpy(), ats.flatten().to_numpy()
            parts = runs.value_lengths().fill_null(0).to_numpy() // 2
            edges = runs.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            all_ = runs.is_null().to_numpy(zero_copy_only=False)[row]
            first = at >> 20
            held.append((rid[all_], first[all_], first[all_] + ((at[all_] >> 10) & 1023) - 1))
            some = np.repeat(np.flatnonzero(~all_), parts[row[~all_]])  # each segment with each of its row's runs
            begin = np.cumsum(parts) - parts
            k = begin[row[some]] + np.arange(len(some)) - np.repeat(np.cumsum(parts[row[~all_]]) - parts[row[~all_]], parts[row[~all_]])
            held.append((rid[some], first[some] + edges[2 * k], first[some] + edges[2 * k + 1]))
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield flush()
        if sum(len(x[0]) for x in held):
            yield flush()

    return found.select("rids", "ats", "runs").mapInArrow(gather, "rid long, ranges array<long>")


class _Suffixes:
    """Strings of a batch with prefix hashes, end to end; ``sort`` orders (group, string)."""

    def __init__(self, strings: list[bytes], group: np.ndarray):
        self.n = len(strings)
        self.group = group
        self.len = np.fromiter(map(len, strings), dtype=np.int64, count=self.n)
        self.at = np.cumsum(self.len + 1) - self.len - 1  # a byte of padding after each
        self.bytes = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        c, p, _ = _tables(int(self.len.max(initial=0)) + 2)
        inside = np.arange(len(self.bytes)) - np.repeat(self.at, self.len + 1) if self.n else np.empty(0, np.int64)
        self.prefix = np.zeros(len(self.bytes) + 1, dtype=np.uint64)  # of all strings; a string's own are differences
        np.cumsum(c[self.bytes[:len(inside)]] * p[inside], out=self.prefix[1:1 + len(inside)])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings x and y: binary search over hashes of prefixes."""
        lo, hi = np.zeros(len(x), dtype=np.int64), np.minimum(self.len[x], self.len[y])
        ax, ay = self.at[x], self.at[y]
        apart = self.prefix[ax] - self.prefix[ay]
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.prefix[ax + mid] - self.prefix[ay + mid] == apart
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, mid - 1)
        return lo

    def before(self, x: np.ndarray, y: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Whether x sorts before y, whose common prefix has length ``at``; equal ones by number."""
        at = self.common(x, y) if at is None else at
        nx, ny = self.len[x], self.len[y]
        ended = (at >= nx) | (at >= ny)
        by_byte = self.bytes[self.at[x] + at] < self.bytes[self.at[y] + at]
        inner = np.where(ended, np.where(nx == ny, x < y, nx < ny), by_byte)
        gx, gy = self.group[x], self.group[y]
        return np.where(gx == gy, inner, gx < gy)

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Order, and common prefix of each with the one before it (0 for the first of a group)."""
        order = np.arange(self.n)
        run = 1
        while run < self.n:  # each element's place: its own run's part plus its rank in the run beside
            pos = np.arange(self.n)
            block = pos // run
            left = block % 2 == 0
            other = np.where(left, block + 1, block - 1) * run
            lo = np.minimum(other, self.n)
            hi = np.minimum(other + run, self.n)
            start = lo.copy()
            while (lo < hi).any():
                go = lo < hi
                mid = np.where(go, (lo + hi) >> 1, 0)
                less = self.before(order[mid], order[pos]) & go
                lo = np.where(less, mid + 1, lo)
                hi = np.where(go & ~less, mid, hi)
            merged = np.empty_like(order)
            merged[(block // 2) * 2 * run + (pos - block * run) + (lo - start)] = order
            order, run = merged, run * 2
        lcp = self.common(order[1:], order[:-1])
        if not self._holds(order, lcp):  # a hash collision: sort by the bytes
            text = [self.bytes[a:a + n].tobytes() for a, n in zip(self.at.tolist(), self.len.tolist())]
            order = np.array(sorted(range(self.n), key=lambda i: (self.group[i], text[i])), dtype=np.int64)
            lcp = np.array([_common(text[i], text[k]) for i, k in zip(order[1:], order[:-1])], dtype=np.int64)
        joined = self.group[order[1:]] == self.group[order[:-1]]
        return order, np.concatenate([[0], np.where(joined, lcp, 0)])

    def _holds(self, order: np.ndarray, lcp: np.ndarray) -> bool:
        """Whether the bytes bear out the common prefixes of neighbours and their order (hashes never make a
        prefix too short)."""
        x, y = order[:-1], order[1:]
        for i in range(0, len(x), 1024):
            n = lcp[i:i + 1024]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            a, b = (np.repeat(self.at[v[i:i + 1024]], n) + step for v in (x, y))
            if (self.bytes[a] != self.bytes[b]).any():
                return False
        return bool(self.before(x, y, lcp).all())


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def shared_windows(frags: list[bytes], anchors: np.ndarray, group: np.ndarray, counts: np.ndarray,
                   length: int) -> np.ndarray:
    """For fragments (bytes of a segment) with their anchor's distance: which windows
    (rows: fragment, columns: window) occur in another fragment of the group."""
    right = _Suffixes([f[a:] for f, a in zip(frags, anchors.tolist())], group)
    left = _Suffixes([f[:a][::-1] for f, a in zip(frags, anchors.tolist())], group)
    n = len(frags)
    (ro, rl), (lo, ll) = right.sort(), left.sort()
    fresh_r = np.concatenate([[True], group[ro[1:]] != group[ro[:-1]]])
    fresh_l = np.concatenate([[True], group[lo[1:]] != group[lo[:-1]]])
    out = np.zeros((n, int(counts.max(initial=0))), dtype=bool)
    rc, lc = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(int(anchors.max(initial=0)) + 1):  # window that starts o bytes before the anchor
        at = anchors - o
        owned = np.flatnonzero((at >= 0) & (at < counts))
        if len(owned) < 2:
            continue
        rc[ro] = np.cumsum(fresh_r | (rl < length - o))
        lc[lo] = np.cumsum(fresh_l | (ll < o))
        _, inverse, times = np.unique(rc[owned] * np.int64(n + 1) + lc[owned], return_inverse=True, return_counts=True)
        hit = owned[times[inverse] > 1]
        out[hit, at[hit]] = True
    return out


def _runs(flags: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [int(v) - (i % 2) for i, v in enumerate(edge)]


def _compare(frags: DataFrame, length: int) -> DataFrame:
    """(anchor, seg, runs) of the segments of sorted ``frags`` (anchor, seg, at, frag)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            group = np.cumsum([0] + [rows[i][0] != rows[i - 1][0] for i in range(1, len(rows))])
            at = np.array([r[2] for r in rows], dtype=np.int64)
            counts, anchors = (at >> 10) & 1023, at & 1023
            hit = shared_windows([r[3] for r in rows], anchors, group, counts, length)
            some = np.flatnonzero(hit.any(1))
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64()),
                 pa.array([_runs(hit[i]) for i in some], pa.list_(pa.int32()))], names=["anchor", "seg", "runs"])

        for b in slices(batches, 512):
            held += zip(*(b.column(k).to_pylist() for k in range(4)))
            if len(held) >= 2048:
                cut = len(held) - 1
                while cut and held[cut][0] == held[cut - 1][0]:
                    cut -= 1
                if cut:
                    yield solve(held[:cut])
                    held = held[cut:]
        if held:
            yield solve(held)

    return frags.mapInArrow(work, "anchor long, seg long, runs array<int>")


def _count_windows(frags: DataFrame, length: int) -> DataFrame:
    """What :func:`_compare` gives, for anchors with very many contents: every window
    is a row, counted by its content."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            cols: list[list] = [[], [], [], []]
            for anchor, seg, at, frag in zip(*(b.column(k).to_pylist() for k in range(4))):
                for k in range((at >> 10) & 1023):
                    for c, v in zip(cols, (anchor, seg, k, xxhash.xxh3_128_digest(frag[k:k + length]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["anchor", "seg", "k", "h"])

    rows = frags.mapInArrow(explode, "anchor long, seg long, k int, h binary")
    twice = rows.groupBy("anchor", "h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor", "h")
    return (rows.join(twice, ["anchor", "h"], "left_semi").groupBy("anchor", "seg")
                .agg(F.flatten(F.sort_array(F.collect_list(F.array("k", "k")))).alias("runs")))


def repeated_windows(df: DataFrame, rid: str, text: str, length: int = LENGTH, gram: int = GRAM,
                     block: int = BLOCK) -> DataFrame:
    """(rid, ranges): per text with repeated windows, their first and last starts [first, last, ...]."""
    gram = min(gram, length)
    once = _segment_rows(df, text, rid, length, gram, True).repartition(F.col("anchor"))
    classes = once.groupBy("anchor", "seg").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "at")).alias("rep"))
    classes = written(classes.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("anchor")))
                             .where("n > 1 or kinds > 1"), "segments")
    mixed = classes.where("kinds > 1").select("anchor", "seg", "kinds", "rep.rid", "rep.at")
    first = F.shiftright("at", 20)
    size = F.shiftright("at", 10).bitwiseAND(1023) + length - 1
    frags = (mixed.join(df.select(F.col(rid).alias("rid"), F.col(text).cast("binary").alias("_b")), "rid")
                  .select("anchor", "seg", "at", "kinds", F.substring(
                      F.col("_b"), (first + 1).cast("int"), size.cast("int")).alias("frag")))
    frags = written(frags.repartition(F.col("anchor"), F.when(F.col("kinds") > block, F.col("seg")).otherwise(0))
                         .sortWithinPartitions("anchor", "seg"), "fragments")
    part = _compare(frags.where(F.col("kinds") <= block).repartition(F.col("anchor"))
                         .sortWithinPartitions("anchor", "seg").select("anchor", "seg", "at", "frag"), length)
    many = _count_windows(frags.where(F.col("kinds") > block).select("anchor", "seg", "at", "frag"), length)
    alone = classes.where("n = 1").select("anchor", "seg")
    hits = (part.unionByName(many).join(alone, ["anchor", "seg"], "left_semi")
                .unionByName(classes.where("n > 1").select(
                    "anchor", "seg", F.lit(None).cast("array<int>").alias("runs"))))
    hits = written(hits, "repeated")
    drop(classes)
    drop(frags)
    # a content that very many texts share meets its row in few tasks, so what is found is dealt out by where it came from
    looked = _packed(_segment_rows(df, text, rid, length, gram, False)).join(hits, ["anchor", "seg"]).repartition("part")
    return _gathered(looked).groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _inside_word(b: bytes, i: int) -> bool:
    return 0 < i < len(b) and not b[i - 1:i].isspace() and not b[i:i + 1].isspace()


def _cut(b: bytes, ranges: list[int] | None, length: int, least_words: int) -> tuple[np.ndarray, int]:
    """(bytes that are kept, maximal runs that are removed) of a text with the repeated windows ``ranges``."""
    whole = np.frombuffer(b, np.uint8)
    if ranges is None:
        return whole, 0
    edges = np.zeros(len(b) + 1, dtype=np.int64)
    np.add.at(edges, ranges[0::2], 1)
    np.add.at(edges, np.asarray(ranges[1::2]) + length, -1)
    gone = np.cumsum(edges[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    spans = len(turn) // 2
    if least_words:
        for x, y in zip(turn[0::2].tolist(), turn[1::2].tolist()):
            cut = _inside_word(b, x) + _inside_word(b, y)  # words at the ends that are not whole
            if len(b[x:y].split()) - cut < least_words:
                gone[x:y] = False
                spans -= 1
    return whole[~gone], spans


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
                   gram: int = GRAM, block: int = BLOCK, least_words: int = 0, decode: str | None = None) -> DataFrame:
    """``df`` with ``kept`` (binary: the UTF-8 bytes of the text without every byte
    covered by a string of ``length`` bytes that also starts anywhere else),
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_sha256``.
    A run that holds fewer than ``least_words`` whole words stays.  ``decode`` names a column for the
    kept text instead of ``kept`` and ``kept_sha256``; what is left of a character that was cut is left out of it.

    A null text counts as empty; texts shorter than ``length`` are kept whole; rows
    repeated whole repeat each other's passages, so these go from all of them; matches
    never cross documents; an empty table gives an empty result.  Input columns with
    the names of the new ones are replaced."""
    base = df.drop(*COLUMNS)
    n = own_names(base, ["_rid", "_ranges"])
    rid, ranges = n["_rid"], n["_ranges"]
    base = base.withColumn(rid, F.xxhash64(F.col(doc_id), F.col(text)))
    found = repeated_windows(base.select(rid, text), rid, text, length, gram, block)
    found = found.select(F.col("rid").alias(rid), F.col("ranges").alias(ranges))

    def remove():
        def make(texts, spans):
            out: list[tuple] = []
            for t, r in zip(texts, spans):
                b = (t or "").encode()
                kept, times = _cut(b, r, length, least_words)
                kept = kept.tobytes()
                counts = (len(b), len(b) - len(kept), times)
                out.append((kept.decode("utf-8", "ignore"), *counts) if decode else
                           (kept, *counts, hashlib.sha256(kept).hexdigest()))
            return [list(c) for c in zip(*out)]
        return make

    counts = "n_bytes long, n_removed long, n_spans long"
    added = f"`{decode}` string, {counts}" if decode else f"kept binary, {counts}, kept_sha256 string"
    return with_arrays(base.join(found, rid, "left"), [text, ranges], remove, added, 256).drop(rid, ranges)
