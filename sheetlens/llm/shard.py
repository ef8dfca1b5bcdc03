"""Byte-balanced shards by histogram sort.

Rows are ordered by (hash of the text, doc id).  Splitters of that order are
searched by counting: every round each task adds up the exact bytes between
candidate boundaries (one row per boundary leaves a task, so the exchange of a
round is bounded by tasks x probes), the driver keeps the interval of each
splitter and probes inside it again until the bytes below a boundary are within
tolerance of the wanted number.  Only then are the rows exchanged, once.

Equal texts have equal hashes and so stay side by side.  A boundary goes
between two texts, and cuts through the copies of one text (by doc id) only if
there is none between two texts within a fiftieth of a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.llm.common import own_names, written

CUT_ABOVE = 0.02    # of a shard's bytes: a boundary that far off may cut through the copies of a text
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _histogram(keys: DataFrame, probes: list[tuple[int, int]]) -> np.ndarray:
    """Exact bytes and rows strictly below each probe (h, id), probes ascending: shape (len, 2)."""
    ph = np.array([p[0] for p in probes], dtype=np.int64)
    pi = np.array([p[1] for p in probes], dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ph) + 1, 2), dtype=np.int64)
        for b in batches:
            h, i, s = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = _place(h, i, ph, pi)
            np.add.at(total, at, np.stack([s, np.ones_like(s)], 1))
        used = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used, 0]), pa.array(total[used, 1])],
                                         names=["at", "b", "n"])

    rows = (keys.mapInArrow(count, "at long, b long, n long")
                .groupBy("at").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect())
    bins = np.zeros((len(ph) + 1, 2), dtype=np.int64)
    for r in rows:  # at most one per probe
        bins[r["at"]] = (r["b"], r["n"])
    return np.cumsum(bins, 0)[:-1]


def _place(h: np.ndarray, i: np.ndarray, ph: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Number of probes at or below each (h, i)."""
    first = np.searchsorted(ph, h, "left")
    same = first < np.searchsorted(ph, h, "right")  # rows on a probe's own hash
    at = first.copy()
    for u in np.unique(first[same]):
        rows = np.flatnonzero(same & (first == u))
        top = np.searchsorted(ph, ph[u], "right")
        at[rows] = u + np.searchsorted(pi[u:top], i[rows], "right")
    return at


def splitters(keys: DataFrame, parts: int, tolerance: float, probes: int = 24,
              total: tuple[int, int] | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Boundaries (h, id) that cut ``keys`` (h, id, size) into ``parts`` ranges of
    near equal bytes, and the exact (bytes, rows) below each."""
    if total is None:
        r = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        total = (int(r[0]), int(r[1]))
    want = [total[0] * (k + 1) / parts for k in range(parts - 1)]
    slack = max(tolerance * total[0] / parts, 1.0)
    # per splitter: the interval of h, or of ids inside one h, that holds it
    state = [{"lo": _LOW, "hi": _HIGH, "h": None, "best": None} for _ in want]
    done: dict[int, tuple[tuple[int, int], np.ndarray]] = {}
    while len(done) < len(want):
        asked: set[tuple[int, int]] = set()
        for k, s in enumerate(state):
            if k in done:
                continue
            span = s["hi"] - s["lo"]
            n = min(probes, span)
            cuts = {s["lo"] + (span * (j + 1)) // (n + 1) for j in range(n)} | {s["hi"]}
            cuts = {c for c in cuts if s["lo"] < c <= s["hi"]}
            s["cuts"] = sorted(cuts)
            asked |= {(c, _LOW) if s["h"] is None else (s["h"], c) for c in cuts}
        order = sorted(asked)
        below = dict(zip(order, _histogram(keys, order)))
        for k, s in enumerate(state):
            if k in done:
                continue
            key = (lambda c: (c, _LOW)) if s["h"] is None else (lambda c, h=s["h"]: (h, c))
            for c in s["cuts"]:
                gap = abs(below[key(c)][0] - want[k])
                if s["best"] is None or gap < s["best"][0]:
                    s["best"] = (gap, key(c), below[key(c)])
            if s["best"][0] <= slack:
                done[k] = s["best"][1:]
                continue
            over = [c for c in s["cuts"] if below[key(c)][0] >= want[k]]
            s["hi"] = over[0] if over else s["hi"]
            s["lo"] = max([s["lo"], *(c for c in s["cuts"] if below[key(c)][0] < want[k])])
            if s["hi"] - s["lo"] <= 1:
                if s["h"] is None and s["best"][0] > CUT_ABOVE * total[0] / parts:  # cut the copies of one text by id
                    s |= {"h": s["lo"], "lo": _LOW, "hi": _HIGH}
                else:               # no nearer boundary
                    done[k] = s["best"][1:]
    cuts = [done[k][0] for k in range(len(want))]
    counts = np.array([done[k][1] for k in range(len(want))]).reshape(-1, 2)
    order = sorted(range(len(cuts)), key=lambda k: cuts[k])
    return [cuts[k] for k in order], counts[order]


def _key(hashed: Column, large: Column, parts: int) -> Column:
    """The sort key: the hash, but a large text goes to the middle half of its
    ``parts``-th of the key range, so that boundaries, which come near the ends,
    fall between small texts and the shards come out more equal."""
    cell = (_HIGH - _LOW + 1) // parts
    if parts < 2:
        return hashed
    at = F.pmod(hashed, F.lit(cell))
    middle = F.try_add(F.try_subtract(hashed, at), F.lit(cell // 4) + F.floor(at / 2).cast("long"))
    return F.when(large, F.coalesce(middle, hashed)).otherwise(hashed)  # at the ends of the range: the hash


def shard_documents(df: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id",
                    tolerance: float = 0.005, rows_per_range: int = 200_000) -> DataFrame:
    """``df`` with ``size`` (UTF-8 bytes plus 1), ``shard`` (0 to shards-1, near equal
    bytes) and ``slot`` (gapless from 0 in its shard), one exchange.

    A null text has size 1 and stands with the other null texts; a null id sorts
    first among the copies of its text.  Rows alike in text and id are never cut
    apart.  An empty table gives an empty result.  A shard is dealt over ranges of
    about ``rows_per_range`` rows, so no task holds a whole shard.  Columns of the
    input with the names of the new ones are replaced."""
    df = df.drop("size", "shard", "slot")
    n = own_names(df, ["_h", "_i", "_bin", "_base"])
    h, i, rng, base = n["_h"], n["_i"], n["_bin"], n["_base"]
    keyed = df.withColumn("size", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1)
    r = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    total = (int(r[0]), int(r[1]))
    fine = max(1, -(-total[1] // (shards * rows_per_range)))
    keyed = (keyed.withColumn(h, _key(F.xxhash64(F.col(text)), F.col("size") > 2 * total[0] // max(total[1], 1),
                                      shards * fine))
                  .withColumn(i, F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOW))))
    keys = written(keyed.select(F.col(h).alias("h"), F.col(i).alias("i"), "size"), "shard-keys")
    cuts, below = splitters(keys, shards * fine, tolerance / fine if fine > 1 else tolerance, total=total)
    ph = np.array([c[0] for c in cuts], dtype=np.int64)
    pi = np.array([c[1] for c in cuts], dtype=np.int64)
    starts = np.concatenate([[0], below[:, 1]]).astype(np.int64)
    first = starts - starts[(np.arange(len(starts)) // fine) * fine]  # rows of the shard before each range

    @F.pandas_udf("int")
    def place(a, b):
        import pandas as pd
        return pd.Series(_place(a.to_numpy(), b.to_numpy(), ph, pi).astype(np.int32))

    out = keyed.withColumn(rng, place(F.col(h), F.col(i)))
    offset = F.element_at(F.array(*[F.lit(int(x)) for x in first]), F.col(rng) + 1)
    tie = [F.col(c) for c in (h, i)]
    return (out.withColumn("slot", F.row_number().over(Window.partitionBy(rng).orderBy(*tie)) - 1 + offset)
               .withColumn("shard", F.floor(F.col(rng) / fine).cast("int"))
               .drop(h, i, rng, base))
