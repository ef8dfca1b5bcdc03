"""Periodic runs of words by recursive frequency splitting.

A run is a maximal stretch of words with smallest period q and at least
``max(least, 2 * q)`` words: words q apart are identical.  It holds each of its
words at least twice.  So a word that occurs once within its segment (at first the
whole text) can belong to no run of it and splits it there; pieces with fewer than
``least`` words are dropped, the others are split again by their own counts until
none changes.  All segments of a batch of texts are split at once, and only those
that changed are counted again.

What survives is scanned lag by lag.  A run of period q makes at least
``max(least - q, q)`` neighbouring words equal to those q later, so probes that far
apart meet it; a probe that agrees is extended both ways.  Probes inside a run whose
period divides the lag would only find that run again and are left out, and once
one run fills the segment no longer lag can hold another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetlens.llm.common import bytes_of, slices

LEAST = 12
COLUMNS = ["runs", "collapsed"]  # what the operator adds
_BATCH = 2_000_000               # bytes of text split at once; a longer text is a batch of its own


def surviving(words: np.ndarray, segment: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of the segments that recursive splitting leaves; ``segment``: number of each word's text,
    ascending."""
    out: list[tuple[int, int]] = []
    at = np.arange(len(words))
    kinds = int(words.max(initial=0)) + 1
    while len(at):
        key = segment * np.int64(kinds) + words[at]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        often = times[which] > 1
        whole = np.ones(int(segment[-1]) + 1, dtype=bool)
        whole[segment[~often]] = False  # segments that a rare word splits
        before, at = segment[often], at[often]
        if not len(at):
            break
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (before[1:] != before[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        stable = whole[before[first]]
        long = size >= least
        out += [(int(at[f]), int(at[f] + n)) for f, n in zip(first[stable & long], size[stable & long])]
        again = long & ~stable
        at = at[np.repeat(again, size)]
        segment = np.repeat(np.arange(int(again.sum()), dtype=np.int64), size[again])
    return out


def _stretch(w: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """[a, b) around i where words equal those q later."""
    end = len(w) - q
    b, step = i + 1, 32
    while b < end:
        c = min(b + step, end)
        differ = np.flatnonzero(w[b:c] != w[b + q:c + q])
        if len(differ):
            b += int(differ[0])
            break
        b, step = c, step * 2
    a, step = i, 32
    while a > 0:
        c = max(a - step, 0)
        differ = np.flatnonzero(w[c:a] != w[c + q:a + q])
        if len(differ):
            a = c + int(differ[-1]) + 1
            break
        a, step = c, step * 2
    return a, b


def lag_scan(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a segment."""
    m = len(w)
    found: list[tuple[int, int, int]] = []  # start, end, period
    seen: set[tuple[int, int]] = set()
    for q in range(1, m // 2 + 1):
        need = max(least - q, q)
        probe = np.arange(0, m - q, need)
        hit = probe[w[probe] == w[probe + q]]
        for s, e, p in found:
            if not len(hit):
                break
            if q % p == 0:
                hit = hit[(hit < s) | (hit + q >= e)]
        done = -1
        for i in hit.tolist():
            if i < done:
                continue
            a, done = _stretch(w, i, q)
            if done - a >= need and (a, done + q) not in seen:
                seen.add((a, done + q))
                found.append((a, done + q, q))
        if (0, m) in seen:
            break
    return [(s, e - s, p) for s, e, p in found]


def text_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (its words), by start, then period."""
    number: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), dtype=np.int64, count=sum(sizes))
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in surviving(ids, np.repeat(np.arange(len(texts), dtype=np.int64), sizes), least):
        k = int(np.searchsorted(first, a, "right")) - 1
        out[k] += [(s + a - int(first[k]), n, p) for s, n, p in lag_scan(ids[a:b], least)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space without those that a run holds after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for s, n, p in runs:
            gone[s + p] += 1
            gone[s + n] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    return b" ".join(words)


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with ``runs`` (array of start, length, period by start, then period; words are numbered from 0) and
    ``collapsed`` (the text without the words that repeat a run's first period, joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are.  A null, empty or blank text has no runs and
    collapses to the empty text; texts are taken whole, whatever their length; repeated rows are done alike; an
    empty table gives an empty result.  Columns of the input with the names of the new ones are replaced."""
    base = df.drop(*COLUMNS)
    run = "array<struct<start: long, length: long, period: long>>"
    schema = T.StructType([*base.schema.fields, *T.StructType.fromDDL(f"runs {run}, collapsed string").fields])
    where = base.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = schema.names

    def solve(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [bytes(v).split() if v is not None else [] for v in bytes_of(b.column(where))]
        runs = text_runs(texts, least)
        rows = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs]
        kept = [collapse(t, r).decode() for t, r in zip(texts, runs)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind), pa.array(kept, pa.string())], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            size = np.cumsum([len(v or b"") for v in bytes_of(b.column(where))])
            a = 0
            while a < b.num_rows:
                before = int(size[a - 1]) if a else 0
                c = max(a + 1, int(np.searchsorted(size, before + _BATCH, "right")))
                yield solve(b.slice(a, c - a))
                a = c

    return base.mapInArrow(scan, schema)
