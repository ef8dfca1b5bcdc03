"""Best-fit packing of token sequences with a bounded set of open bins.

Documents are tokenized and cut into pieces of at most the sequence length.  A
piece of full length is a sequence by itself.  The others go through an online
best-fit, dealt by a hash into runs of a few thousand, the longest of a run first: the open bins are kept by their free space,
with one bit per free space in a bitset, so the bin that a piece fits best is
the lowest set bit at or above its length.  When more than a fixed number of
bins are open, the fullest closes first.

Every task packs its own share with its own open bins.  What is still open at
the end of a task goes, as one unit per bin, into a second round with a
sixty-fourth of the tasks, and so on down to one, so what a task leaves half
empty is filled by what others leave."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.common import slices, written

EOS = 2
LENGTH = 1024
OPEN_BINS = 2048
RUN = 5000           # pieces of a run, which are packed longest first

_ENCODERS: dict[tuple[str, str | None], object] = {}


class _Encoder:
    """Token ids of the tokenizer file.  ``ranks``: the same vocabulary in rank form;
    it gives the same ids several times faster and is used where it can be: not for
    texts with the string of an added token, nor for a text of over a million
    characters."""

    def __init__(self, path: str, ranks: str | None):
        self.path, self.slow, self.fast, self.added = path, None, None, []
        if ranks:
            import base64
            import json

            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path, encoding="utf-8") as f:
                self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and len(text) <= 1_000_000 and not any(a in text for a in self.added):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        if self.slow is None:   # loaded only where it is needed
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def encoder(path: str, ranks: str | None = None) -> _Encoder:
    """The encoder of a tokenizer file, loaded once per worker process."""
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = _Encoder(path, ranks)
    return _ENCODERS[path, ranks]


class OpenBins:
    """Bounded-space best fit.  ``put`` returns (bin, offset); a bin is named by a
    running number.  ``closed`` of a put: nothing is kept of a closed bin."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.bits = 0                       # bit f: a bin with f free tokens is open
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            names = self.by_free[free]
            name = names.pop()
            if not names:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            free, name = self.length, self.made
            self.made += 1
        rest = free - size
        if rest:
            self.by_free[rest].append(name)
            self.bits |= 1 << rest
            self.open += 1
            if self.open > self.limit:      # the fullest closes
                least = (self.bits & -self.bits).bit_length() - 1
                self.by_free[least].pop(0)
                if not self.by_free[least]:
                    self.bits ^= 1 << least
                self.open -= 1
        return name, self.length - free

    def left(self) -> list[tuple[int, int]]:
        """(bin, used) of the bins still open."""
        return [(name, self.length - f) for f, names in enumerate(self.by_free) for name in names]


def pieces(df: DataFrame, tokenizer: str, ranks: str | None = None, length: int = LENGTH, eos: int = EOS,
           text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of a text and then ``eos``.
    A document over ``length`` ids is cut into pieces of ``length``; the first piece
    takes what is over and so may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for b in slices(batches):
            cols: list[list] = [[], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(t) if t else np.empty(0, "<u4"), np.array([eos], "<u4"))
                ends = list(range(len(ids) % length or length, len(ids) + 1, length))
                at = 0
                for k, e in enumerate(ends if len(ids) > length else [len(ids)]):
                    for c, v in zip(cols, (d, k, at, e - at, zlib.crc32(ids[at:e].tobytes()))):
                        c.append(v)
                    at = e
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _fill(units: DataFrame, tasks: int, length: int, limit: int, per_task: int) -> DataFrame:
    """Packs (unit, size) in ``tasks`` tasks: (unit, bin, at, used); ``used`` is set on
    one row of each bin that stayed open."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first, held = OpenBins(length, limit), {}, []
        for b in batches:
            units, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            names, ats = [], []
            for u, s in zip(units, sizes):
                name, at = bins.put(s)
                if at == 0:
                    first[name] = u         # a bin is known by its first unit
                names.append(first[name])
                ats.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(units, pa.int64()), pa.array(names, pa.int64()), pa.array(ats, pa.int64()),
                 pa.nulls(len(units), pa.int64())], names=["unit", "bin", "at", "used"])
        held = [(first[n], used) for n, used in bins.left()]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(held), pa.int64()), pa.array([h[0] for h in held], pa.int64()),
             pa.nulls(len(held), pa.int64()), pa.array([h[1] for h in held], pa.int64())],
            names=["unit", "bin", "at", "used"])

    runs = max(1, -(-per_task // RUN))
    return (units.repartition(tasks, F.col("unit"))
                 .sortWithinPartitions(F.pmod(F.xxhash64("unit"), F.lit(runs)), F.desc("size"), "unit")
                 .mapInArrow(pack, "unit long, bin long, at long, used long"))


def best_fit_pack(cut: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS,
                  pieces_per_task: int = 100_000) -> DataFrame:
    """``cut`` (rows of :func:`pieces`) with ``sequence_id`` and ``offset``.

    Rows repeated whole are pieces of their own (a unit is a row, not an id).  A
    sequence never holds more than ``length`` tokens and its offsets leave no gap."""
    full = written(cut.withColumn("unit", F.monotonically_increasing_id()), "pieces")
    short = full.where(F.col("length") < length).select("unit", F.col("length").alias("size"))
    count = short.count()
    tasks = max(1, -(-count // pieces_per_task))
    units, place = short, None
    while True:
        done = written(_fill(units, tasks, length, open_bins, pieces_per_task), "packed")
        here = done.where("unit is not null").select("unit", "bin", "at")
        if place is None:
            place = here
        else:  # bins of the round before moved as units
            moved = here.select(F.col("unit").alias("bin"), F.col("bin").alias("_to"), F.col("at").alias("_at"))
            place = (place.join(moved, "bin", "left")
                          .select("unit", F.coalesce("_to", "bin").alias("bin"),
                                  (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at")))
        if tasks == 1:
            break
        units = done.where("used is not null").select(F.col("bin").alias("unit"), F.col("used").alias("size"))
        tasks = max(1, tasks // 64)
    return (full.join(place, "unit", "left")
                .withColumn("sequence_id", F.coalesce("bin", "unit"))
                .withColumn("offset", F.coalesce("at", F.lit(0)).cast("long")).drop("unit", "bin", "at"))


def pack_documents(df: DataFrame, tokenizer: str, ranks: str | None = None, length: int = LENGTH, eos: int = EOS,
                   open_bins: int = OPEN_BINS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokenize, cut and pack: one row per piece (doc_id, piece, start, length,
    ids_crc32, sequence_id, offset).  An empty or null text is the one id ``eos``; an
    empty table gives an empty result; other columns of the input are ignored."""
    return best_fit_pack(pieces(df, tokenizer, ranks, length, eos, text, doc_id), length, open_bins)
