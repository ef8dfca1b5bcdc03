"""Approximate nearest neighbours by cosine with an adaptive scan of dimensions.

Vectors are scaled to length one and turned by a random rotation, so that every share
of the components tells about the whole distance.  They are dealt to lists by the
nearest centroid; within a list they lie in blocks of rows, and a block's components in
blocks of columns.  A query scans the lists of its nearest centroids.  In a list,
distances are summed column block by column block, and after each a hypothesis test
abandons the candidates whose partial distance is too large to end below the query's
fifth-best distance; for those that stay the cosine of the original vectors is taken in
double precision.

The centroids are fitted on ``sample`` rows at most; every row is indexed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlens.llm.common import slices, written
from sheetlens.llm.vectors import ranked, taking_part

SAMPLE = 32_768      # rows on which centroids are fitted
LISTS = 1024         # most lists
SHARE = 0.7          # of the lists, probed by a query
COLUMNS = 16         # components of a column block
EPSILON = 3.0        # the test abandons at a distance sqrt(d/D) * best * (1 + epsilon / sqrt(d))
ROWS = 1024          # rows of a block
QUERIES = 256        # queries of a block


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(23).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(29)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.linalg.norm(total, axis=1) < 1e-12
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = total / np.linalg.norm(total, axis=1, keepdims=True)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with q, in double precision; equal rows get equal bits."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def scan_block(x: list[np.ndarray], orig: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, q_orig: np.ndarray,
               q_row: int, k: int, best: float) -> tuple[list[tuple[float, int, int]], float]:
    """The k best (cosine, id, row) of a block of candidates for one query, and the query's k-th least squared
    distance so far.  ``x``: column blocks of the rotated unit vectors."""
    dim = sum(b.shape[1] for b in x)
    alive = np.flatnonzero(rows != q_row)
    if best == np.inf and len(alive) > 4 * k:  # the first few in full, for something to test against
        head = alive[:4 * k]
        full = sum(((b[head] - q[s:s + b.shape[1]]) ** 2).sum(1) for b, s in zip(x, range(0, dim, COLUMNS)))
        best = float(np.partition(full, k - 1)[k - 1])
    part, seen = np.zeros(len(alive)), 0
    for b in x:
        w = b.shape[1]
        part += ((b[alive] - q[seen:seen + w]) ** 2).sum(1)
        seen += w
        limit = best if seen == dim else best * seen / dim * (1 + EPSILON / np.sqrt(seen)) ** 2
        stay = part <= limit + 1e-5
        alive, part = alive[stay], part[stay]
        if not len(alive):
            return [], best
    if len(alive) > k:
        best = min(best, float(np.partition(part, k - 1)[k - 1]))
        stay = part <= best + 1e-5
        alive = alive[stay]
    score = cosines(orig[alive], q_orig)
    order = np.lexsort((rows[alive], ids[alive], -score))[:k]
    return [(float(score[o]), int(ids[alive[o]]), int(rows[alive[o]])) for o in order], best


def nearest(df: DataFrame, query: str, k: int = 5, vec: str = "embedding", vec_id: str = "vec_id",
            share: float = SHARE, lists: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``query`` (SQL over the column
    ``id``) holds the k rows found with the largest cosine, all if there are fewer.

    A query's own row is no candidate, another row with its id is.  Rows with a null id
    and vectors that are null, zero, of another length than most, or that hold a null or
    a component that is not finite take no part; ties go to the smaller id; an empty
    table gives an empty result; other columns are ignored."""
    part, n, dim = taking_part(df, vec, vec_id, zero=False)
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    lists = max(1, min(lists or int(n ** 0.5), LISTS, n // 200))
    most = min(sample, 64 * lists)
    chosen = part if n <= most else part.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int((1 << 20) * most / n) + 1)
    rot = rotation(dim)
    fit = _unit(np.array([r[0] for r in chosen.select("v").limit(2 * sample).collect()])) @ rot  # bounded sample
    lists = min(lists, len(fit))
    center = centroids(fit, lists)
    probes = max(1, int(np.ceil(share * lists)), min(lists, 4))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            if b.num_rows:
                m = _matrix(b.column(2))
                near = np.argmax(_unit(m) @ rot @ center.T, axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in m], pa.binary()),
                                                  pa.array(near, pa.int32())], names=["row", "id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            if b.num_rows:
                m = _matrix(b.column(2))
                near = np.argpartition(-(_unit(m) @ rot @ center.T), probes - 1, axis=1)[:, :probes]
                at = pa.array(np.repeat(np.arange(b.num_rows), probes))
                raw = pa.array([x.tobytes() for x in m], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in (b.column(0), b.column(1), raw)),
                                                  pa.array(near.reshape(-1), pa.int32())], names=["row", "id", "v", "list"])

    shape = "row long, id long, v binary, list int"
    index = written(part.select("row", "id", "v").mapInArrow(deal, shape), "lists")
    count = index.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    asked = written(part.where(query).select("row", "id", "v").mapInArrow(probe, shape), "probes")
    asks = asked.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    found = _blocks(index, count, ROWS).join(
        _blocks(asked, asks, QUERIES).select("list", F.col("rows").alias("qrows"), F.col("ids").alias("qids"),
                                             F.col("vs").alias("qvs")), "list")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, float] = {}
        for b in slices(batches, 1):
            rows, ids, vs, qrows, qids, qvs = (np.frombuffer(b.column(c)[0].as_buffer(), t) for c, t in enumerate(
                (np.int64, np.int64, np.float64) * 2))
            orig, q_orig = vs.reshape(-1, dim), qvs.reshape(-1, dim)
            x = (_unit(orig) @ rot).astype(np.float32)
            blocks = [np.ascontiguousarray(x[:, s:s + COLUMNS]) for s in range(0, dim, COLUMNS)]
            q = (_unit(q_orig) @ rot).astype(np.float32)
            out = []
            if len(best) > 500_000:
                best.clear()
            for i, r in enumerate(qrows.tolist()):
                got, best[r] = scan_block(blocks, orig, ids, rows, q[i], q_orig[i], r, k, best.get(r, np.inf))
                out += [(r, int(qids[i]), *g) for g in got]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)],
                                             names=["qrow", "query_id", "score", "vec_id", "row"])

    hits = found.select("rows", "ids", "vs", "qrows", "qids", "qvs").mapInArrow(
        search, "qrow long, query_id long, score double, vec_id long, row long")
    return ranked(hits, k, "double")


def _blocks(rows: DataFrame, count: DataFrame, size: int) -> DataFrame:
    """(list, rows, ids, vs): the rows of a list in packed blocks of at most ``size``; a large list is dealt over
    tasks by a hash."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            row = (held[0][0], *(np.array([h[c] for h in held], np.int64).tobytes() for c in (1, 2)),
                   b"".join(h[3] for h in held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])],
                                              names=["list", "rows", "ids", "vs"])

        for b in slices(batches):
            for r in zip(*(b.column(c).to_pylist() for c in range(4))):
                if held and (held[0][0] != r[0] or len(held) >= size):
                    yield out()
                held.append(r)
        if held:
            yield out()

    cut = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / (8 * size)))
    return (rows.join(count, "list").withColumn("cut", cut).repartition("list", "cut")
                .sortWithinPartitions("list", "cut", "id", "row").select("list", "row", "id", "v")
                .mapInArrow(pack, "list int, rows binary, ids binary, vs binary"))
