"""Merkle manifest of a table, its blocks stored in van Emde Boas order.

Every row is a leaf (hash of its columns).  The leaves of one group form a tree:
eight consecutive nodes become their hash, the last run may have fewer.  The
groups' roots, ordered by group, form a tree of the same kind, whose root stands
for the table.

A tree is cut into aligned subtrees of ``HEIGHT`` levels, the blocks.  A block is
one row of the manifest, made in one task from at most ``8 ** HEIGHT`` digests;
the roots of the blocks are the leaves of the next round, and so on until a group
has one block.  Inside a block the nodes lie in van Emde Boas order: the upper
half of the levels first, then the subtrees under it one after the other, each
laid out by the same rule.  Construction and the retrieval of siblings compute
places by that arithmetic alone, so a path from a leaf touches few cache lines
whatever their size.

Proofs go down the same way: the path of a block's root is joined to the block
once, and a task extends it to the block's leaves.  Leaves cross the network twice:
once to be ranked, once into their blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlens.llm.common import written
from sheetlens.operators.numbering import explicit_partitions

FANOUT = 8
HEIGHT = 3                     # levels of a block above its leaves
WIDTH = FANOUT ** HEIGHT       # leaves of a block
_AT = 33                       # monotonically_increasing_id: partition << 33 | position


def digest(columns: list[str], replaced: dict[str, Column] | None = None) -> Column:
    """Lowercase hex sha256 of the columns in order: each ``-`` if null, else its UTF-8 byte count, ``:`` and
    its text."""
    parts = []
    for c in columns:
        v = (replaced or {}).get(c, F.col(f"`{c}`")).cast("string")
        parts.append(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


# ---------------------------------------------------------------- one block

def _size(levels: int) -> int:
    return (FANOUT ** levels - 1) // (FANOUT - 1)


@lru_cache(maxsize=None)
def places(levels: int) -> tuple[np.ndarray, ...]:
    """For each depth (the root's is 0) the van Emde Boas places of its nodes, left to right."""
    if levels == 1:
        return (np.zeros(1, dtype=np.int64),)
    top = levels // 2
    low = levels - top
    first = _size(top) + np.arange(FANOUT ** top)[:, None] * _size(low)
    return (*places(top), *((first + p[None, :]).reshape(-1) for p in places(low)))


def height_of(n: int) -> int:
    """Levels above ``n`` leaves of a block that holds its whole tree."""
    h = 0
    while FANOUT ** h < n:
        h += 1
    return h


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def build(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """(nodes in van Emde Boas order, root) of at most ``8 ** height`` leaf digests.  What a short last run leaves
    empty is zero; the end is cut after the last node."""
    at = places(height + 1)
    nodes = np.zeros((_size(height + 1), 32), dtype=np.uint8)
    level, used = [d.hex() for d in leaves], 0
    for depth in range(height, -1, -1):
        own = at[depth][:len(level)]
        nodes[own] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        used = max(used, int(own.max()) + 1)
        if depth:
            level = [_hash(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return nodes[:used].tobytes(), bytes.fromhex(level[0])


def siblings(nodes: bytes, leaves: int, height: int) -> list[list[tuple[str, str]]]:
    """For each leaf of a block, from its level up to below the root: the hex digests to the left and to the right
    of its node in the node's run."""
    at = places(height + 1)
    flat = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    out: list[list[tuple[str, str]]] = [[] for _ in range(leaves)]
    count = leaves
    for depth in range(height, 0, -1):
        text = flat[at[depth][:count]].tobytes().hex()
        below = FANOUT ** (height - depth)
        pairs = []
        for i in range(count):
            a = i // FANOUT * FANOUT
            pairs.append((text[64 * a:64 * i], text[64 * (i + 1):64 * min(a + FANOUT, count)]))
        for j in range(leaves):
            out[j].append(pairs[j // below])
        count = -(-count // FANOUT)
    return out


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf digest and the siblings on its path give."""
    for left, right in path:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def _packed(path: list[tuple[str, str]]) -> bytes:
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex(a + b) for a, b in path)


def _unpacked(path: bytes) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(path):
        a, b = 32 * path[i], 32 * path[i + 1]
        out.append((path[i + 2:i + 2 + a].hex(), path[i + 2 + a:i + 2 + a + b].hex()))
        i += 2 + a + b
    return out


# ---------------------------------------------------------------- the trees

def _ranked(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """``leaves`` with ``pos``, the place in its tree by ``order``, and ``n``, the tree's size.  Range-partitioned
    on all of (tree, order, salt), so neither a large tree nor a row that is repeated often is one task."""
    kept = written(leaves.withColumn("salt", F.monotonically_increasing_id()), f"{name}-leaves")
    by = ["tree", *order, "salt"]
    d = kept.repartitionByRange(explicit_partitions(kept), *by).sortWithinPartitions(*by)
    d = written(d.drop("salt").withColumn("at", F.monotonically_increasing_id()), f"{name}-ranked")
    part = F.shiftright("at", _AT)
    count = d.groupBy("tree", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")  # a row for each partition that holds rows of the tree
    before = F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    count = count.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    return (d.withColumn("part", part).join(count, ["tree", "part"])
             .withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row for each block of ``nodes`` (tree, pos, n, digest, id, claim)."""
    one = nodes.groupBy("tree", "n", F.expr(f"pos div {WIDTH}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "id", "claim"))).alias("l"))  # at most WIDTH
    one = one.select("tree", "n", "block", F.col("l.digest").alias("digests"), F.col("l.id").alias("ids"),
                     F.col("l.claim").alias("claims"))
    kind = one.schema["ids"].dataType.elementType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            built = [build(d, height_of(n) if n <= WIDTH else HEIGHT)
                     for d, n in zip(b.column("digests").to_pylist(), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("tree"), b.column("n"), b.column("block"), pa.array([len(d) for d in b.column("digests")], pa.int32()),
                 pa.array([x[0] for x in built], pa.binary()), pa.array([x[1] for x in built], pa.binary()),
                 b.column("ids"), b.column("claims")],
                names=["tree", "n", "block", "leaves", "nodes", "root", "ids", "claims"])

    return one.mapInArrow(scan, f"tree string, n long, block long, leaves int, nodes binary, root binary, "
                                f"ids array<{kind}>, claims array<binary>")


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The written blocks of every round; a round has one 512th of the rows of the one before."""
    out: list[DataFrame] = []
    while True:
        out.append(written(_blocks(nodes), f"{name}-blocks{len(out)}"))
        nodes = out[-1].where(F.col("n") > WIDTH).select(
            "tree", F.col("block").alias("pos"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"),
            F.col("root").alias("digest"), F.col("block").alias("id"), F.lit(None).cast("binary").alias("claim"))
        if nodes.isEmpty():
            return out


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, subroot) of every tree: the root of the block that holds its last round."""
    tops = [r.where(F.col("n") <= WIDTH).select("tree", F.col("root").alias("subroot")) for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _paths(blocks: DataFrame, kind: str) -> DataFrame:
    """(id, path, subroot, root) of every leaf of blocks that have their own path joined."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                height = height_of(r["n"]) if r["n"] <= WIDTH else HEIGHT
                own = [_packed(p) + r["path"] for p in siblings(r["nodes"], r["leaves"], height)]
                k = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["tree"]] * k, pa.string()), pa.array(r["ids"], pa.string() if kind == "string" else pa.int64()),
                     pa.array(own, pa.binary()), pa.array([r["subroot"]] * k, pa.binary()), pa.array([r["root_"]] * k, pa.binary())],
                    names=["tree", "id", "path", "subroot", "root_"])

    return blocks.select("tree", "n", "leaves", "nodes", "ids", "path", "subroot", "root_").mapInArrow(
        scan, f"tree string, id {kind}, path binary, subroot binary, root_ binary")


def _down(rounds: list[DataFrame], tops: DataFrame, kind: str) -> DataFrame:
    """The first round's blocks joined to the path of their root; ``tops``: (tree, path, subroot, root_)."""
    upper = None
    for k in range(len(rounds) - 1, -1, -1):
        here = rounds[k].where(F.col("n") <= WIDTH).select("tree", "block").join(tops, "tree")
        upper = here if upper is None else here.unionByName(upper)
        joined = rounds[k].drop("root").join(upper, ["tree", "block"])
        if k == 0:
            return joined
        upper = _paths(joined, "long").withColumnRenamed("id", "block").select("tree", "block", "path", "subroot", "root_")


@dataclass
class Manifest:
    """The blocks of the groups' trees and of the tree over the groups, round by round (tables in the cluster's
    shared folder)."""

    rounds: list[DataFrame]
    above: list[DataFrame]

    def blocks(self) -> DataFrame:
        """(forest, round, tree, n, block, leaves, nodes, root): the whole manifest, digests of 32 bytes."""
        out = None
        for forest, rounds in (("rows", self.rounds), ("groups", self.above)):
            for k, r in enumerate(rounds):
                part = r.select(F.lit(forest).alias("forest"), F.lit(k).alias("round"), "tree", "n", "block", "leaves",
                                "nodes", "root")
                out = part if out is None else out.unionByName(part)
        return out


def manifest(df: DataFrame, columns: list[str], group: str, order: str, changed: Column | None = None,
             replaced: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``df``: a leaf is :func:`digest` of ``columns``, a tree the rows of one value of ``group``
    by ``order``.

    Where ``changed`` holds, the row is audited with ``replaced`` in place of its columns.  A null group is a
    group of its own, before the others; null orders come first; rows of one order go by digest, so repeated rows
    give the same tree however they are dealt.  An empty table has no blocks.  Columns other than those named are
    not read."""
    tree = F.when(F.col(f"`{group}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    claim = F.lit(None).cast("binary")
    if changed is not None:
        claim = F.when(changed, F.unhex(digest(columns, replaced)))
    leaves = df.select(tree.alias("tree"), F.col(f"`{order}`").cast("long").alias("id"),
                       F.unhex(digest(columns)).alias("digest"), claim.alias("claim"))
    rounds = _rounds(_ranked(leaves, ["id", "digest"], "merkle"), "merkle")
    groups = _tops(rounds).select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("subroot").alias("digest"),
                                  F.lit(None).cast("binary").alias("claim"))
    return Manifest(rounds, _rounds(_ranked(groups, ["id"], "merkle-groups"), "merkle-groups"))


def audit(m: Manifest, with_siblings: bool = False) -> DataFrame:
    """One row a leaf: (id, tree, leaf, subroot, root, proof_sha256, folded_root, verified[, siblings]).

    ``proof_sha256`` is the hash of the digests beside the leaf's path, level by level via the group's root to the
    root; ``folded_root`` what the audited digest (the changed row's where it was changed) gives with them, and
    ``verified`` whether that is the root.  ``siblings``: those digests themselves."""
    none = F.unhex(F.lit("")).alias("path")
    top = _tops(m.above).select("tree", none, "subroot", F.col("subroot").alias("root_"))
    per_group = _paths(_down(m.above, top, "string"), "string").select(F.col("id").alias("tree"), "path", "root_")
    tops = per_group.join(_tops(m.rounds), "tree").select("tree", "path", "subroot", "root_")
    first = _down(m.rounds, tops, "long")
    names = ["id", "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    schema = ("id long, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean") + (", siblings array<string>" if with_siblings else "")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                height = height_of(r["n"]) if r["n"] <= WIDTH else HEIGHT
                own = places(height + 1)[height][:r["leaves"]]
                text = np.frombuffer(r["nodes"], np.uint8).reshape(-1, 32)[own].tobytes().hex()
                leaves = [text[64 * j:64 * j + 64] for j in range(r["leaves"])]
                upper = _unpacked(r["path"])
                tail = "".join(a + c for a, c in upper)
                root, sub, k = r["root_"].hex(), r["subroot"].hex(), len(leaves)
                proofs, roots, beside = [], [], []
                for leaf, claim, path in zip(leaves, r["claims"], siblings(r["nodes"], k, height)):
                    proof = "".join(a + c for a, c in path) + tail
                    proofs.append(hashlib.sha256(proof.encode()).hexdigest())
                    roots.append(fold(fold(leaf if claim is None else claim.hex(), path), upper))
                    if with_siblings:
                        beside.append([proof[i:i + 64] for i in range(0, len(proof), 64)])
                cols = [pa.array(r["ids"], pa.int64()), pa.array([r["tree"]] * k), pa.array(leaves), pa.array([sub] * k),
                        pa.array([root] * k), pa.array(proofs), pa.array(roots), pa.array([x == root for x in roots])]
                if with_siblings:
                    cols.append(pa.array(beside, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(cols, names=names + ["siblings"] * with_siblings)

    return first.select("tree", "n", "leaves", "nodes", "ids", "claims", "path", "subroot", "root_").mapInArrow(scan, schema)
