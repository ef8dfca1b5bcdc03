"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from sheetlens.llm import merkle
from sheetlens.llm.queries import LEAF, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    vals = [r[0], r[3], r[2], r[4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))


def tree(level):
    """Root, and for every leaf its path: (digests on the left, on the right) of each level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for j, i in enumerate(at):
            a = i // 8 * 8
            paths[j].append(("".join(level[a:i]), "".join(level[i + 1:a + 8])))
        level = [sha("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    root, above = tree([made[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above):
        sub, paths = made[g]
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths):
            path = path + up
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            f = leaf(r, r[1] and r[1].translate(low)) if tampered else own
            for a, b in path:
                f = sha(a + f + b)
            out.append((r[0], own, sub, root, sha("".join(a + b for a, b in path)), f, f == root))
    return sorted(out, key=str)


def got(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in QUERIES["op12_veb_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)


def corpus(n, langs, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["Some Text", "no capitals", "É", ""]) + str(i), rnd.choice(langs), rnd.choice(["s", None]), rnd.choice([None, 5]))
            for i in range(n)]


@pytest.mark.parametrize("n,langs", [(700, ["en", "de", "Z", None]), (30, [f"l{k}" for k in range(20)]), (1, ["en"]), (9, [None])])
def test_equals_plain_tree(spark, tmp_path, n, langs):
    rows = corpus(n, langs)
    out = got(spark, rows, tmp_path)
    assert out == brute(rows)
    assert n < 30 or {r[6] for r in out} == {True, False}


def test_several_rounds(spark, tmp_path, monkeypatch):
    """Blocks of one level: every level is a round of its own."""
    for k, v in (("HEIGHT", 1), ("WIDTH", 8)):
        monkeypatch.setattr(merkle, k, v)
    rows = corpus(600, ["en", "en", "de"])
    assert got(spark, rows, tmp_path) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "A", None, None, 1), (3, None, "en", None, None), (3, "B", "en", "s", 1), (3, "B", "en", "s", 1),
            (4, "", "", "", 0), (5, "x" * 100_000 + "Y", "en", "s", 100_001)] + [(7, "copy", "en", "s", 4)] * 300
    assert got(spark, rows, tmp_path) == brute(rows)


def test_empty_and_extra_columns(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    m = merkle.manifest(empty, LEAF, "lang", "doc_id")
    assert m.blocks().count() == 0 and merkle.audit(m).count() == 0
    df = spark.createDataFrame([(1, "t", "en", "s", 1, "x", 9, 3)], SCHEMA + ", tree string, pos int, n int")
    r = merkle.audit(merkle.manifest(df, LEAF, "lang", "doc_id")).first()
    assert r.verified and r.root == r.leaf == leaf((1, "t", "en", "s", 1), "t")


def test_van_emde_boas_order():
    """Top half of the levels first, then each subtree below it in one stretch; siblings by address."""
    at = merkle.places(4)
    assert sorted(x for p in at for x in p.tolist()) == list(range(585))
    assert [p.tolist() for p in at[:2]] == [[0], list(range(1, 9))]
    for k in range(64):  # a node of the third level and its children are neighbours
        assert at[3][8 * k:8 * k + 8].tolist() == [at[2][k] + 1 + j for j in range(8)]
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(77)]
    nodes, root = merkle.build(leaves, 3)
    want, paths = tree([x.hex() for x in leaves])
    assert root.hex() == want and len(nodes) < 32 * 585 and merkle.siblings(nodes, 77, 3) == paths
    assert all(merkle.fold(x.hex(), p) == want for x, p in zip(leaves, paths))
    assert merkle._unpacked(merkle._packed(paths[70])) == paths[70]


def test_manifest_and_siblings(spark):
    rows = corpus(600, ["en"])
    m = merkle.manifest(spark.createDataFrame(rows, SCHEMA), LEAF, "lang", "doc_id")
    blocks = {(r.forest, r.round, r.block): r for r in m.blocks().collect()}
    assert set(blocks) == {("rows", 0, 0), ("rows", 0, 1), ("rows", 1, 0), ("groups", 0, 0)}
    out = merkle.audit(m, with_siblings=True).collect()
    assert all(r.verified and r.proof_sha256 == sha("".join(r.siblings)) for r in out)
    assert bytes(blocks["groups", 0, 0].root).hex() == out[0].root
