"""The pipeline: every stage on its own input against a plain version, and the run as a whole."""

import hashlib

import pytest

import corpus_pipeline as cp
from test_neardup import brute as near_brute
from test_suffix import brute as repeat_brute

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    from sheetlens.llm.common import written

    docs, out = spark.read.parquet(f"{SF0001}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        after = written(stage(spark, docs, SF0001), name)
        out[name] = (docs, after)
        docs = after
    return out


def test_columns_and_order(spark, stages):
    assert [n for n, _ in cp.STAGES] == list(stages)
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == docs.columns and after.dtypes == docs.dtypes


def test_quality(stages):
    from sheetlens.llm import quality

    before, after = stages["quality_classifier"]
    labels = before.sparkSession.read.parquet(f"{SF0001}/labels.parquet")
    kept = {r.doc_id for r in quality.classify(before, labels).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and 0 < len(kept) < before.count()


def test_near_duplicates(stages):
    before, after = stages["minhash_near_dedup"]
    want = {d for d, _, c, _ in near_brute([(r.doc_id, r.text) for r in before.collect()]) if d == c}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_repeated_passages(stages):
    before, after = stages["suffix_array_dedup"]
    want = {d: (gone, sha) for d, _, gone, _, sha in repeat_brute([(r.doc_id, r.text) for r in before.collect()], 200, 51)}
    texts = {r.doc_id: r for r in before.collect()}
    assert after.count() == len(want)
    for r in after.collect():
        gone, sha = want[r.doc_id]
        if not gone:
            assert r == texts[r.doc_id]
        else:
            assert r.n_chars == len(r.text) and len(r.text.encode()) <= len(texts[r.doc_id].text.encode()) - gone
            if "�" not in r.text and hashlib.sha256(r.text.encode()).hexdigest() != sha:
                assert len(texts[r.doc_id].text.encode()) - gone - len(r.text.encode()) < 8   # parts of cut characters


def test_planted_passages(spark):
    """Passages of 51 to 60 short words in otherwise different documents go; those of 50 words and clean documents stay."""
    import random
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for k in range(10):
        passage = prose(51 + k)
        for d in range(3):
            planted[len(rows)] = passage
            rows.append((len(rows), f"{prose(80)} {passage} {prose(80)}"))
    short = "Only " + prose(48) + " fifty"
    rows += [(len(rows) + k, f"{k}{prose(40)}. {short} {k}{prose(40)}") for k in range(3)]
    rows += [(len(rows) + k, prose(300)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars")
    out = {r.doc_id: r.text for r in cp.drop_repeated_passages(spark, docs, SF0001).collect()}
    for d, text in rows:
        if d in planted:
            assert planted[d] not in out[d] and len(out[d].split()) >= 158
        else:
            assert out[d] == text


def test_mix(stages):
    from test_mixing import plain_targets, words

    before, after = stages["mixing_to_target_weights"]
    rows, sizes, got = before.collect(), {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in after.collect():
        got[r.source] = got.get(r.source, 0) + words(r.text)
    longest = {s: max(words(r.text) for r in rows if r.source == s) for s in sizes}
    for s, t in plain_targets(sizes).items():
        assert abs(got.get(s, 0) - t) <= longest[s]
    texts = {(r.doc_id, r.text) for r in rows}
    assert all((r.doc_id, r.text) in texts for r in after.collect())


def test_packing_and_run(spark, stages):
    before, after = stages["best_fit_packing"]
    seqs = {}
    for r in after.collect():
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(cp.run(spark, SF0001)) == key(after)


def test_stages_on_odd_input(spark):
    schema = spark.read.parquet(f"{SF0001}/documents.parquet").schema
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", "en", None, 15),
                                 (3, "one line", "en", "a", 8), (3, "one line", "en", "a", 8)], schema)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF0001).count() == 0
        n = stage(spark, odd, SF0001).count()
        assert n == {"minhash_near_dedup": 4, "mixing_to_target_weights": n}.get(name, 5)
    extra = odd.selectExpr("*", "1 AS rid", "'k' AS kept", "2 AS size", "3 AS position")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, extra, SF0001).columns == extra.columns
