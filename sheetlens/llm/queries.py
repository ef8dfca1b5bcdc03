"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlens.llm import ann, langid, merkle, mixing, neardup, packing, pages, quality, runs, setjoin, shard, suffix, topk
from sheetlens.llm.oracles import ORACLE  # noqa: F401 - part of this module's contract

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: five words, similarity 0.75."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op2_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's votes, weak labels, scores and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, RANKS)


def op4_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found by cosine of every fiftieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated strings of 400 bytes."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 1, 2, 3 over the sources, at most three times each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "position")


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.extract_main(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest integer inner products of every fiftieth vector."""
    return topk.top_products(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    return shard.shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _with_planted_runs(text: str, doc_id: str):
    """The text; of every tenth document (by its id's checksum) a later part repeats a few words."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n, h = F.size(words), F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = F.pmod(g, F.nullif(n, F.lit(0))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.col(text))


def op11_frequency_split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of every document, every tenth with a planted one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_planted_runs("text", "doc_id").alias("text"))
    out = runs.find_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                     F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", (-F.col("best.col2")).alias("start"), F.col("best.length").alias("length"),
                      (-F.col("best.col3")).alias("period"),
                      F.expr("(1000 * best.length) div (-best.col3)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_veb_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, and its proofs against a table of which a third is tampered with."""
    docs = table(spark, sf_dir, "documents").select(*LEAF)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = merkle.manifest(docs, LEAF, group="lang", order="doc_id", changed=tampered, replaced={"text": lowered})
    return merkle.audit(made).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256",
                                     "folded_root", "verified")


def op13_pigeonhole_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with four-word shingle sets of similarity 0.85 or more."""
    return setjoin.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hyperminhash_dedup": op1_hyperminhash_dedup,
    "op2_weak_label_quality": op2_weak_label_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_adaptive_ann": op4_adaptive_ann,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_kneser_ney_langid": op6_kneser_ney_langid,
    "op7_curriculum_mix": op7_curriculum_mix,
    "op8_wrapper_induction": op8_wrapper_induction,
    "op9_histogram_shards": op9_histogram_shards,
    "op10_cover_tree_topk": op10_cover_tree_topk,
    "op11_frequency_split_runs": op11_frequency_split_runs,
    "op12_veb_merkle_manifest": op12_veb_merkle_manifest,
    "op13_pigeonhole_jaccard": op13_pigeonhole_jaccard,
}
